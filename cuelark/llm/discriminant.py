"""Quality by a regularised quadratic discriminant.

Texts become statistics, and these become features whose spread does not hang on the text's length: square roots of shares, each
with a few words' worth of prior, and logarithms. Features are kept as integers in units of 1 / UNIT, so that the sums that training needs (of rows, of
features, and of products of two features, by class) are exact and the same however the rows are dealt. Only these sums reach
the driver: labelled rows are not sampled, and training cost there hangs on the number of features alone.

Each class is a normal distribution. Its covariance is drawn first to the pooled one by POOLED_ROWS rows' worth, then to a multiple of the
identity by the approximation of the oracle shrinkage, all in units of the pooled spread. The Cholesky factors are computed once and cached as their
inverses: a text's log-density is then one triangular product. The score is the logistic function of the difference of the classes' log-densities,
divided by TEMPER (the features of one text are not independent evidence beyond their covariance), plus the log-odds of the classes.

Defined results: a null text is empty, and an empty text has features and a score as any other; texts of any length are read whole; a
document labelled twice has its highest label; null ids and labels teach nothing, and a null id is not held out; repeated rows get a score each and teach
each; with labels of one class or none the score is the smoothed share of the class; an empty table gives no rows. Only `doc_id` and `text`, and
`doc_id` and `quality` of the labels, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality
from . import words as W
from .common import crc_mod, stored

UNIT = 4096
POOLED_ROWS = 50.0
TEMPER = 4.0
FOLDS = 5
FEATURES = ("symbols", "capitals", "repeats", "lines_again", "distinct", "shouts", "word_length", "runs", "length", "marks", "digits", "lines")
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True


def _features(s: W.Slice) -> np.ndarray:
    """A row of FEATURES for each text of a slice."""
    c = dict(zip(quality.FIELDS, (np.asarray(x, np.float64) for x in quality.text_counts_of(s)), strict=True))
    words, text = W.hash_words(s), np.repeat(np.arange(s.n), np.diff(s.offsets))
    own = words.text_of()
    again = (words.hashes[1:] == words.hashes[:-1]) & (own[1:] == own[:-1])
    count = lambda flags, of: np.bincount(of[flags], minlength=s.n).astype(np.float64)
    n, chars = c["n_words"], c["word_chars"]
    share = lambda a, b, prior: np.sqrt(a / (b + prior))
    columns = [
        share(c["n_symbols"], n, 10),
        share(c["n_upper"], c["n_upper"] + c["n_lower"], 50),
        share(c["n_repeat_words"], n, 10),
        share(c["n_dup_lines"], c["n_lines"], 5),
        share(c["n_distinct"], n, 10),
        share(c["n_shout"], n, 10),
        np.log((chars + 60) / (n + 10)),
        share(count(again, own[1:]), n, 10),
        np.log1p(n) / 4,
        share(count(_MARK[s.data], text), n, 10),
        share(count(_DIGIT[s.data], text), chars, 50),
        share(c["n_lines"], n, 10),
    ]
    return np.stack(columns, axis=1)


def features(texts: pa.Array) -> pa.Array:
    rows = [np.rint(_features(s) * UNIT).astype(np.int32) for s in W.slices(texts)]
    flat = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(FEATURES), dtype=np.int32)), pa.array(flat.ravel()))


def text_features(text: Column) -> Column:
    return F.arrow_udf(features, T.ArrayType(T.IntegerType()))(text)


def class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (label, x): by class the number of rows, the sums of features, and those of products of two."""
    d = len(FEATURES)
    upper = np.triu_indices(d)
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
        label = b.column("label").to_numpy(zero_copy_only=False)
        for k in np.unique(label).tolist():
            own = x[label == k]
            total = np.concatenate([[len(own)], own.sum(0), (own.T @ own)[upper]])
            sums[k] = sums.get(k, 0) + total
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["label", "s"])


@dataclass
class Normal:
    """A class: the logarithm of its share, its mean, the inverse of its Cholesky factor and the logarithm of the factor's determinant."""

    log_share: float
    mean: np.ndarray
    inverse: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return -0.5 * (z * z).sum(1) - self.log_det


def shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """A covariance of n rows, drawn to a multiple of the identity by the oracle approximating shrinkage."""
    p = len(cov)
    mean, square = np.trace(cov) / p, (cov * cov).sum()
    top, bottom = (1 - 2 / p) * square + (mean * p) ** 2, (n + 1 - 2 / p) * (square - mean * mean * p)
    weight = 1.0 if bottom <= 0 else min(1.0, top / bottom)
    return (1 - weight) * cov + weight * max(mean, 1e-6) * np.eye(p)


def fit(sums: dict[int, list[int]], pooled_rows: float = POOLED_ROWS) -> tuple[list[Normal], np.ndarray] | float:
    """(classes 0 and 1, spreads of the features) from the exact sums; with one class or none, the smoothed share of class 1."""
    number = [sums[k][0] if k in sums else 0 for k in (0, 1)]
    if not all(number):
        return (number[1] + 1) / (sum(number) + 2)
    d = len(FEATURES)
    upper = np.triu_indices(d)
    means, scatters = [], []
    for k in (0, 1):
        n, s, ss = sums[k][0], sums[k][1 : d + 1], sums[k][d + 1 :]
        scatter = np.zeros((d, d))
        # whole numbers until the last division: n * sum of products - product of sums
        for i, j, v in zip(*upper, ss, strict=True):
            scatter[i, j] = scatter[j, i] = (n * v - s[i] * s[j]) / n / UNIT**2
        means.append(np.array([v / n / UNIT for v in s]))
        scatters.append(scatter)
    pooled = (scatters[0] + scatters[1]) / sum(number)
    spread = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    unit = np.outer(spread, spread)
    classes = []
    for k in (0, 1):
        n = number[k]
        cov = (scatters[k] + pooled_rows * pooled) / (n + pooled_rows) / unit
        factor = np.linalg.cholesky(shrunk(cov, n))
        classes.append(Normal(float(np.log(n / sum(number))), means[k] / spread, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return classes, spread


def scores(model, x: np.ndarray) -> np.ndarray:
    """Scores of rows of features in units of 1 / UNIT."""
    if isinstance(model, float):
        return np.full(len(x), model)
    classes, spread = model
    own = x / UNIT / spread
    odds = (classes[1].log_density(own) - classes[0].log_density(own)) / TEMPER + classes[1].log_share - classes[0].log_share
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def learn(known: DataFrame, labels: DataFrame):
    """The model of known(doc_id, x) from labels(doc_id, label)."""
    once = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    taught = known.join(once, "doc_id").select("label", "x")
    width = 1 + len(FEATURES) + len(FEATURES) * (len(FEATURES) + 1) // 2
    total = taught.mapInArrow(class_sums, "label int, s array<long>").groupBy("label").agg(*[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    return fit({r["label"]: [int(v) for v in r[1:]] for r in total.collect()})  # two rows


def classified(docs: DataFrame, labels: DataFrame, fold: int = 0, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score) of docs(doc_id, text): learned from labels(doc_id, label) outside the fold that is held out."""
    own = stored(docs.select("doc_id", text_features(F.col("text")).alias("x")))
    outside = labels.select("doc_id", F.col(label).alias("label")).where(crc_mod(F.col("doc_id"), FOLDS) != fold)
    model = learn(own, outside)

    def score(x: pa.Array) -> pa.Array:
        return pa.array(scores(model, x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))))

    held_out = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == fold, F.lit(False))
    return own.select("doc_id", held_out.alias("held_out"), F.arrow_udf(score, T.DoubleType())(F.col("x")).alias("score"))
