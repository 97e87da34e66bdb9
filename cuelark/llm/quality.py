"""Quality by weak supervision.

Rules look at counts of a text and vote good (+1), bad (-1) or abstain (0).
Expectation-maximisation over all documents' vote patterns estimates how often
each rule is right and how common good documents are; the posterior probability
of "good" then replaces an all-rules-must-pass filter.

Defined results: a null text counts as empty; an empty text has no words, fails
the base rule and is not kept; a text of any length is read whole; repeated rows
each get their own row and count as often as they occur; an empty table gives no
rows. Only `doc_id` and `text` are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(range(0x41, 0x5B))] = True
_LOWER = np.zeros(256, bool)
_LOWER[list(range(0x61, 0x7B))] = True

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_distinct", "n_shout")
COUNTS = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])


def text_counts_of(s: W.Slice) -> list[np.ndarray]:
    words, n = W.hash_words(s), s.n
    text = np.repeat(np.arange(n), np.diff(s.offsets))
    total = lambda flags: W.per_text(np.ones(1), text[:0], n) if not len(text) else np.bincount(text[flags], minlength=n)
    lead = (s.data & 0xC0) != 0x80
    line, line_text, wordy = W.hash_lines(s)
    line, line_text = line[wordy], line_text[wordy]
    lines = np.bincount(line_text, minlength=n)
    dup_lines = lines - np.bincount(np.unique(np.stack([line_text.astype(np.uint64), line]), axis=1)[0].astype(np.int64), minlength=n) if len(line) else lines
    word_text = words.text_of()
    gram, at = W.grams(words, 3)
    keyed = gram ^ W.mix(word_text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    repeated = np.zeros(len(keyed) + 1, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    cover = np.zeros(len(words.hashes), bool)
    hit = at[repeated[:-1]]
    for j in range(3):
        cover[hit + j] = True
    own = words.hashes ^ W.mix(word_text.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(own, return_index=True)
    shout = (s.data == 0x21).copy()
    shout[:-1] &= s.data[1:] == 0x21
    return [
        words.counts,
        total(lead & ~W._SPACE[s.data]),
        total(_SYMBOL[s.data]),
        dup_lines,
        np.bincount(word_text[cover], minlength=n),
        lines,
        total(_UPPER[s.data]),
        total(_LOWER[s.data]),
        np.bincount(word_text[first], minlength=n),
        total(shout),
    ]


def count_batch(texts: pa.Array) -> pa.Array:
    parts = [text_counts_of(s) for s in W.slices(texts)]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(FIELDS))]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], list(FIELDS))


def text_counts(text: Column) -> Column:
    return F.arrow_udf(count_batch, COUNTS)(text)


def base_failed(c: str = "counts") -> Column:
    n = F.col(f"{c}.n_words")
    return (n < MIN_WORDS) | (F.col(f"{c}.n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)


def votes(c: str = "counts") -> list[Column]:
    """One column for each rule: 1 good, -1 bad, 0 abstains.

    A rule that looks for one fault votes bad or abstains (not finding that fault says little);
    the last two vote good or abstain. Short texts say little, so most rules abstain on them."""
    g = lambda f: F.col(f"{c}.{f}").cast("double")
    n, chars = F.greatest(g("n_words"), F.lit(1.0)), F.greatest(g("word_chars"), F.lit(1.0))
    fault = lambda ratio, bad, few=10: F.when((g("n_words") >= few) & (ratio >= bad), -1).otherwise(0)
    return [
        fault(g("n_symbols") / n, 0.30),
        fault(g("n_upper") / F.greatest(g("n_upper") + g("n_lower"), F.lit(1.0)), 0.40),
        fault(g("n_repeat_words") / n, 0.40, 30),
        fault(g("n_dup_lines") / F.greatest(g("n_lines"), F.lit(1.0)), 0.60, 30),
        fault(F.lit(1.0) - g("n_distinct") / n, 0.90, 30),
        fault(g("n_shout") / n, 0.15),
        fault(F.abs(chars / n - 6.0), 9.0),
        F.when(g("n_words") < 10, -1).otherwise(0),
        F.when((g("n_words") >= MIN_WORDS) & (F.abs(chars / n - 6.0) <= 4.0), 1).otherwise(0),
        F.when((g("n_words") >= 30) & (g("n_symbols") / n <= 0.10) & (g("n_shout") / n <= 0.05), 1).otherwise(0),
    ]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[tuple[dict, dict]]]:
    """EM for (share of good, per rule the distribution of its votes on good and on bad texts).

    The start takes a text for bad if any rule votes so. Dirichlet priors state that a rule
    rarely votes against the truth."""
    total = sum(n for _, n in patterns)
    rules = len(patterns[0][0]) if patterns else 0
    prior = ({1: 5.0, 0: 5.0, -1: 0.1}, {1: 0.5, 0: 5.0, -1: 5.0})
    q = [0.05 if -1 in v else 0.95 for v, _ in patterns]
    share, tables = 0.8, []
    for _ in range(rounds if total else 0):
        share = (sum(w * n for w, (_, n) in zip(q, patterns, strict=True)) + 4.0) / (total + 5.0)
        tables = []
        for r in range(rules):
            mass = [dict(p) for p in prior]
            for w, (v, n) in zip(q, patterns, strict=True):
                mass[0][v[r]] += n * w
                mass[1][v[r]] += n * (1 - w)
            tables.append(tuple({k: x / sum(m.values()) for k, x in m.items()} for m in mass))
        fresh = [posterior(v, share, tables) for v, _ in patterns]
        moved = max((abs(a - b) for a, b in zip(q, fresh, strict=True)), default=0.0)
        q = fresh
        if moved < 1e-9:
            break
    return share, tables


def weights(good: dict[int, float], bad: dict[int, float]) -> dict[int, float]:
    """Log-likelihood ratio of each vote, and of abstaining."""
    return {k: math.log(good[k] / bad[k]) for k in (1, 0, -1)}


def posterior(vote: tuple[int, ...], share: float, tables) -> float:
    z = math.log(share / (1 - share)) + sum(weights(*t)[v] for v, t in zip(vote, tables, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def weak_supervision(docs: DataFrame, text: str = "text", threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """docs with `quality` = struct(counts.., votes, base_failed, probability, kept) added; of docs only `columns` if they are named.

    Texts are read and counted once: the counts are stored beside the columns that are kept, and both the vote patterns and
    the verdicts come from that table. There are 3^rules patterns at most, whatever the corpus holds, so their counts and
    the table of posteriors are bounded; the counts are over all rows."""
    name = "quality"
    own = stored(docs.select(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)], text_counts(F.col(text)).alias("__counts")))
    own = own.withColumn("__pattern", F.concat_ws(",", *[v.cast("string") for v in votes("__counts")]))
    seen = own.groupBy("__pattern").agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(map(int, r["__pattern"].split(","))), r["n"]) for r in seen)
    share, tables = fit(patterns)
    # the log-likelihood ratio of every rule's vote, as a Catalyst expression over literals
    z = F.lit(math.log(share / (1 - share)))
    for v, t in zip(votes("__counts"), tables, strict=False):
        w = weights(*t)
        z = z + F.when(v == 1, w[1]).when(v == -1, w[-1]).otherwise(w[0])
    p = 1 / (1 + F.exp(-z))
    failed = base_failed("__counts")
    verdict = F.struct(*[F.col(f"__counts.{f}").alias(f) for f in FIELDS], F.split("__pattern", ",").cast("array<int>").alias("votes"), failed.alias("base_failed"), p.alias("probability"), (~failed & (p >= threshold)).alias("kept"))
    return own.withColumn(name, verdict).drop("__counts", "__pattern")
