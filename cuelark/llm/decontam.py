"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

Every passage (a window of two halves, half overlapping the next) of every training text is a query. Words
compare without case and ASCII punctuation. A half has HALF words, or for longer items the next power of two above their length: items are
indexed by that class of length, so an item meets passages of a width that hangs on itself alone. An item is retrieved if its BM25 score for the passage
reaches the item's threshold. The threshold is not a guess: a passage that holds a share SIMILARITY of an item's
five-word shingles leaves at most floor((1 - SIMILARITY) * shingles) of the item's word positions uncovered,
so its score is at least the item's own score less that many of its heaviest terms. No leak scores lower.

Pivoting: order an item's terms from rare to common; as long as the terms left still reach the
threshold, the item must be entered from one of those before. Only words of these essential
lists open a passage. An opened passage bounds each block of items by the block's largest
term weights, skips blocks that cannot reach their least threshold, and scores the others in full.
Retrieved items are verified by shingles: a share of SIMILARITY of the item's shingles in the passage, and
shingles of both its question (the first half) and its answer (the last half).

The items are held in memory a slice at a time: most_items items or most_bytes of their text, whichever comes first (one item at least). A
slice is indexed, broadcast, used in one narrow pass whose result is stored, and given back before the next one is read; so
more items take more passes over the texts, and neither the driver nor a worker holds more than a slice. How many items there are, their
mean length and how many of them hold a term are counted over all items (in Spark where there are several slices), so slices change no score.

Defined results: null or empty texts and items match nothing; items of fewer than five words are one
shingle of all their words; equal items each give a row; a document that repeats as a row
gives rows once for each; empty tables give no rows.
Only `doc_id`, `text`, `item_id` and the item's `text` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import stored

K = 5
SIMILARITY = 0.8
HALF = 64
BLOCK_ITEMS = 16
K1, B = 1.2, 0.75


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for s in W.normal_slices(pa.array(texts, pa.string())):
        words = W.hash_words(s)
        out += [words.hashes[a:b] for a, b in zip(words.bounds, words.bounds[1:], strict=False)]
    return out


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-word windows in order, or of all words if they are fewer."""
    k = min(k, len(words))
    return W.grams(W.Words(words, words[:0], np.array([0, len(words)])), k)[0] if k else np.zeros(0, np.uint64)


def half_of(n: int) -> int:
    """Words in half a passage for items of n words."""
    return max(HALF, 1 << (n - 1).bit_length())


class Stats:
    """Of all items that have a word: how many there are, their mean length, and how many hold each term."""

    def __init__(self, n: int, mean: float, df: dict[int, int]):
        self.n, self.mean, self.df = n, mean, df

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Stats:
        df: dict[int, int] = {}
        for w in items:
            for t in np.unique(w).tolist():
                df[t] = df.get(t, 0) + 1
        return cls(len(items), sum(map(len, items)) / max(1, len(items)), df)


class Index:
    """Postings of the items of one class of length, their thresholds, and the block maxima."""

    def __init__(self, items: list[tuple[int, np.ndarray]], half: int, stats: Stats):
        kept = sorted(items, key=lambda x: len(x[1]))  # neighbours in a block have like lengths and thresholds
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.half = half
        tfs = [np.unique(w, return_counts=True) for w in self.words]
        df, n, mean = stats.df, stats.n, stats.mean
        self.terms = np.unique(np.concatenate([t for t, _ in tfs]))
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in place}
        self.weights: list[dict[int, float]] = []
        for w, (terms, tf) in zip(self.words, tfs, strict=True):
            norm = K1 * (1 - B + B * len(w) / mean)
            self.weights.append({place[t]: idf[t] * f * (K1 + 1) / (f + norm) for t, f in zip(terms.tolist(), tf.tolist(), strict=True)})
        self.shingles = [shingles(w) for w in self.words]
        self.threshold = []
        essential: list[list[int]] = [[] for _ in self.terms]
        for item, weight in enumerate(self.weights):
            whole = sum(weight.values())
            lost = int((1 - SIMILARITY) * len(np.unique(self.shingles[item])) + 1e-9)
            threshold = max(1e-9, whole - sum(sorted(weight.values(), reverse=True)[:lost])) * (1 - 1e-9)
            self.threshold.append(threshold)
            left = whole
            for t in sorted(weight, key=lambda t: (df[int(self.terms[t])], t)):
                if left < threshold:
                    break
                essential[t].append(item)
                left -= weight[t]
        blocks = -(-len(kept) // BLOCK_ITEMS)
        self.block_least = [min(self.threshold[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS]) for b in range(blocks)]
        self.block_max: list[dict[int, float]] = [{} for _ in range(blocks)]
        for item, weight in enumerate(self.weights):
            top = self.block_max[item // BLOCK_ITEMS]
            for t, x in weight.items():
                top[t] = max(top.get(t, 0.0), x)
        self.entry = np.array([bool(e) for e in essential] + [False])
        self.essential = [frozenset(e) for e in essential]
        # words that are no term at all are told by 20 bits of their hash
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def term_of(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers; len(terms) for other words."""
        out = np.full(len(hashes), len(self.terms), np.int64)
        at = np.flatnonzero(self.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
            same = self.terms[place] == hashes[at]
            out[at[same]] = place[same]
        return out

    def retrieve(self, terms: set[int]) -> list[tuple[int, float]]:
        """Items at or above their thresholds for a passage with these terms."""
        out = []
        open_items = set().union(*[self.essential[t] for t in terms])
        for b in {i // BLOCK_ITEMS for i in open_items}:
            top = self.block_max[b]
            if sum([top[t] for t in terms if t in top]) < self.block_least[b]:
                continue
            for item in range(b * BLOCK_ITEMS, min(len(self.ids), (b + 1) * BLOCK_ITEMS)):
                if item in open_items:
                    weight = self.weights[item]
                    score = sum([weight[t] for t in weight.keys() & terms])
                    if score >= self.threshold[item]:
                        out.append((item, score))
        return out

    def leaks(self, words: np.ndarray, terms: np.ndarray) -> dict[int, tuple[float, int, int, float]]:
        """item -> best passage (share of shingles, question's, answer's, score) of one text, for verified items."""
        best: dict[int, tuple[float, int, int, float]] = {}
        half, n = self.half, len(words)
        entries = np.unique(np.flatnonzero(self.entry[terms]) // half)
        for c in sorted({w for e in entries.tolist() for w in (e - 1, e)}):
            a, b = max(0, c * half), min(n, (c + 2) * half)
            if c < 0 and n > half:
                continue  # the passage that begins at 0 covers it
            own = set(terms[a:b].tolist())
            own.discard(len(self.terms))
            for item, score in self.retrieve(own):
                here = shingles(words[a:b], min(K, len(self.words[item])))
                found = np.isin(self.shingles[item], here)
                middle = len(found) // 2
                share = len(np.unique(self.shingles[item][found])) / len(np.unique(self.shingles[item]))
                question, answer = int(found[: max(1, middle)].sum()), int(found[middle:].sum())
                if share >= SIMILARITY - 1e-12 and question and answer:
                    best[item] = max(best.get(item, (0.0, 0, 0, 0.0)), (share, question, answer, score))
        return best


LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("bm25", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("bm25", pa.float64())]))


def find(indexes: list[Index]):
    def run(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for s in W.normal_slices(texts):
            words = W.hash_words(s)
            found: list[list[tuple]] = [[] for _ in range(s.n)]
            for index in indexes:
                terms = index.term_of(words.hashes)
                total = np.concatenate([[0], np.cumsum(index.entry[terms])])
                for i in np.flatnonzero(total[words.bounds[1:]] > total[words.bounds[:-1]]).tolist():
                    a, b = words.bounds[i], words.bounds[i + 1]
                    found[i] += [(index.ids[k], *v) for k, v in index.leaks(words.hashes[a:b], terms[a:b]).items()]
            out += [[{"item_id": x[0], "share": x[1], "bm25": x[4]} for x in sorted(rows)] for rows in found]
        return pa.array(out, _ARROW)

    return run


def indexes_of(items: list[tuple[int, np.ndarray]], stats: Stats) -> list[Index]:
    """An index for each class of length."""
    classes: dict[int, list] = {}
    for item in items:
        classes.setdefault(half_of(len(item[1])), []).append(item)
    return [Index(classes[h], h, stats) for h in sorted(classes)]


def item_slices(items: DataFrame, most_items: int = 50_000, most_bytes: int = 64 << 20) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(item_id, words) of the items that have words, a slice at a time."""
    with_words = lambda rows: [(r[0], w) for r, w in zip(rows, item_words([r[1] for r in rows]), strict=True) if len(w)]
    rows, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        own = len((r[1] or "").encode())
        if rows and (len(rows) == most_items or size + own > most_bytes):
            yield with_words(rows)
            rows, size = [], 0
        rows.append(r)
        size += own
    if rows:
        yield with_words(rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct term of an item, and one of a null term with the item's length."""
    for b in batches:
        for w in item_words(b.column("text").to_pylist()):
            if len(w):
                terms = np.unique(w).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([None, *terms.tolist()], pa.int64()), pa.array([len(w), *[0] * len(terms)], pa.int64())], ["term", "words"])


def corpus_stats(items: DataFrame):
    """A function that gives the Stats of all items for the terms of a slice; the counts of all terms stay in a table."""
    spark = items.sparkSession
    table = stored(items.select("text").mapInArrow(_counts, "term long, words long").groupBy("term").agg(F.count("*").alias("n"), F.sum("words").alias("words")))
    whole = table.where("term IS NULL").first()
    n, words = (whole["n"], whole["words"]) if whole else (0, 0)

    def of(part: list[tuple[int, np.ndarray]]) -> Stats:
        terms = np.unique(np.concatenate([w for _, w in part])) if part else np.zeros(0, np.uint64)
        asked = spark.createDataFrame(pa.table({"term": pa.array(terms.view(np.int64))}))
        df = {r["term"] % 2**64: r["n"] for r in table.join(asked, "term").select("term", "n").collect()}  # terms of a slice
        return Stats(n, words / max(1, n), df)

    return of


def with_leaks(docs: DataFrame, items: DataFrame, name: str = "leaks", most_items: int = 50_000, most_bytes: int = 64 << 20) -> DataFrame:
    """docs with an array of the leaked items added; a pass for each slice of items, each but the last stored."""
    out, held = docs.select("*", F.array().cast(LEAKS).alias(name)), None
    slices = item_slices(items, most_items, most_bytes)
    ahead, stats = next(slices, None), None
    while ahead is not None:
        part, ahead = ahead, next(slices, None)
        if stats is None:
            # a sole slice has all items
            stats = (lambda p: Stats.of([w for _, w in p])) if ahead is None else corpus_stats(items)
        if not part:
            continue
        if held is not None:
            out = stored(out)
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(indexes_of(part, stats(part)))
        found = F.arrow_udf(lambda texts, held=held: find(held.value)(texts), LEAKS)(F.col("text"))
        out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.concat(name, found).alias(name))
    return out
