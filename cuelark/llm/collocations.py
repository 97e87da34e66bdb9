"""Phrase collocations by SON partitioning.

Pass one mines shards. A shard is a run of documents of SHARD_BYTES of text (whole documents; one at least); all its phrases of one to
LONGEST words are counted, and those are kept whose local count reaches the support lowered to the shard's share of all bytes,
ceil(support * share). A phrase that reaches the support in a language anywhere in the corpus reaches it so in one shard at least, since the
shares sum to 1. Locally frequent phrases go, as keys of 32 bits and the range's own with their counts, to owners of key ranges, which unite the shards and keep a
phrase unless what the shards reported and the most that the silent ones may hold stay below the support. What is kept becomes bits
of a filter of at most MOST_BITS bits, so that what is broadcast is bounded; a key that meets another's bit costs work, not
exactness. With many shards the lowered support is 1 and nothing is silent: then the owners' sums are whole.

Pass two counts every phrase of the filter exactly, by its words and not by keys, first within shards and then, range by range, over all, and
drops those below the support. Scores are computed on these counts in decimals of 38 digits.

Defined results: A-Z become a-z and nothing else does; a null text is empty, a null language is `und`; phrases do not cross
the characters `.,;:!?` or \\n to \\r; texts of any length are read whole; repeated documents count as often as they occur; an empty
table gives no rows. Only `text` and `lang` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import stored

SUPPORT = 10
LONGEST = 3
MOST = 2000
SHARD_BYTES = 4 << 20
OWNED_BYTES = 32 << 20  # keys of one range, about
MOST_BITS = 1 << 28
MOST_OWNERS = 4096

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 0x20
_PLAIN[list(b".,;:!?\x0b\x0c\x0d")] = 0x0A
_FULL = ~W._SPACE


class Shard:
    """Words of some texts: numbers of distinct words, their hashes, and the piece and the language each word is in."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        parts, pieces, owners, before = [], [], [], 0
        for s in W.slices(texts):
            data = _PLAIN[s.data]
            full = _FULL[data]
            starts = W._segments(full, s.offsets)
            ends = W._sums(full.astype(np.int64), starts) if len(starts) else starts
            bounds = np.concatenate([[0], np.cumsum(ends)]).astype(np.int64)
            parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[full].tobytes())]))
            text = np.searchsorted(s.offsets, starts, "right") - 1
            pieces.append((np.cumsum(data == 0x0A, dtype=np.int32)[starts] + text + before).astype(np.int32))
            before = int(pieces[-1][-1]) + 1 if len(starts) else before
            owners.append(langs[s.first + text].astype(np.int32))
        coded = pa.chunked_array(parts, pa.large_binary()).combine_chunks().dictionary_encode() if parts else pa.array([], pa.large_binary()).dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.words: pa.Array = coded.dictionary
        # numbered in order, so that phrases leave a shard in order too: sorted rows compress
        order = pc.sort_indices(self.words)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order))
        self.words = self.words.take(order)
        self.ids = rank[coded.indices.to_numpy(zero_copy_only=False)]
        self.piece = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        self.lang = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        hashes = [W.hash_words(s).hashes for s in W.slices(self.words.cast(pa.large_string()))]
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)

    def runs(self, k: int) -> np.ndarray:
        """First words of the phrases of k words."""
        n = len(self.ids) - k + 1
        return np.flatnonzero(self.piece[: max(0, n)] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def keys(self, at: np.ndarray, k: int, salts: np.ndarray) -> np.ndarray:
        """64-bit keys of (language, words) of the phrases that begin at `at`; salts: a hash for each language's number."""
        out = salts[self.lang[at]]
        out += np.uint64(k)
        for j in range(k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += self.hashes[self.ids[at + j]]
        return W.mix(out)


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of (lang, text) of `most` bytes of text or a little more, each given when it is full."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        at = 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = min(b.num_rows, int(np.searchsorted(ends, done + most - size, "left")) + 1)
            held.append(b.slice(at, to - at))
            size += int(ends[to - 1] - done)
            at = to
            if size >= most:
                yield _joined(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    table = pa.Table.from_batches(held)
    return tuple(pc.fill_null(table.column(c).cast(pa.large_string()), d).combine_chunks() for c, d in (("lang", "und"), ("text", "")))


def _opened(lang: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, Shard]:
    """(distinct languages, their hashes, the shard)."""
    coded = lang.dictionary_encode()
    names = coded.dictionary
    salts = np.array([int.from_bytes(_digest(x.as_py()), "little") for x in names], np.uint64)
    return names, salts, Shard(text, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))


def _digest(name: str) -> bytes:
    return hashlib.blake2b(name.encode(), digest_size=8).digest()


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, how often each occurs); sorts in place."""
    values.sort()
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.diff(np.append(starts, len(values)))


def lowered(size: int, total: int, support: int) -> int:
    """The support of a shard that holds `size` of `total` bytes."""
    return max(1, -(-support * size // max(1, total)))


def packed(keys: np.ndarray) -> bytes:
    """Ascending 32-bit keys as the byte planes of their differences, of which the high ones are nearly all zero and compress."""
    return np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def mine(total: int, ranges: int, support: int, shard_bytes: int):
    """mapInArrow over documents: the locally frequent keys of each shard, a row for each range of keys that holds some.

    A range is named by the key's first bits; the 32 bits after them stand for the key. A count above the support is as good as the
    support. A shard whose lowered support is above 1 has a row for every range, so that all owners know of it: there are fewer such shards than the support."""
    bits = ranges.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in shards(batches, shard_bytes):
            least = lowered(int(pc.sum(pc.binary_length(text)).as_py() or 0), total, support)
            _, salts, shard = _opened(lang, text)
            keys, n = _counted(np.concatenate([shard.keys(shard.runs(k), k, salts) for k in range(1, LONGEST + 1)]) >> np.uint64(32 - bits))
            keys, n = keys[n >= least], np.minimum(n[n >= least], support)
            bounds = np.searchsorted(keys >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(bounds)) if least == 1 else np.arange(ranges)
            for some in np.array_split(used, max(1, len(keys) >> 19)):
                spans = [slice(bounds[c], bounds[c + 1]) for c in some]
                columns = [pa.array(some.astype(np.int32)), pa.array([packed(keys[x].astype(np.uint32)) for x in spans], pa.binary()), pa.array([n[x].astype("<u4").tobytes() for x in spans], pa.binary()), pa.array(np.full(len(some), least, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "keys", "n", "least"])

    return run


def unite(ranges: int, bits: int, support: int):
    """mapInArrow over an owner's key ranges, one after the other: the bits of the phrases that may reach the support.

    A shard of lowered support t that is silent about a phrase holds it t - 1 times at most: to what the shards report comes
    the sum of that over the silent ones."""
    own = bits // ranges
    shift = np.uint64(32 - (own.bit_length() - 1))

    def row(cell: int, held: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
        keys = np.concatenate([unpacked(k) for k, _, _ in held])
        n = np.concatenate([np.frombuffer(c, "<u4").astype(np.int32) - (least - 1) for _, c, least in held])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        flags = np.zeros(own, bool)
        if len(keys):
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            frequent = keys[starts][np.add.reduceat(n, starts) + sum(least - 1 for _, _, least in held) >= support]
            flags[(frequent.astype(np.uint64) >> shift).astype(np.int64)] = True
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["cell", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, []
        for b in batches:
            for cell, *blob in zip(*(b.column(c).to_pylist() for c in ("cell", "keys", "n", "least")), strict=True):
                if cell != at and held:
                    yield row(at, held)
                    held = []
                at = cell
                held.append(blob)
        if held:
            yield row(at, held)

    return run


def count(filter_of, ranges: int, bits: int, shard_bytes: int):
    """mapInArrow over documents: exact counts, by shard, of the phrases whose key is in the filter, in a row for each language and range of keys: the
    phrases in order, a line each, and their counts. A range of -1 counts all words of a language."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    narrow = np.uint64(bits.bit_length() - ranges.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = filter_of()
        for lang, text in shards(batches, shard_bytes):
            names, salts, shard = _opened(lang, text)
            words = shard.words.cast(pa.large_string())
            v = len(words) + 1
            total = np.bincount(shard.lang, minlength=len(names))
            yield _rows(names, np.arange(len(names)), np.full(len(names), -1), [b""] * len(names), [np.uint64(n).tobytes() for n in total])
            for k in range(1, LONGEST + 1):
                at = shard.runs(k)
                place = shard.keys(at, k, salts) >> shift
                kept = (flags[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1
                at, place = at[kept], place[kept]
                if not len(at):
                    continue
                # numbers of words name a phrase without loss, in the order of the words; two steps keep the product below 2^63
                name = shard.lang[at].astype(np.int64) * v + shard.ids[at]
                for j in range(1, k):
                    _, name = np.unique(name, return_inverse=True)
                    name = name * v + shard.ids[at + j]
                _, first, n = np.unique(name, return_index=True, return_counts=True)
                own = shard.lang[at[first]].astype(np.int64) * ranges + (place[first] >> narrow).astype(np.int64)
                order = np.argsort(own, kind="stable")
                own, first, n = own[order], at[first[order]], n[order].astype("<u8")
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                ends = np.append(starts[1:], len(own))
                for some in np.array_split(np.arange(len(starts)), max(1, len(own) >> 17)):
                    lo, hi = starts[some[0]], ends[some[-1]]
                    taken = [words.take(pa.array(shard.ids[first[lo:hi] + j])) for j in range(k)]
                    phrase = taken[0] if k == 1 else pc.binary_join_element_wise(*taken, pa.scalar(" ", pa.large_string()))
                    listed = pa.ListArray.from_arrays(pa.array((np.append(starts[some], hi) - lo).astype(np.int32)), phrase.cast(pa.string()))
                    cell = own[starts[some]]
                    yield _rows(names, cell // ranges, cell % ranges, pc.binary_join(listed, "\n"), [n[starts[i] : ends[i]].tobytes() for i in some])

    return run


def _rows(names: pa.Array, lang: np.ndarray, cell: np.ndarray, phrases, n: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([names.take(pa.array(lang)).cast(pa.string()), pa.array(cell.astype(np.int32)), pa.array(phrases, pa.binary()) if isinstance(phrases, list) else phrases.cast(pa.binary()), pa.array(n, pa.binary())], ["lang", "cell", "phrases", "n"])


def add_up(support: int):
    """mapInArrow over an owner's rows of count, those of a range and language together: (lang, phrase, f) of the phrases that reach the support, by their words."""

    def total(lang: str, cell: int, held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        n = np.concatenate([np.frombuffer(x, "<u8") for _, x in held]).astype(np.int64)
        if cell < 0:
            phrases, f = pa.nulls(1, pa.string()), pa.array([int(n.sum())])
        else:
            said = pc.list_flatten(pc.split_pattern(pa.array([p for p, _ in held], pa.binary()).cast(pa.large_string()), "\n"))
            summed = pa.table({"p": said, "n": n}).group_by("p").aggregate([("n", "sum")])
            summed = summed.filter(pc.greater_equal(summed["n_sum"], support))
            phrases, f = summed["p"].combine_chunks().cast(pa.string()), summed["n_sum"].combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), phrases, f], ["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for lang, cell, *blob in zip(*(b.column(c).to_pylist() for c in ("lang", "cell", "phrases", "n")), strict=True):
                if (cell, lang) != at and held:
                    yield total(at[1], at[0], held)
                    held = []
                at = (cell, lang)
                held.append(blob)
        if held:
            yield total(at[1], at[0], held)

    return run


def _power(n: float) -> int:
    return 1 << max(0, (int(n) - 1).bit_length())


def phrase_counts(docs: DataFrame, support: int = SUPPORT, shard_bytes: int = SHARD_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, phrase, f): the words of each language (null phrase), and every phrase of one to LONGEST words that occurs `support` times or more."""
    spark = docs.sparkSession
    own = docs.select("lang", "text")
    total = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(most_bits, max(1 << 16, _power(4 * total)))
    ranges = min(bits // 64, _power(max(2 * spark.sparkContext.defaultParallelism, 2 * total / OWNED_BYTES)))
    owners = min(ranges, MOST_OWNERS)
    mined = own.mapInArrow(mine(total, ranges, support, shard_bytes), "cell int, keys binary, n binary, least int")
    dealt = mined.repartitionById(owners, (F.col("cell") % owners).cast("int")).sortWithinPartitions("cell")
    whole, size = bytearray(bits // 8), bits // ranges // 8
    for r in dealt.mapInArrow(unite(ranges, bits, support), "cell int, bits binary").collect():  # most_bits / 8 bytes at most
        whole[r["cell"] * size : (r["cell"] + 1) * size] = r["bits"]
    held = spark.sparkContext.broadcast(bytes(whole))
    counted = own.mapInArrow(count(lambda: np.frombuffer(held.value, np.uint8), ranges, bits, shard_bytes), "lang string, cell int, phrases binary, n binary")
    dealt = counted.repartitionById(owners, F.pmod(F.col("cell"), F.lit(owners)).cast("int")).sortWithinPartitions("cell", "lang")
    return stored(dealt.mapInArrow(add_up(support), "lang string, phrase string, f long"))


def with_part(phrases: DataFrame, counts: DataFrame, part: Column, name: str) -> DataFrame:
    """phrases with the count of one of their parts as `name`. Both sides are distinct phrases, so the commonest part meets each phrase of its language once at most."""
    side = counts.select("lang", F.col("phrase").alias("__part"), F.col("f").alias(name))
    return phrases.withColumn("__part", part).join(side, ["lang", "__part"]).drop("__part")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, most) of all candidates of phrase_counts: `most` is the count of the most frequent longer candidate that holds it, or null."""
    n_words = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    words = counts.where("phrase IS NOT NULL").select("lang", "phrase", "f", n_words.alias("k"))
    totals = F.broadcast(counts.where("phrase IS NULL").select("lang", F.col("f").alias("n")))  # a row a language
    single, pairs, triples = (words.where(F.col("k") == k).drop("k") for k in range(LONGEST))
    w = F.split("phrase", " ")
    of = lambda i, j: F.array_join(F.slice(w, i, j), " ")
    ends = lambda df: with_part(with_part(df, single, w[0], "first"), single, F.element_at(w, -1), "last")
    inside = triples.select("lang", "f", F.explode(F.array(of(1, 2), of(2, 2))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    ratio = lambda left, right: F.expr(f"(CAST(1000000 AS DECIMAL(38,0)) * CAST(f AS DECIMAL(38,0)) * CAST(f AS DECIMAL(38,0))) div (CAST({left} AS DECIMAL(38,0)) * CAST({right} AS DECIMAL(38,0)))")
    two = ends(pairs).join(most, ["lang", "phrase"], "left").select("lang", "phrase", "f", F.struct(F.col("first").alias("l"), F.col("last").alias("r"), ratio("first", "last").alias("score")).alias("cut"), "most")
    joined = with_part(with_part(ends(triples), pairs, of(2, 2), "rest"), pairs, of(1, 2), "lead")
    cuts = [F.struct(F.col(x).alias("l"), F.col(y).alias("r"), ratio(x, y).alias("score")) for x, y in (("first", "rest"), ("lead", "last"))]
    three = joined.select("lang", "phrase", "f", F.when(cuts[0]["score"] <= cuts[1]["score"], cuts[0]).otherwise(cuts[1]).alias("cut"), F.lit(None).cast("long").alias("most"))
    return two.unionByName(three).join(totals, "lang").select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", "most")


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = MOST, shard_bytes: int = SHARD_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` candidates that no longer candidate holds half as often."""
    found = stored(scored(phrase_counts(docs, support, shard_bytes, most_bits)).where("most IS NULL OR 2 * most < a").drop("most"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language may hold nearly all: the first of each of its salts meet in one task
    salts = max(1, min(512, found.count() // 10_000))
    own = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
