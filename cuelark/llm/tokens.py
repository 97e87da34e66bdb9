"""Token ids in a file format coded by a static range asymmetric numeral system (rANS).

Steps:
 1. Texts are range-partitioned by (doc_id, hash of the text, row) into parts of about `part_bytes`, a task each, so the order of
    parts is the order of documents, and neither one doc_id nor one row that repeats makes a large part.
 2. A part is sorted, encoded by the tokenizers library and stored as 16-bit ids, or 32-bit ones where the vocabulary
    asks for them, with the token count before each document in the part. Tasks stream: no part is held.
 3. The ids of all documents are counted: one table of frequencies, scaled to 2^SCALE, shared by every block.
 4. Documents are packed into blocks of about BLOCK ids (whole documents), each coded on its own by
    LANES interleaved rANS states. A block holds its documents' ids, lengths and starts, a state checkpoint
    every STRIDE rounds, and the crc32 of its ids and of its payload, so blocks, and checkpoints
    inside a block, decode in parallel.
 5. `read_tokens` verifies both checksums and gives the ids back for each document; `read_documents` decodes
    the wanted documents alone, each from the last checkpoint before it.

Defined results: a null text counts as empty and gives the end id alone; texts of any length are
encoded whole; null doc_ids come first; repeated rows each have their own place, ordered by doc_id and then by
a hash of the text; an empty table gives no rows. Only `doc_id` and `text` are read. Where the tokenizer file states the rules that
PieceTable knows (checked when it is loaded), pieces between white space are encoded once and looked up after; any other
tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import drop_at_exit, shared_dir, stored

SCALE = 20
LANES = 4096
BLOCK = 1 << 20
STRIDE = 128
SLICE = 1 << 19  # bytes of text encoded at once
MOST_PARTS = 20_000
LOW = np.uint64(1 << 31)
END = 1

ENCODED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
BLOCKS = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("first", T.LongType()), ("doc_ids", T.ArrayType(T.LongType())), ("lengths", T.ArrayType(T.LongType())), ("start", T.LongType()), ("lanes", T.IntegerType()), ("states", T.BinaryType()), ("checkpoints", T.BinaryType()), ("payload", T.BinaryType()), ("ids_crc32", T.LongType()), ("payload_crc32", T.LongType()))])

_tables: dict[str, "PieceTable"] = {}
_TAIL = ",.!?;:*$%&#"
# The letters by which byte-level tokenizers name bytes, a byte itself where printable, else one from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_NAMES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


# The split of the tokenizer whose pieces stand alone.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SUM = np.random.Generator(np.random.PCG64(77)).integers(1, 2**62, 256, dtype=np.uint64)


def pieces_stand_alone(config: dict) -> bool:
    """Whether a tokenizer's file says that a text's ids are those of its pieces between white space in a row, as `_piece` makes them:
    NFC, white space to one space, lower case; the split above and byte names; BPE with word ends; no added token with rules of its own."""
    normal = (config.get("normalizer") or {}).get("normalizers") or []
    pre = (config.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = config.get("model") or {}
    return (
        [n.get("type") for n in normal] == ["NFC", "Replace", "Lowercase"]
        and (normal[1].get("pattern"), normal[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
        and (pre[0].get("pattern"), pre[0].get("behavior"), pre[0].get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and not pre[1].get("add_prefix_space")
        and not pre[1].get("use_regex")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix"))
        and not any(config.get(k) for k in ("truncation", "padding"))
        and not any(t.get(k) for t in config.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        and not any(c.isspace() for t in config.get("added_tokens") or [] for c in t["content"])
    )


class PieceTable:
    """Ids of the pieces met so far, by a 64-bit hash and a 64-bit sum of their bytes; kept in the Python worker over its tasks, MOST pieces at most.

    A piece is encoded once and looked up after that, for a whole batch at a time. Two pieces of one hash but other sums
    are encoded anew whenever they meet, so neither gets the other's ids."""

    MOST = 1_500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.alone = pieces_stand_alone(json.load(f))
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.clear()

    @property
    def width(self) -> int:
        """Bytes of a stored id."""
        return 2 if self.vocabulary <= 1 << 16 else 4

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.sums = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, f"<u{self.width}")
        self.used = 0
        self.stems: dict[str, list[int]] = {}

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), f"<u{self.width}", int(counts.sum())), counts

    def encode(self, s: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the slice's texts in a row, number of ids of each text)."""
        if not self.alone:
            raw = s.data.tobytes()
            return self.whole([raw[a:b].decode() for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)])
        words = W.hash_words(s)
        order = np.argsort(words.hashes)
        ranked = words.hashes[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        distinct, some = ranked[fresh], order[fresh]
        sums = W._sums(np.where(W._SPACE, np.uint64(0), _SUM)[s.data], words.starts) if len(words.starts) else words.hashes
        own = sums[some]
        if (sums[order] != own[np.cumsum(fresh) - 1]).any():  # two pieces of one hash in this batch
            raw = s.data.tobytes()
            return self.whole([raw[a:b].decode() for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)])
        if len(self.hashes) + len(distinct) > self.MOST:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        missing = np.ones(len(distinct), bool)
        if len(self.hashes):
            near = np.minimum(at, len(self.hashes) - 1)
            missing = self.hashes[near] != distinct
            if (~missing & (self.sums[near] != own)).any():
                self.clear()
                at, missing = np.zeros(len(distinct), np.int64), np.ones(len(distinct), bool)
        if missing.any():
            self._learn(s, words.starts[some[missing]], distinct[missing], own[missing], at[missing])
            at = np.searchsorted(self.hashes, distinct)
        place = np.empty(len(order), np.int64)
        place[order] = at[np.cumsum(fresh) - 1] if len(order) else at
        lengths = self.lengths[place].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        out = self.ids[np.repeat(self.starts[place] - (ends - lengths), lengths) + np.arange(total)]
        edges = np.concatenate([[0], ends])[words.bounds]
        return out, np.diff(edges)

    def _learn(self, s: W.Slice, starts: np.ndarray, hashes: np.ndarray, sums: np.ndarray, at: np.ndarray) -> None:
        spaces = np.flatnonzero(W._SPACE[s.data])
        next_space = np.concatenate([spaces, [len(s.data)]])[np.searchsorted(spaces, starts)]
        ends = np.minimum(next_space, s.offsets[np.searchsorted(s.offsets, starts, "right")])
        raw = s.data.tobytes()
        ids = [self._piece(raw[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), self.ids.dtype, int(lengths.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.hashes = np.insert(self.hashes, at, hashes)
        self.sums = np.insert(self.sums, at, sums)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(lengths) - lengths)
        self.lengths = np.insert(self.lengths, at, lengths)
        self.used += len(flat)

    def _piece(self, piece: str) -> list[int]:
        """Case does not count for this tokenizer, and marks after a letter are a pre-token of their own; so
        a piece of letters is its lower-case stem and its final marks, each one pre-token for the BPE model."""
        low = piece.lower()
        stem = low.rstrip(_TAIL)
        if not stem.isalpha() or "\u03a3" in piece or not unicodedata.is_normalized("NFC", piece):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        return self._pretoken(stem) + self._pretoken(low[len(stem) :]) if len(stem) < len(low) else self._pretoken(stem)

    def _pretoken(self, text: str) -> list[int]:
        ids = self.stems.get(text)
        if ids is None:
            if len(self.stems) > 50_000:
                self.stems.clear()
            named = text if text.isascii() else text.encode().decode("latin-1").translate(_NAMES)
            ids = self.stems[text] = [t.id for t in self.model.tokenize(named)]
        return ids


def table(path: str) -> PieceTable:
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def giving_back(run):
    """run, after which the memory that Arrow holds but no longer uses goes back: the Python worker stays, and with it what it holds, beside other stages' tasks."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return to_the_end


def encode_parts(path: str):
    """mapInArrow over a part's rows in order: ids as little-endian integers, and tokens before the document in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, before = table(path), TaskContext.get().partitionId(), 0
        for b in batches:
            for s in W.slices(b.column("text"), SLICE):
                own = b.slice(s.first, s.n)
                ids, counts = pieces.encode(s)
                ends = np.cumsum(counts + 1)
                coded = np.full(int(ends[-1]), END, f"<u{pieces.width}")
                body = np.ones(len(coded), bool)
                body[ends - 1] = False
                coded[body] = ids
                befores = before + ends - counts - 1
                before += int(ends[-1])
                offsets = np.concatenate([[0], pieces.width * ends]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), s.n, [None, pa.py_buffer(offsets), pa.py_buffer(coded.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(s.n, part, np.int32)), own.column("doc_id"), pa.array(befores), pa.array(counts + 1), binary], ["part", "doc_id", "before", "n_tokens", "ids"])

    return giving_back(run)


def count_ids(width: int, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each id in a partition: a row an id of the vocabulary at most."""
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            if b.num_rows:
                ids = b.column("ids")
                offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
                total += np.bincount(np.frombuffer(ids.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(f"<u{width}"), minlength=vocabulary)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "n"])

    return giving_back(run)


def scaled(counts: dict[int, int], vocabulary: int = 1 << 16) -> np.ndarray:
    """Frequencies that add up to 2^SCALE, at least 1 for every id that occurs."""
    freq = np.zeros(vocabulary, np.int64)
    if not counts:
        return freq
    ids, n = np.array(sorted(counts)), np.array([counts[i] for i in sorted(counts)], np.float64)
    f = np.maximum(1, np.floor(n / n.sum() * (1 << SCALE)).astype(np.int64))
    over = int(f.sum()) - (1 << SCALE)
    order = np.argsort(-f, kind="stable")
    while over:  # the largest give or take what rounding left over
        for i in order:
            step = min(over, f[i] // 2) if over > 0 else over
            f[i] -= step
            over -= step
            if not over:
                break
    freq[ids] = f
    return freq


class Rans:
    """Interleaved rANS with 64-bit states and 32-bit words; lane j codes ids j, j + lanes, ..."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint16 if len(freq) <= 1 << 16 else np.uint32)
        self.limit = self.freq << np.uint64(63 - SCALE)

    def encode(self, ids: np.ndarray) -> dict:
        lanes = max(1, min(LANES, len(ids)))
        rounds = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[bytes] = []
        written = 0
        freq, cum, limit = self.freq[ids], self.cum[ids], self.limit[ids]
        for r in range(rounds - 1, -1, -1):
            a, b = r * lanes, min(len(ids), (r + 1) * lanes)
            x, f = state[: b - a], freq[a:b]
            full = x >= limit[a:b]
            if full.any():
                words.append(x[full].astype("<u4")[::-1])
                written += len(words[-1])
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: b - a] = (q << np.uint64(SCALE)) + (x - q * f) + cum[a:b]
            if r and r % STRIDE == 0:
                marks.append(np.array([r, written], "<u8").tobytes() + state.astype("<u8").tobytes())
        # the reader takes words from the end, last written first
        payload = (np.concatenate(words) if words else np.zeros(0, "<u4")).tobytes()
        return {"lanes": lanes, "states": state.astype("<u8").tobytes(), "checkpoints": b"".join(marks), "payload": payload}

    def decode(self, n: int, lanes: int, states: bytes, payload: bytes, first: int = 0, rounds: int | None = None, words: int | None = None) -> np.ndarray:
        """Ids of `rounds` rounds from round `first`; states and the number of words left are a checkpoint's."""
        state = np.frombuffer(states, "<u8").astype(np.uint64)
        stream = np.frombuffer(payload, "<u4")
        at = len(stream) if words is None else words
        last = -(-n // lanes) if rounds is None else min(-(-n // lanes), first + rounds)
        out = np.empty(min(n, last * lanes) - first * lanes, self.symbol.dtype)
        mask, low = np.uint64((1 << SCALE) - 1), LOW
        for r in range(first, last):
            a, b = r * lanes, min(n, (r + 1) * lanes)
            x = state[: b - a]
            slot = x & mask
            s = self.symbol[slot]
            x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.cum[s]
            need = np.flatnonzero(x < low)
            if len(need):
                x[need] = (x[need] << np.uint64(32)) | stream[at - len(need) : at][::-1].astype(np.uint64)
                at -= len(need)
            state[: b - a] = x
            out[a - first * lanes : b - first * lanes] = s
        return out

    def checkpoints(self, lanes: int, marks: bytes) -> list[tuple[int, int, bytes]]:
        """(round, words left, states) in order of rounds."""
        size = 16 + 8 * lanes
        rows = [marks[i : i + size] for i in range(0, len(marks), size)]
        return sorted((int(h[0]), int(h[1]), row[16:]) for row in rows for h in [np.frombuffer(row[:16], "<u8")])


def encode_blocks(freq: np.ndarray, bases: dict[int, int], width: int = 2):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size, part = Rans(freq), [], 0, None

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(h[3] for h in held), f"<u{width}")
            row = coder.encode(ids) | {"part": part, "first": held[0][1], "doc_ids": [h[0] for h in held], "lengths": [h[2] for h in held], "start": bases[part] + held[0][1]}
            row |= {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "payload_crc32": zlib.crc32(row["payload"])}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("start", pa.int64()), ("lanes", pa.int32()), ("states", pa.binary()), ("checkpoints", pa.binary()), ("payload", pa.binary()), ("ids_crc32", pa.int64()), ("payload_crc32", pa.int64())]))

        for b in batches:
            rows = zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("before").to_pylist(), b.column("n_tokens").to_pylist(), b.column("ids").to_pylist(), strict=True)
            for p, doc, before, n, ids in rows:
                gap = held and before != held[-1][1] + held[-1][2]
                if held and (p != part or gap or size >= BLOCK):
                    yield block()
                    held, size = [], 0
                part = p
                held.append((doc, before, n, ids))
                size += n
        if held:
            yield block()

    return giving_back(run)


DECODED = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def decode_blocks(freq: np.ndarray, with_ids: bool = False):
    """Rows of a file's documents; a block whose checksums do not hold raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Rans(freq)
        for b in batches:
            for row in b.to_pylist():
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError(f"block at {row['start']}: its payload is damaged")
                lengths = np.array(row["lengths"], np.int64)
                ids = coder.decode(int(lengths.sum()), row["lanes"], row["states"], row["payload"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
                    raise ValueError(f"block at {row['start']}: its ids are damaged")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[e - n : e] for e, n in zip(ends, lengths, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return giving_back(run)


def decode_documents(freq: np.ndarray):
    """mapInArrow over blocks with `wanted`, places of documents: each is decoded from the last checkpoint before it; the payload's checksum is verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Rans(freq)
        for b in batches:
            for row in b.to_pylist():
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError(f"block at {row['start']}: its payload is damaged")
                ends, lanes = np.cumsum(row["lengths"]), row["lanes"]
                marks = coder.checkpoints(lanes, row["checkpoints"])
                for at in row["wanted"]:
                    lo, hi = int(ends[at]) - row["lengths"][at], int(ends[at])
                    first, left, states = max((m for m in marks if m[0] * lanes <= lo), default=(0, None, row["states"]), key=lambda m: m[0])
                    ids = coder.decode(int(ends[-1]), lanes, states, row["payload"], first, -(-hi // lanes) - first, left)[lo - first * lanes : hi - first * lanes]
                    yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_ids"][at], "start": row["start"] + lo, "ids": ids.tolist()}], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return giving_back(run)


def read_documents(spark, path: str, freq: np.ndarray, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the documents in doc_ids(doc_id), without decoding what comes before them but from a checkpoint on."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    places = blocks.select("start", F.posexplode("doc_ids").alias("at", "doc_id")).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    wanted = places.groupBy("start").agg(F.array_sort(F.collect_list("at")).alias("wanted"))  # documents of one block
    return blocks.join(wanted, "start").mapInArrow(decode_documents(freq), "doc_id long, start long, ids array<long>")


def write_tokens(docs: DataFrame, tokenizer: str, part_bytes: int = 32 << 20) -> tuple[str, np.ndarray]:
    """Encodes docs(doc_id, text) into a folder of blocks; returns (path, frequency table).

    Beyond MOST_PARTS parts they grow instead, and so do the tasks' times, not their memory."""
    spark, known = docs.sparkSession, table(tokenizer)
    width, vocabulary = known.width, max(known.vocabulary, END + 1)
    if vocabulary > 1 << SCALE:
        raise ValueError(f"{vocabulary} ids are more than the 2^{SCALE} slots of the frequency table")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-int(size) // part_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("place"), F.col("row")]
    placed = own.withColumns({"place": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    encoded = stored(dealt.mapInArrow(encode_parts(tokenizer), ENCODED))
    counted = encoded.select("ids").mapInArrow(count_ids(width, vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    freq = scaled({r["id"]: r["n"] for r in counted.collect()}, vocabulary)  # a row an id of the vocabulary
    sizes = {r["part"]: r["n"] for r in encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # MOST_PARTS rows at most
    bases, so_far = {}, 0
    for p in sorted(sizes):
        bases[p], so_far = so_far, so_far + sizes[p]
    path = shared_dir(spark)
    encoded.mapInArrow(encode_blocks(freq, bases, width), BLOCKS).write.option("compression", "none").parquet(path)
    drop_at_exit(spark, path)
    return path, freq


def read_tokens(spark, path: str, freq: np.ndarray) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(decode_blocks(freq), DECODED)
