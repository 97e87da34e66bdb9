"""Vector code compression: product codes by member-resident Lloyd rounds.

Components become integers, floor(SCALE * x); a vector is cut into PARTS equal parts, and each part position has a codebook of ENTRIES
entries that starts as that part of the vectors of least id. Members (a part and how often a batch holds it) live with the owner of
their cell (position, entry, salt). A round has two steps. Owners update: each task sums the members that are resident with it, and an entry
becomes the componentwise floor of sum over count; an entry without members stays. Then members are assigned anew where they lie: those that
keep their entry are written on in place, and only those that change it migrate, in the next shuffle, to their new owner.

Equal parts of a batch are one member with a count before anything is shuffled, and the salt deals an entry that holds any share of all members to
many owners, so no task grows with an entry. All arithmetic is on integers; codebooks (PARTS * ENTRIES entries) and their sums are
the only things on the driver. A generation of residents is a written table, complete before the one before it is dropped, so a lost executor costs
its running tasks only. The codes come from a last pass over the vectors, which shuffles nothing.

Defined results: vectors that are null or hold null or non-finite components are dropped. Vectors have one length: the commonest that
PARTS divides (the greater of equally common ones); those of other lengths are dropped. A null id is a row like any other, and last in order; rows
of equal ids are ordered by their components. Components are clipped to +-2^28 after scaling. With fewer vectors than ENTRIES the
codebook is as small; an empty table gives no rows. Null labels are one label. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_now, shared_dir, stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
CLIP = 1 << 28
OWNED = 200_000  # members an owner's task holds, about
FEW_LABELS = 100_000
MEMBER = "pos int, entry int, salt int, member binary, n long"
_MEMBER = pa.schema([("pos", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("member", pa.binary()), ("n", pa.int64())])


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least index of a nearest entry, squared distance) of each row of parts, exactly."""
    n, width = parts.shape
    at, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    top = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    small = 4 * top * top * max(1, width) < 1 << 53  # then doubles hold every sum exactly
    for lo in range(0, n, 4096):
        own = parts[lo : lo + 4096]
        if small:
            x, c = own.astype(np.float64), book.astype(np.float64)
            d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
            at[lo : lo + 4096] = k = d.argmin(1)
            least[lo : lo + 4096] = d[np.arange(len(own)), k].astype(np.int64)
        else:
            d = np.stack([((own - c) ** 2).sum(1) for c in book], axis=1)
            at[lo : lo + 4096] = k = d.argmin(1)
            least[lo : lo + 4096] = d[np.arange(len(own)), k]
    return at, least


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as rows of integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _members(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("member").to_pylist()), "<i4").reshape(batch.num_rows, width).astype(np.int64)


def deal(books: np.ndarray, salts: int):
    """mapInArrow over vectors: their parts as members of the nearest entries, equal ones of a batch as one."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            whole = matrix(b.column("q"), parts * width).astype("<i4")
            for p in range(parts):
                own = np.ascontiguousarray(whole[:, p * width : (p + 1) * width])
                keys = own.view(np.dtype((np.void, 4 * width))).ravel() if width else np.zeros(len(own), "V1")
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                entry, _ = nearest(own[first].astype(np.int64), books[p])
                # the place in the batch deals copies that other batches hold too
                salt = (own[first].astype(np.int64).sum(1) * 31 + first) % salts
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array([own[i].tobytes() for i in first], pa.binary()), pa.array(n)], schema=_MEMBER)

    return run


def resident_sums(width: int):
    """mapInArrow over an owner's residents: count and componentwise sum of each of its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy()
            weighted = np.concatenate([n[:, None], _members(b, width) * n[:, None]], axis=1)
            cell = b.column("pos").to_numpy().astype(np.int64) * ENTRIES + b.column("entry").to_numpy()
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            for c, s in zip(cell[order][starts].tolist(), np.add.reduceat(weighted[order], starts), strict=True):
                sums[divmod(c, ENTRIES)] = sums.get(divmod(c, ENTRIES), 0) + s
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], ["pos", "entry", "s"])

    return run


def reassign(books: np.ndarray):
    """mapInArrow over residents: their nearest entries now, and whether that is another one."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, entry = b.column("pos").to_numpy(), b.column("entry").to_numpy()
            fresh, parts = entry.copy(), _members(b, width)
            for p in np.unique(pos):
                fresh[pos == p] = nearest(parts[pos == p], books[p])[0]
            yield pa.RecordBatch.from_arrays([b.column("pos"), pa.array(fresh), *(b.column(c) for c in ("salt", "member", "n")), pa.array(fresh != entry)], [*_MEMBER.names, "moved"])

    return run


def codes(books: np.ndarray):
    """mapInArrow over vectors: code and error under the books."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = matrix(b.column("q"), parts * width)
            found = [nearest(whole[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            text = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            code = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    return run


class Residents:
    """Members by the owner of their cell, as tables in the shared folder."""

    def __init__(self, spark: SparkSession, books: np.ndarray, rows: int):
        self.spark, self.width = spark, books.shape[2]
        self.salts = max(16, -(-rows // (OWNED // 2)))
        self.owners = max(spark.sparkContext.defaultParallelism, -(-rows * PARTS // OWNED))
        self.paths: list[str] = []

    def settle(self, members: DataFrame) -> str:
        """Writes members to the owners of their cells: the one shuffle of a round."""
        path = shared_dir(self.spark)
        owner = F.pmod(F.xxhash64("pos", "entry", "salt"), F.lit(self.owners)).cast("int")
        members.withColumn("owner", owner).repartitionById(self.owners, F.col("owner")).drop("owner").write.option("compression", "zstd").parquet(path)
        return path

    def table(self) -> DataFrame:
        frames = [self.spark.read.schema(MEMBER + ", moved boolean").parquet(p).where("NOT coalesce(moved, false)").drop("moved") for p in self.paths]
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def updated(self, books: np.ndarray) -> np.ndarray:
        """Each entry as the floor of its residents' mean; entries without residents stay."""
        sums = self.table().mapInArrow(resident_sums(self.width), "pos int, entry int, s array<long>")
        total = sums.groupBy("pos", "entry").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(self.width + 1)])
        out = books.copy()
        for r in total.collect():  # PARTS * ENTRIES rows at most
            out[r[0], r[1]] = [x // r[2] for x in r[3:]]
        return out

    def migrate(self, books: np.ndarray) -> None:
        """Members that keep their entry are written on where they are read; the others go to their new owners."""
        stay, old = shared_dir(self.spark), self.paths
        self.table().mapInArrow(reassign(books), MEMBER + ", moved boolean").write.option("compression", "zstd").partitionBy("moved").parquet(stay)
        gone = self.spark.read.schema(MEMBER + ", moved boolean").parquet(stay).where("moved").drop("moved")
        self.paths = [stay, self.settle(gone)]
        self.drop(old)

    def drop(self, paths: list[str]) -> None:
        for p in paths:
            drop_now(self.spark, p)


def quantised(rows: DataFrame, vec: str, label: str, vec_id: str) -> DataFrame:
    """(vec_id, label, q) of the rows whose vector is whole; q holds the integers."""
    whole = F.coalesce(F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    scaled = F.transform(vec, lambda x: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.floor(F.greatest(F.lit(-1e18), F.least(F.lit(1e18), x.cast("double") * SCALE))))).cast("int"))
    own = stored(rows.where(whole).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), scaled.alias("q")))
    lengths = own.where(F.size("q") % PARTS == 0).groupBy(F.size("q").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    return own.where(F.size("q") == (lengths[0]["n"] if lengths else -1))


def train(own: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, entry, component] of quantised vectors after `rounds` rounds."""
    spark = own.sparkSession
    seeds = np.array([r["q"] for r in own.orderBy(F.asc_nulls_last("vec_id"), "q").limit(ENTRIES).select("q").collect()], np.int64)
    width = seeds.shape[1] // PARTS
    books = np.ascontiguousarray(seeds.reshape(len(seeds), PARTS, width).transpose(1, 0, 2))
    residents = Residents(spark, books, own.count())
    residents.paths = [residents.settle(own.mapInArrow(deal(books, residents.salts), MEMBER))]
    for k in range(rounds):
        if k:
            residents.migrate(books)
        books = residents.updated(books)
    residents.drop(residents.paths)
    return books


def compress(rows: DataFrame, vec: str = "embedding", label: str = "label", vec_id: str = "vec_id") -> tuple[np.ndarray | None, DataFrame]:
    """(codebooks, rows(vec_id, label, code, error, label_error, codebooks_sha256)) of whole vectors."""
    kind = lambda c: rows.schema[c].dataType.simpleString()
    own = quantised(rows, vec, label, vec_id)
    schema = f"vec_id {kind(vec_id)}, label {kind(label)}, code string, error long"
    if own.isEmpty():
        return None, rows.sparkSession.createDataFrame([], schema + ", label_error long, codebooks_sha256 string")
    books = train(own)
    coded = stored(own.mapInArrow(codes(books), schema))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if coded.select("label").distinct().count() <= FEW_LABELS:
        sums, salt = F.broadcast(sums.withColumn("salt", F.lit(0))), F.lit(0)
    else:  # a label may hold a third of the rows: each of its sums goes to 16 tasks
        sums, salt = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), F.pmod(F.xxhash64("vec_id", "code"), F.lit(16)).cast("int")
    sums = sums.select(F.col("label").alias("__label"), "salt", "label_error")
    joined = coded.withColumn("__salt", salt).join(sums, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("salt")))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return books, joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
