"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes: first over shards, then over cells of about `bucket_bytes`
within a shard, as many as the shard's size asks for. The hash is of the record (doc_id and text) and of its number among equal records, so a row that repeats is
spread like any other, and the same rows give the same shards and slots however the input is split. Pass two reads a cell at a time, Fisher-Yates
shuffles it with a generator seeded by (seed, shard, cell), and writes it into its shard's folder. The order within a shard is then
uniform over its records. A task takes one cell, or where there are more cells than MOST_TASKS several in turn, and holds one of them.

The shard of a record depends only on its doc_id and the number of shards (law
`key`): every shard draws a hash for the record, the highest wins. A further shard can
only win records for itself, so growing by one moves nothing between old shards.

Defined results: a null text has size 1 and the crc of no bytes; an empty text the
same; a null doc_id is a key like any other; repeated rows get a slot each (equal
doc_ids share a shard); an empty table gives no rows. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_at_exit, shared_dir, stored, with_maybe

MOST_TASKS = 20_000
SENT = 1_000  # rows of a batch that leaves a cell
COPIES = 10_000  # of one record that one task makes


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Highest-random-weight choice among `shards`."""
    draws = F.array(*[F.struct(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed), F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(shards)])
    return F.array_max(draws)["s"]


def shuffle_cells(seed: int, names: list[str]):
    """mapInArrow over a task's rows, which come cell by cell: each cell's rows in the order of a seeded Fisher-Yates exchange, with their place `at`."""

    def shuffled(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        order = pc.sort_indices(own, [(c, "ascending") for c in ("doc_id", "text_crc32", "size", "h1", "h2", "copy")]).to_numpy()
        at = np.arange(own.num_rows)
        # Generator.shuffle is the Fisher-Yates exchange over the sorted rows, so reruns agree
        np.random.Generator(np.random.PCG64([seed, own.column("shard")[0].as_py(), own.column("bucket")[0].as_py()])).shuffle(at)
        own = own.select(names)
        for lo in range(0, own.num_rows, SENT):
            some = own.take(pa.array(order[at[lo : lo + SENT]]))
            yield from some.append_column("at", pa.array(np.arange(lo, lo + some.num_rows, dtype=np.int64))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_cell = [], None
        for b in batches:
            cells = b.column("cell").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if hi == lo:
                    continue
                if held and cells[lo] != open_cell:
                    yield from shuffled(held)  # empties held
                open_cell = cells[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from shuffled(held)

    return run


def numbered_copies(own: DataFrame, keys: DataFrame) -> DataFrame:
    """own with `copy`: 0 to n - 1 over n equal records, which are records of equal (h1, h2); keys has these of all rows.

    Equal records are interchangeable, so one stands for all and is multiplied again: no task sees all of them."""
    repeated = stored(keys.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    if repeated.isEmpty():
        return own.withColumn("copy", F.lit(0).cast("long"))
    flagged = with_maybe(own, "h1", repeated.select("h1").distinct(), "__maybe")
    maybe = flagged.where("__maybe").drop("__maybe")
    single = flagged.where("NOT __maybe").drop("__maybe").unionByName(maybe.join(repeated, ["h1", "h2"], "left_anti")).withColumn("copy", F.lit(0).cast("long"))
    one = maybe.join(repeated, ["h1", "h2"]).groupBy("h1", "h2").agg(*[F.any_value(F.struct(c))[c].alias(c) for c in [*[c for c in own.columns if c not in ("h1", "h2")], "n"]])
    runs = one.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition("h1", "h2", "__from")
    many = runs.withColumn("copy", F.explode(F.sequence("__from", F.least(F.col("__from") + COPIES, F.col("n")) - 1))).drop("n", "__from")
    return single.unionByName(many)


def two_pass_shuffle(docs: DataFrame, shards: int = 8, seed: int = 7, bucket_bytes: int = 32 << 20) -> tuple[str, DataFrame]:
    """Writes docs(doc_id, text) as shard=.../ folders; returns (path, rows read back with their slot)."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    record = lambda k: F.xxhash64(F.lit(seed + k), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias(f"h{k}")
    keys = stored(docs.select(record(1), record(2), size.alias("size"), shard_of(F.col("doc_id"), shards, seed).alias("shard")))
    sizes = {r["shard"]: r["n"] for r in keys.groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a row a shard
    number = [max(1, -(-int(sizes.get(s, 0)) // bucket_bytes)) for s in range(shards)]
    first = [sum(number[:s]) for s in range(shards)]
    own = docs.select("doc_id", "text", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), record(1), record(2))
    own = numbered_copies(own, keys.select("h1", "h2")).withColumns({"shard": shard_of(F.col("doc_id"), shards, seed), "grown_shard": shard_of(F.col("doc_id"), shards + 1, seed)})
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)
    own = own.withColumn("bucket", F.pmod(F.xxhash64("h1", "h2", "copy"), of(number)).cast("int"))
    out = [c for c in own.columns if c not in ("h1", "h2", "copy")]
    schema = T.StructType([*(f for f in own.schema.fields if f.name in out), T.StructField("at", T.LongType())])
    path, tasks = shared_dir(spark), min(sum(number), MOST_TASKS)
    cells = own.withColumn("cell", (of(first) + F.col("bucket")).cast("int")).repartitionById(tasks, F.col("cell") % tasks)
    cells = cells if tasks == sum(number) else cells.sortWithinPartitions("cell")
    cells.mapInArrow(shuffle_cells(seed, out), schema).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    drop_at_exit(spark, path)
    back = spark.read.schema(schema).parquet(path)
    counts = back.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # buckets of a shard: as many rows as the corpus has buckets, not records
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    return path, back.join(before, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("at")).drop("before", "at")
