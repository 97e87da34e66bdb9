"""Reading, shared scratch tables and small helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import drop_at_exit, drop_now, settled, shared_dir, stored

__all__ = ["WORD", "crc_mod", "drop_at_exit", "drop_now", "maybe_in", "read", "row_hash", "settled", "shared_dir", "stored", "with_maybe"]

#: White space of the word definition: [^\x20\x09-\x0D]+ is a word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame) -> list:
    """Columns h1 and h2: 128 bits that name a row's content. Map columns, which have no hash, count by their sorted entries."""
    of = lambda f: F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
    parts = [x for f in df.schema.fields for x in (of(f), F.col(f"`{f.name}`").isNull())]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]


def crc_mod(col, n: int):
    """crc32 of a value's text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


def maybe_in(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows whose `column` may be among keys(`column`): none that is gets lost, few that are not stay. An exact join must follow."""
    return with_maybe(rows, column, keys, "__maybe").where("__maybe").drop("__maybe")


def with_maybe(rows: DataFrame, column: str, keys: DataFrame, name: str, most_bits: int = 1 << 26) -> DataFrame:
    """rows with a boolean `name`: false where `column` is certainly not among keys(`column`).

    A Bloom filter of one hash, as a table of 64-bit words that is joined by broadcast. It has `most_bits`
    bits at most (8 MB of words), whatever the number of keys, so the broadcast is bounded; with more
    keys than that it only prunes less."""
    n = keys.count()
    bits = min(most_bits, max(1 << 12, 1 << (16 * n).bit_length()))
    h = F.pmod(F.xxhash64(column, F.lit(99)), F.lit(bits))
    word, bit = F.shiftright(h, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`, 99), {bits}) % 64 as int))")
    words = keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    out = rows.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(words), "__word", "left")
    return out.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))).drop("__word", "__bit", "__bits")
