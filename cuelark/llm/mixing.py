"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame functions are used. Words are counted once; what follows works on a stored table of keys and sizes, without texts.

Targets come from weights by water-filling below `epochs` times a source's size. A seeded hash of the content puts
each document into one of its source's blocks; there are about `blocks` in all, shared out by size, and more where a block
would pass BLOCK_WORDS or BLOCK_ROWS, so a block's work does not grow with the corpus. Whole epochs take every block. The
last, partial epoch draws blocks in permuted order, then documents of the block on the edge, in permuted order too, until the
target is nearest.

The drawn blocks are dealt to `shards` by a binary tree: at each node a uniform permutation
of the node's blocks is cut in proportion, so the numbers of blocks of each source
on the left follow the multivariate hypergeometric law and add up to the quotas exactly.
A shard holds its blocks in permuted order, and the documents of each block's copy are shuffled locally: their places are
row numbers by a hash of the copy. So every copy has a slot in its shard, gapless from 0.

What is windowed in one task is the table of sources, the blocks of a source, the drawn blocks of a node of the tree, and the
keys of one block; a hot source is spread over its blocks before it is shuffled.

Defined results: a null text has size 0; so has an empty one (taken with its block, at no
cost); a null source is a source of its own, last in order; repeated rows are documents of
their own, and a repeated or null doc_id changes nothing, as blocks go by content; an empty table gives no rows; columns of the caller
travel inside a struct and results are in one struct, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (3.0, 1.0, 2.0)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*cols) -> Column:
    """A hash in [0, 2^52)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 12)


def source_targets(sizes: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes(source, source_size) with `target` added.

    Water-filling in closed form: sort sources by size over weight; those below the level are full. The
    level is the largest that the source it starts from can use; one pass of running sums finds it.
    The table has one row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("__k", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(epochs)))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__k")
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    # the level if this source and all after it were the ones not full
    ranked = ranked.withColumn("__level", (budget - full) / left)
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level"))
    ranked = ranked.withColumn("__final", F.max(fits).over(everything))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__final") * F.col("__w"), F.col("__cap")))
    return ranked.select(*sizes.columns, target.alias("target"))


BLOCK_WORDS = 1 << 26
BLOCK_ROWS = 1 << 20
_BLOCK = ["__null", "__src", "__block"]


def permuted(*names, seed: int) -> list[Column]:
    """An order by seeded hash, ties by the names themselves."""
    return [F.xxhash64(*names, F.lit(seed)), *map(F.col, names)]


def mix(docs: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[float, ...] = WEIGHTS, shards: int = 8, blocks: int = 4096, seed: int = 11, name: str = "mix", columns: list[str] | None = None) -> DataFrame:
    """docs with the struct `mix` added: size, source_size, target, copies, taken, shards and slots (one of each a copy); of docs only `columns` if they are named."""
    kept = docs.columns if columns is None else columns
    body = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("__doc")
    sized = stored(docs.select(body, n_words(F.col("text")).alias("__size"), F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__src"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("__key"), F.monotonically_increasing_id().alias("__row")))
    targets = block_numbers(sized, share, epochs, weights, blocks)
    place = F.floor(unit("__key", F.lit(seed)) / F.lit(float(1 << 52)) * F.col("__number")).cast("int")
    keys = sized.join(targets, ["__null", "__src"]).select("__row", "__key", "__size", "__null", "__src", "__full", "__rest", place.alias("__block"))
    totals = keys.groupBy(*_BLOCK).agg(F.sum("__size").alias("__words"), F.count("*").alias("__n"), F.max("__full").alias("__full"), F.max("__rest").alias("__rest"))
    drawn = Window.partitionBy("__null", "__src").orderBy(*permuted("__src", "__block", seed=seed + 1))
    before = F.coalesce(F.sum("__words").over(drawn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # `__left`: what the partial epoch may still take when it comes to this block
    totals = stored(totals.withColumn("__left", F.col("__rest") - before).drop("__rest"))
    part = (F.col("__left") > 0) & (F.col("__left") < F.col("__words"))
    inside = Window.partitionBy(*_BLOCK).orderBy(*permuted("__key", "__row", seed=seed + 3))
    so_far = F.coalesce(F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a document of the block on the edge is drawn if more than half of it lies before the target
    edge = keys.join(totals.where(part).select(*_BLOCK, "__left"), _BLOCK).withColumn("__more", so_far + F.col("__size") / 2 < F.col("__left"))
    edge = stored(edge.select("__row", "__key", *_BLOCK, "__full", "__more"))
    some = edge.groupBy(*_BLOCK).agg(F.count_if("__more").alias("__some"))
    whole = keys.join(totals.where(~part).select(*_BLOCK, (F.col("__left") > 0).alias("__more")), _BLOCK).select(*edge.columns)
    number = F.col("__full") + F.col("__more").cast("int")
    copies = whole.unionByName(edge).where(number > 0).select("__row", "__key", *_BLOCK, F.explode(F.sequence(F.lit(0), number - 1)).alias("__epoch"))
    # a block's copy of the partial epoch holds its drawn documents, the others hold all
    held = totals.join(some, _BLOCK, "left").select(*_BLOCK, "__full", "__n", F.coalesce("__some", "__n").alias("__some"))
    dealt = deal_blocks(totals, shards, seed).join(held, _BLOCK).withColumn("__held", F.when(F.col("__epoch") < F.col("__full"), F.col("__n")).otherwise(F.col("__some")))
    by_shard = Window.partitionBy("__shard").orderBy(*permuted("__src", "__null", "__block", "__epoch", seed=seed + 5))
    dealt = dealt.select(*_BLOCK, "__epoch", "__shard", F.coalesce(F.sum("__held").over(by_shard.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    local = Window.partitionBy(*_BLOCK, "__epoch").orderBy(F.xxhash64("__key", "__epoch", F.lit(seed + 4)), "__key", "__row")
    placed = copies.withColumn("__at", F.row_number().over(local) - 1).join(dealt, [*_BLOCK, "__epoch"]).select("__row", "__epoch", "__shard", (F.col("__offset") + F.col("__at")).alias("__slot"))
    mine = placed.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__epoch", "__shard", "__slot"))).alias("__copies"))  # epochs + 1 at most
    out = sized.join(targets.select("__null", "__src", "__source_size", "__target"), ["__null", "__src"]).join(mine, "__row", "left")
    got = F.coalesce("__copies", F.array().cast("array<struct<__epoch:int,__shard:int,__slot:bigint>>"))
    result = F.struct(F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.size(got).alias("copies"), (F.size(got) * F.col("__size")).alias("taken"), F.transform(got, lambda x: x["__shard"]).alias("shards"), F.transform(got, lambda x: x["__slot"]).alias("slots"))
    return out.select(*[F.col(f"__doc.c{i}").alias(c) for i, c in enumerate(kept)], result.alias(name))


def block_numbers(sized: DataFrame, share: float, epochs: float, weights: tuple[float, ...], blocks: int) -> DataFrame:
    """A row a source: its size, target, number of blocks, whole epochs, and what the partial epoch draws."""
    sources = stored(sized.groupBy("__null", "__src").agg(F.sum("__size").alias("source_size"), F.count("*").alias("__rows")))
    targets = source_targets(sources.select(F.when(~F.col("__null"), F.col("__src")).alias("source"), "source_size", "__rows"), share, epochs, weights)
    total = F.greatest(F.sum("source_size").over(Window.partitionBy()), F.lit(1))
    number = F.greatest(F.lit(1), F.ceil(F.col("source_size") * blocks / total), F.ceil(F.col("source_size") / BLOCK_WORDS), F.ceil(F.col("__rows") / BLOCK_ROWS))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    rest = F.greatest(F.lit(0.0), F.col("target") - full * F.col("source_size"))
    return stored(targets.select(F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__src"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), number.cast("int").alias("__number"), full.alias("__full"), rest.alias("__rest")))


def deal_blocks(totals: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, block, epoch, shard) of each drawn copy of a block of totals(.., __full, __left)."""
    number = F.col("__full") + (F.col("__left") > 0).cast("int")
    drawn = totals.where(number > 0).select(*_BLOCK, F.explode(F.sequence(F.lit(0), number - 1)).alias("__epoch"))
    drawn = drawn.withColumns({"__lo": F.lit(0), "__hi": F.lit(shards)})
    for level in range(max(0, shards - 1).bit_length()):
        node = Window.partitionBy("__lo", "__hi")
        place = F.row_number().over(node.orderBy(*permuted("__src", "__null", "__block", "__epoch", seed=seed + 10 + level)))
        middle = F.floor((F.col("__lo") + F.col("__hi")) / 2).cast("int")
        share = (middle - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
        left = place <= F.floor(F.count("*").over(node) * share + 0.5)
        drawn = drawn.select(*_BLOCK, "__epoch", "__lo", "__hi", middle.alias("__mid"), left.alias("__to_left"))
        split = F.col("__hi") - F.col("__lo") > 1
        drawn = drawn.select(*_BLOCK, "__epoch", F.when(split & ~F.col("__to_left"), F.col("__mid")).otherwise(F.col("__lo")).alias("__lo"), F.when(split & F.col("__to_left"), F.col("__mid")).otherwise(F.col("__hi")).alias("__hi"))
    return drawn.select(*_BLOCK, "__epoch", F.col("__lo").alias("__shard"))


def mixed(docs: DataFrame, seed: int = 11, **how) -> DataFrame:
    """(doc: struct of the columns of docs, shard, slot): one row for each copy taken."""
    rows = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "source"), seed=seed, columns=["doc"], **how)
    return rows.select("doc", F.explode(F.arrays_zip("mix.shards", "mix.slots")).alias("at")).select("doc", F.col("at.shards").alias("shard"), F.col("at.slots").alias("slot"))
