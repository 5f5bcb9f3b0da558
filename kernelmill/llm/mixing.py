"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, small_batches, written

#: Blocks of a source: one for this many rows, at most so many. A block at the border is cut in one of 2^RANGE_BITS ranges of its order.
BLOCK_ROWS, MOST_BLOCKS, RANGE_BITS = 64, 4096, 12
#: Tables of sources and of blocks are broadcast up to so many rows, which are counted; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Source groups whose quotas the driver splits; the sources of a group are split in a task of its own.
GROUPS = 64


def _source_key(c: Column) -> Column:
    """Sorts by code point with null last, and tells null from any string."""
    return F.coalesce(F.concat(F.lit("0"), c), F.lit("1"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds the 0-based rank by key: ranks within sorted partitions, moved on by the sizes of those before."""
    parts = max(1, min(200, sources.count() // 20_000))
    dealt = written(sources.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = {r[0]: r[1] for r in dealt.groupBy("part").count().collect()}
    first, moved = 0, []
    for p in sorted(counts):
        moved += [F.lit(p), F.lit(first)]
        first += counts[p]
    if not moved:
        return dealt.withColumn("rank", F.lit(0).cast("long")).drop("part")
    own = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return dealt.withColumn("rank", (own + F.element_at(F.create_map(*moved), F.col("part"))).cast("long")).drop("part")


def source_targets(
    sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(key, source_size, rows, target) from rows (key, size).

    Sources take the weights in turn by key order. Targets share `share` times all sizes by weight; one
    that would pass `most` times its source's size stops there, and the excess is shared again by weight
    among the others until none is above. Only two sums a round reach the driver, however many sources.
    """
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranked = _ranked(sources)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("w", w), "mix-ranked")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    rate, below = 0.0, None
    while True:  # rate only rises, and with it the set of the sources that stop
        stop = F.col("source_size") * most < F.lit(rate) * F.col("w")
        full, free, n = ranked.agg(
            F.sum(F.when(stop, F.col("source_size") * most).otherwise(0.0)),
            F.sum(F.when(stop, 0.0).otherwise(F.col("w"))),
            F.sum(F.when(stop, 0).otherwise(1)),
        ).first()
        if not free or n == below:
            break
        rate, below = (share * total - full) / free, n
    return ranked.withColumn("target", F.least(F.col("source_size") * F.lit(most), F.lit(rate) * F.col("w"))).drop("rank")


def split_tree(colours: np.ndarray, capacities: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """[shards, colours] counts with these row and column sums, drawn as if items were dealt at random.

    Halves the shards again and again; what goes to the left half is one multivariate-hypergeometric draw.
    """
    if len(capacities) == 1:
        return colours[None, :].copy()
    half = len(capacities) // 2
    left = rng.multivariate_hypergeometric(colours, int(capacities[:half].sum()), method="marginals")
    return np.concatenate(
        [split_tree(left, capacities[:half], rng), split_tree(colours - left, capacities[half:], rng)]
    )


def _quotas(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(key, shard, first, last): the range of each source's permuted blocks that goes to each output shard."""
    grouped = blocks.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int"))
    sums = np.zeros(GROUPS, np.int64)
    for r in grouped.groupBy("g").agg(F.sum("taken_blocks").alias("n")).collect():
        sums[r["g"]] = r["n"]
    total = int(sums.sum())
    even = np.array([total * (i + 1) // shards - total * i // shards for i in range(shards)], np.int64)
    of_group = split_tree(sums, even, np.random.default_rng(seed))  # [shard, group]

    def split(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        table = table.sort_by("key")
        q = split_tree(table["taken_blocks"].to_numpy(), of_group[:, g], np.random.default_rng([seed, g]))
        last = q.cumsum(axis=0)
        n = len(table)
        return pa.table(
            {
                "key": pa.concat_arrays([table["key"].combine_chunks()] * shards),
                "shard": np.repeat(np.arange(shards, dtype=np.int32), n),
                "first": (last - q).reshape(-1),
                "last": last.reshape(-1),
            }
        )

    return grouped.groupBy("g").applyInArrow(split, "key string, shard int, first long, last long").where("first < last")


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    order: str = "doc_id",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    shards: int = 16,
    seed: int = 0,
    carry: list[str] | None = None,
) -> DataFrame:
    """Struct `row` (the carried columns), size, source_size, target, taken, places.

    size: words of the text; taken: words that the mix takes, repeats counted; places: the output shard
    and the sort key in it of each copy, and the words taken of it. Every source is cut into blocks by hash. Whole blocks are taken in
    a random order, once for each full pass and then until the target is reached; the block at the border
    is taken row by row, its last row only as far as the target needs. A splitting tree of
    multivariate-hypergeometric draws fixes how many of a source's blocks each shard gets; the shards
    get disjoint ranges of the permuted blocks and shuffle them by the sort key. Reruns agree.

    A null text has size 0, a null source is a source of its own, sorted last; rows with equal order
    values, source and size are interchangeable. An empty table gives an empty result. The texts
    are shuffled only with more than BROADCAST_ROWS blocks, and then by (source, block), so no key is hot.
    """
    small_batches(docs.sparkSession)
    kept = docs.columns if carry is None else list(carry)
    u = lambda *c: F.xxhash64(*c, F.lit(seed))
    full = docs.select(
        F.struct(*[docs[c] for c in kept]).alias("row"),
        _source_key(docs[source]).alias("key"),
        F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        u(docs[order].cast("string"), docs[source]).alias("h"),
    )
    # Sizes are counted again when the rows themselves are dealt: cheaper than keeping the texts twice.
    sized = written(full.select("key", "size", "h"), "mix-sized")
    targets = written(source_targets(sized, weights, share, most), "mix-targets").withColumn(
        "n_blocks", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.col("rows").cast("long") / BLOCK_ROWS)).cast("long")
    )
    # A row's block follows from its hash alone once the source's number of blocks is known.
    block = F.pmod(F.shiftrightunsigned("h", 20), F.col("n_blocks"))
    few = targets.count() <= BROADCAST_ROWS
    deal = lambda rows: rows.join(F.broadcast(targets) if few else targets, "key").withColumn("block", block)
    sums = deal(sized).groupBy("key", "block").agg(F.sum("size").alias("words"))
    by_source = Window.partitionBy("key").orderBy(u("key", "block"), "block")
    blocks = sums.join(targets, "key").select(
        "key",
        "block",
        "words",
        (F.floor("target") - F.floor(F.floor("target") / F.greatest("source_size", F.lit(1))) * F.col("source_size")).alias("rest"),
        F.floor(F.floor("target") / F.greatest("source_size", F.lit(1))).alias("passes"),
        (F.sum("words").over(by_source.rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
    )
    before = F.coalesce("before", F.lit(0))
    blocks = blocks.select(
        "key",
        "block",
        "passes",
        F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - before)).alias("more"),
        "words",
    )
    copies = F.col("passes") + (F.col("more") > 0).cast("long")
    blocks = written(blocks.withColumn("copies", copies), "mix-blocks")
    placed = (
        blocks.where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(u("key", "block", "copy"), "block", "copy")) - 1)
    )
    quotas = _quotas(blocks.groupBy("key").agg(F.sum("copies").alias("taken_blocks")), shards, seed)
    placed = placed.join(quotas, "key").where("at >= first and at < last")
    where = placed.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("shards"))
    whole = blocks.withColumn("border", (F.col("more") > 0) & (F.col("more") < F.col("words")))
    plan = written(whole.join(where, ["key", "block"], "left"), "mix-plan")
    # Where a border block is cut is found on slim rows: by the sums of ranges of its order first, so that only the rows of one range need a running sum.
    place = F.shiftright(u("h"), 64 - RANGE_BITS)
    slim = deal(sized).join(whole.where("border").select("key", "block", "more"), ["key", "block"])
    sums = slim.groupBy("key", "block", "more", place.alias("cut")).agg(F.sum("size").alias("words"))
    earlier = F.coalesce(F.sum("words").over(Window.partitionBy("key", "block").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = sums.withColumn("rest", F.col("more") - earlier).where("rest > 0 and rest <= words").select("key", "block", "cut", "rest")
    plan = written(plan.join(cuts, ["key", "block"], "left"), "mix-cuts")
    rows = deal(full).join(F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan, ["key", "block"])
    inside = Window.partitionBy("key", "block").orderBy(u("h"), "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    cols = ["row", "h", "size", "source_size", "target", "passes", "shards"]
    at_cut = F.col("border") & (place == F.col("cut"))
    taken_whole = F.when(F.col("border"), place < F.col("cut")).otherwise(F.col("more") > 0)
    full = rows.where(~at_cut | at_cut.isNull()).select(*cols, F.when(taken_whole, F.col("size")).otherwise(F.lit(0)).alias("extra"))
    part = rows.where(at_cut).select(
        *cols,
        F.greatest(
            F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
        ).alias("extra"),
    )
    both = full.unionByName(part)
    taken = F.col("passes") * F.col("size") + F.col("extra")
    n = F.col("passes") + (F.col("extra") > 0).cast("long")
    return both.select(
        "row",
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        F.transform(
            F.filter(F.coalesce("shards", F.array().cast("array<struct<copy:bigint,shard:int>>")), lambda s: s["copy"] <= n),
            lambda s: F.struct(
                s["shard"].alias("shard"), u("h", s["copy"]).alias("sort_key"), F.when(s["copy"] <= F.col("passes"), F.col("size")).otherwise(F.col("extra")).alias("words")
            ),
        ).alias("places"),
    )


def write_shards(mixed: DataFrame, path: str, files: int = 200) -> None:
    """The output shards of a mix as Parquet in folders by shard, each shuffled: a row for each copy that the mix takes, in the order of its
    sort key, with the carried columns as struct `row`, the words taken of it and the sort key. A shard is dealt by ranges of the sort key,
    so it may be of any size; a mix that takes nothing writes no rows."""
    rows = mixed.select("row", F.explode("places").alias("p")).select("row", "p.shard", "p.sort_key", "p.words")
    dealt = rows.repartitionByRange(files, "shard", "sort_key").sortWithinPartitions("shard", "sort_key")
    dealt.write.partitionBy("shard").parquet(path)
