"""Sharding: a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows fall into blocks by a hash of their values. How many rows each block
sends to each shard is drawn exactly as a uniform permutation would have it: a
binary tree over the blocks splits each node's shard counts between its two
halves by hypergeometric draws. Then each block permutes its rows locally,
deals them out by its counts, and each shard permutes what it received.
Everything is a DataFrame expression; only narrow rows (keys, not texts) move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldbook.llm.common import Scratch, hash_unit, let

#: Rows that a block or a part of a shard holds on average, at most.
BLOCK_ROWS = 1 << 17
#: Half-width of the drawn range in standard deviations; what lies beyond weighs less than a double can tell.
SIGMAS = 12


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `marked` among `total` are in a random draw of `drawn`, for a uniform number u.

    The weights run both ways from the mode by their exact ratios, so no
    factorials are needed; u picks from their running sum.
    """
    n, k, m = total.cast("double"), marked.cast("double"), drawn.cast("double")
    share = k / F.greatest(n, F.lit(1.0))
    given = F.struct(
        n.alias("n"),
        k.alias("k"),
        m.alias("m"),
        F.greatest(F.lit(0.0), m + k - n).alias("low"),
        F.least(m, k).alias("high"),
        (F.ceil(SIGMAS * F.sqrt(F.greatest(F.lit(1.0), m * share * (1 - share)))) + 30).alias("spread"),
    )
    return let(given, lambda g: let(F.least(g.high, F.greatest(g.low, F.floor((g.m + 1) * (g.k + 1) / (g.n + 2)).cast("double"))), lambda mode: _draw(g, mode, u)))


def _draw(g: Column, mode: Column, u: Column) -> Column:
    """The number that u picks from the weights around the mode."""
    up = lambda x: (g.k - x) * (g.m - x) / ((x + 1) * (g.n - g.k - g.m + x + 1))  # noqa: E731  weight of x+1 over that of x
    down = lambda x: x * (g.n - g.k - g.m + x) / ((g.k - x + 1) * (g.m - x + 1))  # noqa: E731  weight of x-1 over that of x

    def side(count: Column, ratio: Callable[[Column], Column], step: int) -> Column:
        start = F.array(F.struct(mode.alias("x"), F.lit(1.0).alias("w")))

        def push(acc: Column, _: Column) -> Column:
            return let(F.element_at(acc, -1), lambda end: F.array_append(acc, F.struct((end.x + step).alias("x"), (end.w * ratio(end.x)).alias("w"))))

        return F.when(count > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), count.cast("long")), start, push)).otherwise(start)

    below = side(F.least(mode - g.low, g.spread), down, -1)
    weights = F.concat(F.reverse(below), F.slice(side(F.least(g.high - mode, g.spread), up, 1), F.lit(2), F.lit(1 << 30)))

    def pick(w: Column) -> Column:
        goal = u * F.aggregate(w, F.lit(0.0), lambda a, x: a + x.w)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("hit"), goal.alias("goal"))
        run = F.aggregate(w, start, lambda a, x: F.struct((a["sum"] + x.w).alias("sum"), F.coalesce(a["hit"], F.when(a["sum"] + x.w >= a["goal"], x.x)).alias("hit"), a["goal"].alias("goal")), lambda a: a["hit"])
        return F.coalesce(run, F.element_at(w, -1).x).cast("long")

    return let(weights, pick)


def _split(seed: int) -> Callable[[Column, Column], Column]:
    """The step that draws one shard's count for a node's left half from what is left of the draw."""

    def step(acc: Column, s: Column) -> Column:
        marked = F.get(F.col("counts"), s)
        drawn = hypergeometric(acc.total, marked, acc.need, hash_unit("node", s, seed=seed))
        return let(F.struct(marked.alias("marked"), drawn.alias("drawn")), lambda x: F.struct((acc.total - x.marked).alias("total"), (acc.need - x.drawn).alias("need"), F.array_append(acc.out, x.drawn).alias("out")))

    return step


def matrix(blocks: DataFrame, rows: int, shards: int, levels: int, seed: int) -> DataFrame:
    """Rows (block, counts): how many rows of each block go to each shard, for 2**levels blocks.

    blocks: (block, n). The columns add up to shard sizes that differ by one at
    most, the rows to n. Each level of the tree splits all its nodes at once.
    """
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    spark = blocks.sparkSession
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.array(*[F.lit(x).cast("long") for x in sizes]).alias("counts"))
    for level in range(levels):
        shift = levels - level - 1
        left = blocks.where(F.shiftright("block", shift) % 2 == 0).groupBy(F.shiftright("block", shift + 1).alias("node")).agg(F.sum("n").alias("to_left"))
        nodes = nodes.join(left, "node", "left").withColumn("to_left", F.coalesce("to_left", F.lit(0).cast("long")))
        state = F.struct(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("to_left").alias("need"), F.array().cast("array<long>").alias("out"))

        nodes = nodes.withColumn("left", F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), state, _split(seed * 64 + level), lambda acc: acc.out))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")))
        nodes = nodes.select(F.explode(halves).alias("half")).select("half.node", "half.counts")
    return nodes.withColumnRenamed("node", "block")


def shuffle_shards(docs: DataFrame, shards: int = 24, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row's shard and slot: a uniform random permutation cut into shards whose row counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 8; a null text has
    none), text_crc32 (null for a null text), law ('rows'), shard, slot
    (gapless from 0 in its shard) and grown_shard (null: this law moves
    nothing). Only these columns of docs are used, so clashing extra columns
    don't matter. The result depends on the rows alone, not on partitions;
    wholly equal rows are interchangeable. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    keys = scratch.save("keys", docs.select("doc_id", size.alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32")))
    rows = keys.count()
    levels = max(3, (max(1, rows) // block_rows).bit_length())
    values = ("doc_id", "size", "text_crc32")
    cells = keys.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *values), F.lit(1 << levels)))
    counts = matrix(scratch.save("blocks", cells.groupBy("block").agg(F.count("*").alias("n"))), rows, shards, levels, seed)

    def to_ends(counts: Column) -> Column:
        zero = F.array().cast("array<long>")
        return F.aggregate(counts, zero, lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + x))

    ends = scratch.save("matrix", counts.withColumn("ends", to_ends(F.col("counts"))).drop("counts"))
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), *values), *values)
    dealt = cells.withColumn("rank", F.row_number().over(local)).join(ends, "block")
    shard = F.aggregate("ends", F.lit(0), lambda a, end: a + F.when(end < F.col("rank"), 1).otherwise(0))
    dealt = dealt.select(*values, shard.alias("shard"))
    # The second permutation: by a fresh hash, whose high bits choose a part of the shard so that no task sorts a whole one.
    parts = max(1, -(-rows // (shards * block_rows)))
    fresh = F.xxhash64(F.lit(seed + 2), *values)
    sent = scratch.save("sent", dealt.withColumn("part", F.floor(hash_unit(*values, seed=seed + 3) * parts).cast("int")))
    held = sent.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("shard", "part", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy(fresh, *values)) - 1
    return (
        sent.withColumn("within", within)
        .join(held, ["shard", "part"])
        .select(*values, F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
