"""Exact top-k search by histograms of scores.

Every query is scored against every vector, block by block, once for each
pass. A pass counts each query's scores in BINS equal bins of the range that
holds its k-th best score; the counts of all blocks together tell the bin, and
the next pass looks into that alone, until it is a single score. A last pass
keeps what scores more, and of equal scores those of the smallest ids. Blocks
send no more than the bins that their own k best scores fall in, for the k-th
best of all is no less than the k-th best of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldbook.llm.common import Scratch

BITS = 8
BINS = 1 << BITS
#: Vectors and queries of a block, on average.
BLOCK_ROWS = 2048
BLOCK_QUERIES = 1024
#: Queries that are scored at once.
SCORED = 128
SCALE = 64
#: Components and scores beyond it count as it.
MOST = 1 << 61
#: Partitions at most; more pairs of blocks share them.
PARTS = 20_000
#: Whole numbers up to here, and their sums and products, are exact as doubles.
EXACT = 1 << 53


def whole_parts(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, with x as double."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * float(scale)))))


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of rows that take part, as whole numbers."""
    fine = vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return fine.where(finite).select("vec_id", whole_parts(F.col("embedding"), scale).alias("v"))


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length."""
    lengths, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    return [(at := np.flatnonzero(lengths == n), flat[starts[at][:, None] + np.arange(n)]) for n in np.unique(lengths)]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly, up to MOST; the shorter side counts as filled up with zeros."""
    n = min(q.shape[1], x.shape[1])
    q, x = q[:, :n], x[:, :n]
    most = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (q, x)]
    if most[0] * most[1] * n < EXACT:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, -MOST, MOST).astype(np.int64)


class Block:
    """The vectors of one block, whose queries arrive in pieces."""

    def __init__(self):
        self.held: list[pa.RecordBatch] = []
        self.ready = None

    def scores(self, ids: np.ndarray, q: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of queries, ids of vectors, scores); a query's own vector has a score of less than -MOST."""
        if self.ready is None:
            whole = pa.Table.from_batches(self.held).combine_chunks()
            own = whole.column("vec_id").to_numpy()
            self.ready = [(own[at], x) for at, x in by_length(whole.column("v").combine_chunks())]
            self.held = []
        ordered = np.concatenate([i for i, _ in self.ready])
        for places, rows in by_length(q):
            for lo in range(0, len(rows), SCORED):
                at = places[lo : lo + SCORED]
                found = np.concatenate([products(rows[lo : lo + SCORED], x) for _, x in self.ready], 1)
                found[ids[at][:, None] == ordered] = -MOST - 1
                yield at, ordered, found


def counted(scores: np.ndarray, low: np.ndarray, span: np.ndarray, k: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, n) of each row's bins over its range (low, span), from the highest down to where k scores are reached."""
    # No score of a query but its own vector's is under -MOST; what lies over the range has been counted by an earlier pass.
    row, place = np.nonzero((scores >= np.maximum(low, -MOST)[:, None]) & (scores < (low + span)[:, None]))
    at = (scores[row, place] - low[row]) // -(-span // bins)[row]
    n = np.bincount(row * bins + at, minlength=len(scores) * bins).reshape(len(scores), bins)
    over = np.cumsum(n[:, ::-1], 1)[:, ::-1] - n
    row, place = np.nonzero((n > 0) & (over < k))
    return row, place, n[row, place]


def chosen(ids: np.ndarray, scores: np.ndarray, kth: int, ties: int) -> np.ndarray:
    """Places of the scores over the k-th best, and of the smallest ids of so many equal ones."""
    over, equal = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
    if len(equal) > ties:
        equal = equal[np.argsort(ids[equal], kind="stable")[:ties]]
    return np.concatenate([over, equal])


def met(rows: DataFrame, queries: DataFrame, blocks: int, groups: int, made, schema: str) -> DataFrame:
    """made(Block, ids, vectors, low, span, above) for each block and each batch of queries that meet it.

    Vectors are copied to each group of queries and queries to each block, so
    a pair of both is one task's work at most.
    """
    left = rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(False).alias("asks"), "vec_id", "v", *[F.lit(0).cast("long").alias(n) for n in ("low", "span", "above")])
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "group", F.lit(True).alias("asks"), "vec_id", "v", "low", "span", "above")
    together = left.unionByName(right).repartition(min(blocks * groups, PARTS), "block", "group").sortWithinPartitions("block", "group", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block = None, None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (0, 1, 2)])
            edges = np.flatnonzero((np.diff(keys) != 0).any(0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                if (keys[0, a], keys[1, a]) != pair:
                    pair, block = (keys[0, a], keys[1, a]), Block()
                piece = batch.slice(a, b - a)
                if not keys[2, a]:
                    block.held.append(piece.select(["vec_id", "v"]))
                elif block.held or block.ready:
                    yield from made(block, piece.column("vec_id").to_numpy(), piece.column("v"), *[piece.column(n).to_numpy() for n in ("low", "span", "above")])

    return together.mapInArrow(run, schema)


def record(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def top(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each vec_id that `every` divides.

    Components x count as floor(scale * x), a score is their inner product, a
    whole number, and ties go to the smaller vec_id. Vectors that are null, or
    hold null or non-finite components, and rows without a vec_id take no
    part. Every row is a candidate, repeated ones too, but those of the
    query's own vec_id; if a vec_id has several vectors, the least, as an
    array, is the query. Of vectors of different lengths the shorter one
    counts as filled up with zeros. Components and scores beyond 2^61 count as
    that. With fewer than k candidates all are returned. Other columns are not
    read, and an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    # A number of its own deals each row to a block: repeated ids weigh no more than others.
    rows = scratch.save("rows", usable(vectors, scale).withColumn("row", F.monotonically_increasing_id()))
    count, most = rows.agg(F.count("*"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0)))).first()
    blocks = max(1, -(-count // BLOCK_ROWS))
    rows = scratch.save("blocks", rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = scratch.save("asked", asked)
    groups = max(1, -(-asked.count() // BLOCK_QUERIES))
    # No score is larger than the sum of a query's components times the largest of all.
    reach = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)) * float(most or 0)
    reach = F.ceil(F.least(F.lit(float(MOST)), reach * (1 + 1e-9) + 1))
    asked = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"), (-reach).alias("low"), (2 * reach + 1).alias("span"), F.lit(0).cast("long").alias("above"))
    state = scratch.save("state-0", asked.withColumn("known", F.lit(False)))

    def histogram(block: Block, ids, q, low, span, above) -> Iterator[pa.RecordBatch]:
        for at, _, scores in block.scores(ids, q):
            row, place, n = counted(scores, low[at], span[at], k, BINS)
            yield record(query_id=ids[at][row], bin=place.astype(np.int32), n=n.astype(np.int64))

    def matches(block: Block, ids, q, low, span, above) -> Iterator[pa.RecordBatch]:
        for at, own, scores in block.scores(ids, q):
            best = [chosen(own, s, kth, max(0, k - over)) for s, kth, over in zip(scores, low[at], above[at], strict=True)]
            sizes = [len(b) for b in best]
            row, place = np.repeat(np.arange(len(at)), sizes), np.concatenate(best)
            yield record(query_id=ids[at][row], vec_id=own[place], score=scores[row, place])

    done = 0
    while state.where(~F.col("known")).take(1):
        counts = met(rows, state.where(~F.col("known")), blocks, groups, histogram, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        bins = counts.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
        state, done = scratch.save(f"state-{done + 1}", narrowed(state, bins, k)), done + 1
        scratch.drop(f"state-{done - 1}")
    found = met(rows, state, blocks, groups, matches, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def narrowed(state: DataFrame, bins: DataFrame, k: int) -> DataFrame:
    """Each query's range after a pass: the bin of its k-th best score, or of its last one if it has fewer."""
    step = "struct<bin:int,over:bigint,n:bigint>"
    start = F.struct(F.lit(None).cast("int").alias("bin"), F.col("above").alias("over"), F.lit(0).cast("long").alias("n")).cast(step)
    # From the highest bin down; over counts the scores above the bin.
    down = F.aggregate("bins", start, lambda s, b: F.when(s["over"] + s["n"] >= k, s).otherwise(F.struct(b["bin"].alias("bin"), (s["over"] + s["n"]).alias("over"), b["n"].alias("n"))).cast(step))
    out = state.join(bins, state.vec_id == bins.query_id, "left").withColumn("at", down)
    moved = F.col("at.bin").isNotNull()
    # A query without candidates is done.
    width = F.shiftright(F.col("span") + BINS - 1, BITS)
    known = F.col("known") | F.col("bins").isNull() | (width == 1)
    return out.select(
        "vec_id", "v", "group",
        F.when(moved, F.col("low") + F.col("at.bin") * width).otherwise(F.col("low")).alias("low"),
        width.alias("span"),
        F.when(moved, F.col("at.over")).otherwise(F.col("above")).alias("above"),
        known.alias("known"),
    )
