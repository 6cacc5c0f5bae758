"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Vectors of length one are projected on Gaussian directions and cut into cells;
a bucket is the tuple of a table's cells. A query visits its own bucket and
those that its distances to the cell walls make likeliest to hold neighbours,
in the order of an estimated success score. How many cells a table has and how
many buckets are visited is set by a bounded sample of queries whose true
neighbours are known from a full scan: of the settings that find enough of
these, the one that compares the fewest rows. Buckets and visits meet in parts
of bounded size, where cosines are computed in double precision, and each
query's best of all parts are merged. Queries that the index cannot serve are
compared with all rows, part by part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldbook.llm.bytehash import mix
from fieldbook.llm.common import Scratch

TABLES = 8
#: Width of a cell in standard deviations of a projection.
WIDTH = 2.0
#: Cells of a table among which the fit chooses. Two of them have nine buckets around a query, so that some setting always finds nearly all.
CELLS = (2, 4, 6, 8, 12, 16)
#: Visits of a query to each table that the fit looks at.
MOST_PROBES = 2048
#: The fit: so many sampled queries, the share of their neighbours that must be found, and so many sampled rows that tell how many are compared.
FIT_QUERIES = 128
FIT_RECALL = 0.96
FIT_ROWS = 2048
#: Index rows that a part holds on average, and the rows from which a bucket is dealt out over several parts.
PART_ROWS = 40_000
HEAVY_ROWS = 20_000
#: Queries that are compared with a part's rows at once where all rows count.
BLOCK = 64


@dataclass
class Index:
    """Directions (tables, dimension, cells), offsets (tables, cells) and the visiting order."""

    directions: np.ndarray
    offsets: np.ndarray
    template: np.ndarray
    probes: int = 1
    #: The share of all rows that a query is compared with, as the fit saw it.
    share: float = 1.0

    def cells(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells of unit vectors in a table, and how far into them they lie (0 to 1)."""
        at = (x @ self.directions[t] + self.offsets[t]) / WIDTH
        low = np.floor(at)
        return low.astype(np.int64), at - low

    def visits(self, x: np.ndarray, t: int, probes: int) -> np.ndarray:
        """The cells (query, visit, cell) that each query visits, likeliest first."""
        low, inside = self.cells(x, t)
        m = low.shape[1]
        order = np.argsort(np.concatenate([inside, 1 - inside], 1), axis=1)
        step = np.where(order < m, -1, 1)
        moves = np.zeros((len(x), 2 * m, m), np.int64)
        np.put_along_axis(moves, (order % m)[:, :, None], step[:, :, None], 2)
        return low[:, None, :] + np.einsum("vj,qjm->qvm", self.template[:probes].astype(np.int64), moves)

    def keys(self, cells: np.ndarray, t: int) -> np.ndarray:
        """64-bit names of buckets."""
        turn = mix(np.arange(1, cells.shape[-1] + 1, dtype=np.uint64) + np.uint64(1000 * t)) | np.uint64(1)
        return mix((cells.astype(np.uint64) * turn).sum(-1) + np.uint64(t)).view(np.int64)


def template(cells: int, most: int) -> np.ndarray:
    """Sets of walls to cross, by rank of their distance, in the order of the expected sum of squared distances."""
    j = np.arange(1, cells + 1)
    near = j * (j + 1) / (4 * (cells + 1) * (cells + 2))
    far = (1 - j / (cells + 1) + j * (j + 1) / (4 * (cells + 1) * (cells + 2)))[::-1]
    z = np.concatenate([near, far])
    out, heap = [()], [(z[0], (0,))]
    while heap and len(out) < most:
        score, walls = heapq.heappop(heap)
        if all(2 * cells - 1 - w not in walls for w in walls):
            out.append(walls)
        last = walls[-1]
        if last + 1 < 2 * cells:
            heapq.heappush(heap, (score - z[last] + z[last + 1], (*walls[:-1], last + 1)))
            heapq.heappush(heap, (score + z[last + 1], (*walls, last + 1)))
    sets = np.zeros((len(out), 2 * cells), bool)
    for k, walls in enumerate(out):
        sets[k, list(walls)] = True
    return sets


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1, so that no square leaves the range of doubles; cosines stay as they are."""
    _, exponent = np.frexp(np.abs(x).max(1, keepdims=True))
    return np.ldexp(x, -exponent)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosine of each row with q; a row's bits don't depend on the other rows."""
    x, q = scaled(x), scaled(q[None])[0]
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows that take part; of different lengths, only the most frequent one (of equals, the longest). Floats stay floats, all else becomes doubles."""
    own = vectors.schema["embedding"].dataType.simpleString()
    fine = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(own if own == "array<float>" else "array<double>")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    fine = fine.where(F.forall("embedding", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0))
    sizes = fine.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return fine.where(F.size("embedding") == (sizes.n if sizes else 0))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


FOUND = "query_id long, vec_id long, score double"


def found_batch(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    query = np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in rows] or [np.empty(0, np.int64)])
    ids = np.concatenate([i for _, i, _ in rows] or [np.empty(0, np.int64)])
    scores = np.concatenate([s for *_, s in rows] or [np.empty(0)])
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def scan(vectors: DataFrame, queries: list, k: int) -> DataFrame:
    """FOUND: of each task's vectors the k nearest to each of a bounded list of queries (vec_id, embedding)."""
    ids = np.array([q.vec_id for q in queries], np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, np.array([q.embedding for q in queries], float)))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = shared.value
        q = unit(q)
        held: list[tuple] = [(np.empty(0, np.int64), np.empty(0))] * len(query_ids)
        for batch in batches:
            if batch.num_rows:
                own, s = batch.column(0).to_numpy(), q @ unit(matrix(batch.column(1))).T
                for n in range(len(query_ids)):
                    i, c = np.concatenate([held[n][0], own]), np.concatenate([held[n][1], s[n]])
                    at = best(i, c, k)
                    held[n] = (i[at], c[at])
        yield found_batch([(int(query_ids[n]), *held[n]) for n in range(len(query_ids))])

    return vectors.select("vec_id", "embedding").mapInArrow(made, FOUND)


def first_visit(index: Index, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each query of x and row of y the first visit that meets the row in any table; MOST_PROBES where none does."""
    out = np.full((len(x), len(y)), MOST_PROBES)
    for t in range(TABLES):
        goal = index.keys(index.cells(y, t)[0], t)
        for n in range(len(x)):  # one query's visits at a time bounds memory
            keys = index.keys(index.visits(x[n : n + 1], t, MOST_PROBES)[0], t)
            order = np.argsort(keys, kind="stable")
            at = np.minimum(np.searchsorted(keys[order], goal), len(keys) - 1)
            out[n] = np.minimum(out[n], np.where(keys[order][at] == goal, order[at], MOST_PROBES))
    return out


def fit(first: DataFrame, count: int, queries: DataFrame, k: int, seed: int = 11) -> Index | None:
    """Of the indexes that find FIT_RECALL of the neighbours of FIT_QUERIES sampled queries, the one that compares the fewest rows.

    The samples are those of least hash. None if no index finds as many.
    """
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_QUERIES).collect()
    rows = first.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(FIT_ROWS).collect()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = scan(first, sample, k + 1).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1).join(first, "vec_id").collect()
    place = {q.vec_id: n for n, q in enumerate(sample)}
    true = [r for r in true if r.embedding != sample[place[r.query_id]].embedding]
    dimension = len(sample[0].embedding)
    x, some = (unit(np.array([r.embedding for r in rs], float)) for rs in (sample, rows))
    y = unit(np.array([r.embedding for r in true], float)) if true else np.empty((0, dimension))
    owner = np.array([place[r.query_id] for r in true], int)
    best_index, least = None, math.inf
    for cells in CELLS:
        rng = np.random.default_rng(seed)
        index = Index(rng.normal(size=(TABLES, dimension, cells)), rng.uniform(0, WIDTH, (TABLES, cells)), template(cells, MOST_PROBES))
        visit = np.concatenate([first_visit(index, x[n : n + 1], y[owner == n])[0] for n in range(len(x))])
        need = int(np.sort(visit)[max(0, math.ceil(FIT_RECALL * len(visit)) - 1)]) if len(visit) else 0
        if need >= MOST_PROBES:
            break  # with more cells, more visits would be needed
        index.probes = min(need + 1, len(index.template))
        index.share = float((first_visit(index, x, some) < index.probes).mean())
        cost = index.share * count + TABLES * index.probes
        if cost >= least:
            break
        best_index, least = index, cost
    return best_index


def bucketed(vectors: DataFrame, index: Index) -> DataFrame:
    """(bucket, vec_id, embedding): one row for each table."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(1)))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(ix.keys(ix.cells(x, t)[0], t)), *batch.columns], names=["bucket", "vec_id", "embedding"])

    return vectors.select("vec_id", "embedding").mapInArrow(made, f"bucket long, vec_id long, embedding {vectors.schema['embedding'].dataType.simpleString()}")


def visited(queries: DataFrame, index: Index) -> DataFrame:
    """(bucket, query_id): every bucket that a query visits."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        rows = max(1, (1 << 21) // (ix.probes * 2 * ix.offsets.shape[1]))
        for batch in batches:
            x = unit(matrix(batch.column(1))) if batch.num_rows else np.empty((0, 1))
            ids = batch.column(0).to_numpy()
            for lo in range(0, len(x), rows):
                for t in range(TABLES):
                    keys = ix.keys(ix.visits(x[lo : lo + rows], t, ix.probes), t)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[lo : lo + rows], keys.shape[1]))], names=["bucket", "query_id"])

    return queries.select("vec_id", "embedding").mapInArrow(made, "bucket long, query_id long")


def reranked(rows: DataFrame, k: int) -> DataFrame:
    """FOUND: the k nearest of each query in each part, among the visited buckets, or among all rows where visits are null.

    Rows are sorted by part, vectors before queries.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready = None, [], None

        def laid() -> tuple:
            bucket = np.concatenate([b for b, _, _ in held])
            ids, at, row = np.unique(np.concatenate([i for _, i, _ in held]), return_index=True, return_inverse=True)
            x = np.concatenate([v for *_, v in held])[at]
            order = np.argsort(bucket, kind="stable")
            return bucket[order], row[order], ids, x, unit(x)

        def nearest_of(query: int, q: np.ndarray, got: np.ndarray, rough: np.ndarray) -> tuple:
            """The k nearest of rows `got`, whose cosines are known up to rounding."""
            _, _, ids, x, _ = ready
            if len(got) > k:
                got = got[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
            s = cosines(x[got], q)
            at = best(ids[got], s, k)
            return query, ids[got][at], s[at]

        for batch in batches:
            parts, query = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(parts) != 0) | (np.diff(query) != 0)) + 1
            out = []
            for a, b in zip([0, *edges], [*edges, len(parts)], strict=True):
                if a == b:
                    continue
                if parts[a] != part:
                    part, held, ready = parts[a], [], None
                block = batch.slice(a, b - a)
                ids, x = block.column(3).to_numpy(), matrix(block.column(4))
                if not query[a]:
                    held.append((block.column(2).to_numpy(zero_copy_only=False).astype(np.int64), ids, x))
                    continue
                if not held:
                    continue
                ready = ready or laid()
                bucket, row, _, _, units = ready
                visits = block.column(5)
                if visits.null_count:
                    everything = np.arange(len(units))
                    for lo in range(0, len(ids), BLOCK):
                        rough = unit(x[lo : lo + BLOCK]) @ units.T
                        out += [nearest_of(int(ids[lo + n]), x[lo + n], everything, rough[n]) for n in range(len(rough))]
                    continue
                ends = visits.offsets.to_numpy()
                ends, flat = ends - ends[0], visits.flatten().to_numpy()
                q = unit(x)
                for n in range(len(ids)):
                    v = flat[ends[n] : ends[n + 1]]
                    lo, hi = np.searchsorted(bucket, v), np.searchsorted(bucket, v, "right")
                    got = np.unique(row[np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())])
                    if len(got):
                        out.append(nearest_of(int(ids[n]), x[n], got, units[got] @ q[n]))
            yield found_batch(out)

    return rows.mapInArrow(made, FOUND)


def everywhere(first: DataFrame, queries: DataFrame, parts: int, k: int) -> DataFrame:
    """FOUND: the k nearest of a few queries in each part of all rows."""
    left = first.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("is_query"), F.lit(0).cast("long").alias("bucket"), "vec_id", "embedding", F.lit(None).cast("array<long>").alias("visits"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("is_query"), F.lit(None).cast("long").alias("bucket"), "vec_id", "embedding", F.lit(None).cast("array<long>").alias("visits"))
    return reranked(left.unionByName(right).repartition(parts, "part").sortWithinPartitions("part", "is_query"), k)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each vec_id that `every` divides.

    Nearness is the cosine of the original vectors in double precision, ties go
    to the smaller vec_id, and a query is never its own neighbour. A query for
    which the index finds fewer than k is compared with all rows, as all are if
    no index finds enough. Vectors that are null, zero or of another length
    than most, or that hold null or non-finite components, take no part. Of
    exact copies one stands for all in the index; each is returned as a
    neighbour in its turn. Repeated rows of equal vec_id and vector count once;
    of different vectors of one vec_id each is a candidate, and the least, as
    an array, the query. Only vec_id and embedding are read. Without usable
    rows the result is empty.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = scratch.save("rows", usable(vectors).withColumn("same", F.xxhash64("embedding")).withColumn("also", F.xxhash64(F.lit(3), "embedding")))
    # Of each class of copies, its k + 1 least ids can matter.
    w = Window.partitionBy("same", "also").orderBy("vec_id")
    least = rows.select("same", "also", "vec_id").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    classes = least.groupBy("same", "also").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.save("classes", classes.withColumn("class", F.monotonically_increasing_id()))
    first = rows.join(classes.select("same", "also", F.col("first").alias("vec_id"), "class"), ["same", "also", "vec_id"]).select(F.col("class").alias("vec_id"), "embedding").dropDuplicates(["vec_id"])
    first = scratch.save("first", first)
    count = first.count()
    queries = scratch.save("queries", rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    if not queries.take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(first, count, queries, k)
    names = classes.select(F.col("class").alias("vec_id"), "ids")

    def ranked(pairs: DataFrame) -> DataFrame:
        """The k nearest ids of each query, from the classes found."""
        best_of = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        each = best_of.join(names, "vec_id").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
        each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    parts = max(1, -(-count // PART_ROWS))
    if index is None:
        return ranked(everywhere(first, queries, parts, k + 1))
    result = scratch.save("result", ranked(probed(first, queries, index, count, k + 1, scratch)))
    enough = result.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = scratch.save("short", queries.join(enough, "vec_id", "left_anti"))
    if not short.take(1):
        return result
    rest = ranked(everywhere(first, short, parts, k + 1))
    return result.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def probed(first: DataFrame, queries: DataFrame, index: Index, count: int, k: int, scratch: Scratch) -> DataFrame:
    """FOUND: the k nearest of each query in each part of the index."""
    parts = max(1, -(-count * TABLES // PART_ROWS))
    placed = scratch.save("placed", bucketed(first, index))
    heavy = scratch.save("heavy", placed.groupBy("bucket").count().where(F.col("count") > HEAVY_ROWS).select("bucket", F.ceil(F.col("count") / HEAVY_ROWS).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))

    def part(salt):
        return F.pmod(F.xxhash64("bucket", salt), F.lit(parts)).cast("int").alias("part")

    left = placed.join(heavy, "bucket", "left").select(part(F.pmod(F.xxhash64("vec_id"), salts).cast("int")), F.lit(0).alias("is_query"), "bucket", "vec_id", "embedding", F.lit(None).cast("array<long>").alias("visits"))
    visits = visited(queries, index).join(heavy, "bucket", "left").select("bucket", "query_id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    visits = visits.select(part(F.col("salt")), "bucket", F.col("query_id").alias("vec_id")).groupBy("part", "vec_id").agg(F.collect_set("bucket").alias("visits"))
    right = visits.join(queries, "vec_id").select("part", F.lit(1).alias("is_query"), F.lit(None).cast("long").alias("bucket"), "vec_id", "embedding", "visits")
    together = left.unionByName(right).repartition(parts, "part").sortWithinPartitions("part", "is_query")
    return scratch.save("found", reranked(together, k))
