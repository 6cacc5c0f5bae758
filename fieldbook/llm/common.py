"""What the operators share: tables in the cluster's shared folder, and joins on hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES if they are larger: ten thousand whole texts are too many for a task to hold at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", spark.conf.get(name).lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def spread(table: DataFrame) -> DataFrame:
    """A table read from files, dealt out evenly where its scan has fewer tasks than there are cores, as that of one large row group has.

    Larger tables are left as they are. No job runs; the rows are the same, in
    another order.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


class Scratch:
    """Intermediate tables as Parquet in the folder that spark.checkpoint.dir names.

    Every executor can read them, so a lost executor costs no more than its own
    tasks. Where the setting is missing, a local session (tests) gets a
    temporary folder, and a cluster an error. The files go when the application
    ends, or earlier by drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        sc = spark.sparkContext
        root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if root is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="fieldbook-")
            sc.setCheckpointDir(root)
        self.spark, self.root = spark, f"{root}/fieldbook/{name}-{uuid.uuid4().hex}"
        self._fs(self.root, lambda fs, path: fs.deleteOnExit(path))

    def _fs(self, path: str, act) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        act(fs, jvm_path)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write df and read it back, which cuts its lineage; its size is known to later joins, so Spark broadcasts it only below its own threshold."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete saved tables that nothing reads any more."""
        for name in names:
            self._fs(f"{self.root}/{name}", lambda fs, path: fs.delete(path, True))


#: A key is hot if it holds more than one row in HOT, and more than LEAST rows; hence there are at most HOT hot keys.
HOT, LEAST = 4096, 512


def dealt_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "inner", n: str = "n", rows: int | None = None) -> DataFrame:
    """big joined with small on columns that are never null, without n; hot keys don't make one task do most of the work.

    small's column n says how many of big's rows have the key; rows is at most
    their sum, by default that of a saved small. The rows of a hot key are
    dealt out by `spread` (any long that follows from big's rows) to as many
    salts as it holds shares of a HOT-th of the rows, and small's rows are
    copied to each. Only the hot keys are broadcast.
    """
    if rows is None:
        rows = small.agg(F.sum(n)).first()[0] or 0
    share = max(LEAST, rows // HOT)
    if rows <= share:
        return big.join(small.drop(n), on, how)
    salts = F.ceil(F.col(n) / share).cast("int")
    hot = small.where(F.col(n) > share).select(*on, salts.alias("_salts")).distinct()
    left = big.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(n)
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hash_unit(*cols: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns' values alone."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of each node of links (a, b), both long: the least node that can be reached.

    Alternating stars: every node's larger neighbours are tied to its least
    one, then its smaller ones, until nothing changes. The links never become
    more, and each round is written to the shared folder.
    """

    def star(pairs: DataFrame, larger: bool, rows: int) -> DataFrame:
        both = pairs.select("a", "b").union(pairs.select("b", "a")) if larger else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).select("a", F.least("a", "least").alias("least"), "n")
        tied = dealt_join(both, least, ["a"], F.xxhash64("b"), rows=rows)  # the root of a large component is a hot key
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        if not larger:
            out = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
        return out.where("a <> b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    pairs, k = scratch.save("stars-0", links.where("a <> b")), 0
    before = mark(pairs)
    while True:
        pairs, k = scratch.save(f"stars-{k + 1}", star(star(pairs, True, before[0]), False, before[0])), k + 1
        scratch.drop(f"stars-{k - 1}")
        now = mark(pairs)
        if now == before:
            break
        before = now
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select("root").distinct().select(F.col("root").alias("node"), "root"))
