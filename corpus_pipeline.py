"""A corpus for training: five stages, each over all that the one before it kept.

Quality classifier, line dedup, n-gram Jaccard join, mixing to target weights,
and packing. Every stage but the last returns the columns of documents; the
last returns the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm import jaccard_join, line_dedup, mixing, packing, quality_classifier
from fieldbook.llm.common import Scratch
from fieldbook.llm.queries import table, tokenizer_path

#: Documents that score less are rejected.
LEAST_SCORE = 0.3
#: Near duplicates: shingles of so many words, and a similarity of 80 in 100 or more.
WORDS, SIMILAR, OF = 5, 80, 100
#: Shares of sources, languages and topics go with this power of their tokens.
POWER = 0.7


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is LEAST_SCORE or more; null and empty texts are scored too."""
    scored = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= LEAST_SCORE).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occur earlier; one of which no line is left goes, and n_chars follows the text."""
    out = line_dedup.remove_repeated_lines(docs)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id.

    Rows of one doc_id are one document if their texts are equal, and several
    if not. Rows without a doc_id come last in the order; those of them without
    words all stay.
    """
    scratch = Scratch(spark, "near-copies")
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs.join(_later(docs, scratch), "doc_id", "left_anti").select(*docs.columns)
    # Else a key for each doc_id and text, in the order of doc_id.
    hashes = {"_same": F.xxhash64("text"), "_also": F.xxhash64(F.lit(3), "text")}
    own = docs.withColumns(hashes)
    keys = own.select("doc_id", *hashes).distinct().orderBy(F.asc_nulls_last("doc_id"), *hashes).withColumn("_key", F.monotonically_increasing_id())
    keys = scratch.save("keys", keys.toDF("_id", "_a", "_b", "_key"))
    equal = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_same") == F.col("_a")) & (F.col("_also") == F.col("_b"))
    keyed = own.join(keys, equal)
    keyed = scratch.save("keyed", keyed.select(*docs.columns, "_key"))
    later = _later(keyed.select(F.col("_key").alias("doc_id"), "text"), scratch)
    kept = keyed.join(later.withColumnRenamed("doc_id", "_key"), "_key", "left_anti")
    free = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(~free).dropDuplicates(["_key"]).unionByName(kept.where(free)).select(*docs.columns)


def _later(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The doc_id of each document that is a near copy of one with a lesser doc_id."""
    linked = scratch.save("linked", jaccard_join.link_documents(docs, WORDS, SIMILAR, OF))
    return scratch.save("later", linked.where("doc_id <> component_id").select("doc_id").distinct())


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have tempered shares; no document is drawn twice."""
    topics = mixing.with_topic(docs, table(spark, sf_dir, "embeddings"))
    out = mixing.mix(topics, {n: F.col(n) for n in ("source", "lang", "topic")}, power=POWER)
    return out.where("sampled").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their ids."""
    return packing.pack_documents(docs, tokenizer_path(), keep_ids=True)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Scores, drawn samples and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return docs
