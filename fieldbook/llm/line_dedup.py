"""Line dedup: runs of lines that occur earlier are removed, found by winnowing over line hashes.

Of every window of `lines` neighbouring line hashes the least (the last of
equals) is a fingerprint, so a run of that many lines that occurs twice is
sure to have the same fingerprint in both places. Fingerprints that occur more
than once are joined back to their places and extended both ways, by all
windows of the run length around them that selected them. A window whose
content starts earlier in the order of (doc_id, line) marks its lines, and
neighbouring windows join to runs. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import Scratch, dealt_join

LINES = 2
LONG_WORDS = 50
#: Columns that are joined to docs for a while.
GONE, DOC, HASH = "_line_dedup_gone", "_line_dedup_doc", "_line_dedup_hash"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def fingerprints(docs: DataFrame, lines: int = LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text_hash, mark, runs): each winnowed line's hash, and the windows around it that selected it.

    A run is a struct of its first line, its number of lines and its content's
    hash. A line of long_words words or more is a run by itself.
    """
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.trim(x))
    line = F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1 >= long_words).alias("long")))
    base = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), line.alias("line"))
    last = F.size("line") - lines  # the last window's start
    hashes = F.col("line.h")

    def chosen(start: Column) -> Column:
        """The place of the window's least hash, the last of equals."""
        return -F.array_min(F.transform(F.sequence(start, start + lines - 1), lambda p: F.struct(F.get(hashes, p).alias("h"), (-p).alias("back")))).back

    base = base.withColumn("chosen", F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), chosen)).otherwise(F.array().cast("array<int>")))

    def run(start: Column, n: int) -> Column:
        return F.struct(start.alias("start"), F.lit(n).alias("n"), F.xxhash64(F.slice(hashes, start + 1, n)).alias("content"))

    def around(place: Column) -> Column:
        """What lies both ways of a fingerprint: the windows that chose it."""
        reach = F.sequence(F.greatest(F.lit(0), place - lines + 1), F.least(place, last))
        return F.struct(F.get(hashes, place).alias("mark"), F.transform(F.filter(reach, lambda s: F.get("chosen", s) == place), lambda s: run(s, lines)).alias("runs"))

    alone = F.filter(F.transform("line", lambda x, i: F.struct(x.long.alias("long"), i.alias("i"))), lambda x: x.long)
    entries = F.concat(
        F.transform(F.array_distinct("chosen"), around),
        F.transform(alone, lambda x: F.struct(F.get(hashes, x.i).alias("mark"), F.array(run(x.i, 1)).alias("runs"))),
    )
    return base.select("doc_id", "text_hash", F.explode(entries).alias("e")).select("doc_id", "text_hash", "e.mark", "e.runs")


def repeated_runs(docs: DataFrame, lines: int = LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text_hash, start, n) of each run of n lines whose content starts earlier."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    marked = scratch.save("marked", fingerprints(docs, lines, long_words))
    often = scratch.save("often", marked.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1"))
    # Common lines are hot keys, of marks and of contents.
    near = dealt_join(marked, often, ["mark"], F.monotonically_increasing_id())
    near = near.select("doc_id", "text_hash", F.explode("runs").alias("run")).select("doc_id", "text_hash", "run.start", F.col("run.n").alias("lines"), "run.content")
    near = scratch.save("near", near)
    scratch.drop("marked", "often")
    place = F.struct("doc_id", "text_hash", "start")
    first = near.groupBy("content", "lines").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.count("*").alias("n")).where("first < final").drop("final")
    later = dealt_join(near, scratch.save("first", first), ["content", "lines"], F.monotonically_increasing_id())
    return later.where(place > F.col("first")).select("doc_id", "text_hash", "start", F.col("lines").alias("n"))


def remove_repeated_lines(docs: DataFrame, lines: int = LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with later repeats of runs of lines removed from text.

    A run is `lines` neighbouring lines, or one line of long_words words or
    more. Added: n_lines, n_removed (both int) and spans (array of structs of
    the first line, counted from 0, and the number of lines of each removed
    stretch); columns of these names are replaced. The first occurrence of a
    run, in the order of (doc_id, a hash of the text, line), always stays,
    within one document as well. Lines are compared without outer spaces and
    kept as they are. A null text stays null, with 0 lines; an empty text has
    one empty line. Repeated rows of equal doc_id and text count as one
    document and are treated alike. A null doc_id comes first in order. Extra
    columns are kept.
    """
    docs = docs.drop("n_lines", "n_removed", "spans")
    found = repeated_runs(docs.select("doc_id", "text"), lines, long_words)
    cover = F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("n") - 1))))
    gone = found.groupBy("doc_id", "text_hash").agg(F.array_sort(cover).alias(GONE)).select(F.col("doc_id").alias(DOC), F.col("text_hash").alias(HASH), GONE)
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(DOC)) & (F.xxhash64("text") == F.col(HASH)), "left").drop(DOC, HASH)
    all_lines = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), GONE)
    kept = F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")
    start = F.array_except(GONE, F.transform(GONE, lambda x: x + 1))
    stop = F.array_except(GONE, F.transform(GONE, lambda x: x - 1))
    none = F.col(GONE).isNull()
    spans = F.when(none, F.array().cast("array<struct<start:int,lines:int>>")).otherwise(F.zip_with(start, stop, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("lines"))))
    return joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)),
            "n_removed": F.when(none, 0).otherwise(F.size(GONE)),
            "spans": spans,
            "text": F.when(none, F.col("text")).otherwise(kept),
        }
    ).drop(GONE)
