"""Joins between the notebook's tables; every one is by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldbook.sources.notebook import LOCKED_LABELS


def first_by_id(table: DataFrame) -> DataFrame:
    """One row for each id: the first in the order of seq, else of the table's other columns."""
    rest = [c for c in table.columns if c not in ("id", "seq")]
    row = F.struct(*(["seq"] if "seq" in table.columns else []), *rest)
    return table.groupBy("id").agg(F.min(row).alias("row")).select("id", "row.*").select(*table.columns)


def breadcrumbs(entries: DataFrame, experiments: DataFrame, projects: DataFrame) -> DataFrame:
    """entries with project_title and experiment_title, null where there is none; of rows of one id the first counts."""

    def titles(table: DataFrame, name: str) -> DataFrame:
        first = first_by_id(table.select("id", "title", *[c for c in ("seq",) if c in table.columns]))
        return first.select(F.col("id").alias(f"{name}_id"), F.col("title").alias(f"{name}_title"))

    e, p = titles(experiments, "experiment"), titles(projects, "project")
    return entries.join(e, "experiment_id", "left").join(p, "project_id", "left")


def with_attachments(blocks: DataFrame, attachments: DataFrame) -> DataFrame:
    """blocks with their attachment's filename, storage_path and thumbnail, null where it is missing."""
    a = attachments.select(F.col("id").alias("attachment_id"), "filename", "storage_path", "thumbnail")
    return blocks.join(a, "attachment_id", "left")


def attachments_of(attachments: DataFrame, entries: DataFrame) -> DataFrame:
    return attachments.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")


def without_attachments(entries: DataFrame, attachments: DataFrame) -> DataFrame:
    """The entries that no attachment belongs to."""
    return entries.join(attachments.select(F.col("entry_id").alias("id")), "id", "left_anti")


def ids_in_order(entries: DataFrame, by: str = "experiment_id") -> DataFrame:
    """(by, ids): the ids of each experiment's entries in the order of their creation."""
    own = entries.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("created_ts", "seq", "id"))).alias("e"))
    return own.select(by, F.transform("e", lambda x: x["id"]).alias("ids"))


def attachment_text(entries: DataFrame, attachments: DataFrame) -> DataFrame:
    """(id, attachments): file names and sample ids of each entry's attachments in order, '' without any."""
    word = F.trim(F.concat_ws(" ", "filename", "sample_id"))
    own = attachments.groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "id", word.alias("word")))).alias("a"))
    return entries.select("id").join(own, "id", "left").select("id", F.coalesce(F.array_join(F.transform("a", lambda x: x["word"]), " "), F.lit("")).alias("attachments"))


def lock_headings(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """blocks whose headings are locked where a region with a template's label holds them."""
    held = regions.where(F.col("label").isin(LOCKED_LABELS)).select("entry_id", F.explode("block_ids").alias("block_id")).distinct().withColumn("_held", F.lit(True))
    locked = F.when(F.col("_held") & (F.col("type") == "heading"), F.lit(True)).otherwise(F.col("locked"))
    return blocks.join(held, ["entry_id", "block_id"], "left").withColumn("locked", locked).drop("_held").select(*blocks.columns)


def in_order(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries of a list of ids (tabs array<string>), in its order; ids without an entry are left out."""
    return ids.select(F.posexplode("tabs").alias("pos", "id")).join(entries, "id").orderBy("pos")


def updated(table: DataFrame, changes: DataFrame, now=None) -> DataFrame:
    """table with the values of changes (id, some of its columns) put in by id, and last_edited_ts stamped if now is given.

    A null clears a value. Where changes have a column given (array of names),
    each row puts in only the columns it names; ids of changes are unique.
    """
    columns = [c for c in changes.columns if c not in ("id", "given")]
    given = F.col("given") if "given" in changes.columns else F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    new = changes.select("id", F.lit(True).alias("_hit"), given.alias("_given"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = table.join(new, "id", "left").withColumns({c: F.when(F.array_contains("_given", c), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns})
    if now is not None:
        out = out.withColumn("last_edited_ts", F.when(F.col("_hit"), now).otherwise(F.col("last_edited_ts")))
    return out.select(*table.columns)


def mapped_files(attachments: DataFrame, entries: DataFrame) -> DataFrame:
    """(sample_id, files, entries): raw-data mapping by sample, an extension."""
    own = attachments.where("sample_id IS NOT NULL").join(entries.select(F.col("id").alias("entry_id"), "title"), "entry_id")
    return own.groupBy("sample_id").agg(F.array_sort(F.collect_set("filename")).alias("files"), F.array_sort(F.collect_set("title")).alias("entries"))


def counted_files(attachments: DataFrame, entries: DataFrame) -> DataFrame:
    """(sample_id, files, entries): how many names mapped_files lists, which no row or task holds here; a few samples may have all files."""
    own = attachments.where("sample_id IS NOT NULL").join(entries.select(F.col("id").alias("entry_id"), "title"), "entry_id")
    return own.groupBy("sample_id").agg(F.count_distinct("filename").alias("files"), F.count_distinct("title").alias("entries"))


def as_of(versions: DataFrame, keys: list[str], ts: str, order: str, at) -> DataFrame:
    """Each key's row that was latest at a time, an extension; order breaks ties."""
    columns = [c for c in versions.columns if c not in keys]
    latest = versions.where(F.col(ts) <= at).groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(ts, order)).alias("v"))
    return latest.select(*keys, "v.*")


def validity(versions: DataFrame, keys: list[str], ts: str, order: str) -> DataFrame:
    """versions with valid_from and valid_to (null: still valid), an extension; of those of one time the last by `order` counts, and ends are exclusive."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    out = versions.withColumn("valid_from", F.col(ts)).withColumn("valid_to", F.lead(ts).over(w))
    return out.where("valid_to IS NULL OR valid_from < valid_to")


def at_instants(intervals: DataFrame, instants: DataFrame, keys: list[str], at: str, seconds: int = 86_400) -> DataFrame:
    """Each instant (keys, at and what else it has) with the version that was valid then, an extension; instants before the first version are left out.

    Both sides are dealt to spans of so many seconds that they touch, so a key
    with many versions is not one task's work; open ends reach to the last
    instant.
    """
    span = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)
    last = instants.agg(F.max(at).alias("_last"))  # one row
    ends = F.least(F.coalesce("valid_to", "_last"), F.col("_last"))
    cut = intervals.join(F.broadcast(last)).where(F.col("valid_from") <= F.col("_last")).withColumn("_span", F.explode(F.sequence(span(F.col("valid_from")), span(ends)))).drop("_last")
    asked = instants.withColumn("_span", span(F.col(at)))
    hit = (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return asked.join(cut, [*keys, "_span"]).where(hit).drop("_span")


def merged_versions(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, conflict) of a three-way merge by block, an extension: one side's change wins, two different ones conflict and keep mine."""
    b, m, t = (df.select(*keys, F.struct(F.col(value).alias("v")).alias(n)) for df, n in ((base, "b"), (mine, "m"), (theirs, "t")))
    joined = m.join(t, keys, "full").join(b, keys, "full")
    mine_changed, theirs_changed = ~F.col("m").eqNullSafe(F.col("b")), ~F.col("t").eqNullSafe(F.col("b"))
    conflict = mine_changed & theirs_changed & ~F.col("m").eqNullSafe(F.col("t"))
    kept = F.when(mine_changed, F.col("m")).otherwise(F.col("t"))
    return joined.withColumn("kept", kept).where("kept IS NOT NULL OR (b IS NULL)").select(*keys, F.col("kept.v").alias(value), conflict.alias("conflict"))
