"""Export of experiments: Markdown, a manifest and printable HTML, for all experiments at once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import blocks as block_functions
from fieldbook.functions.arrays import listed
from fieldbook.functions.text import escape_html, iso_text, long_date, long_datetime, safe_file_name, trimmed
from fieldbook.operators.joins import with_attachments

_BLOCK = ("type", "text", "level", "data", "caption", "header_row", "label", "items")


def export_path(attachment_id: Column, filename: Column) -> Column:
    return F.concat(F.lit("attachments/"), attachment_id, F.lit("-"), safe_file_name(filename))


def _lines(*parts: Column) -> Column:
    """Parts as lines; empty and null ones are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def entry_markdown(blocks: DataFrame, attachments: DataFrame, exported: bool = True) -> DataFrame:
    """(entry_id, md): each entry's blocks in order as Markdown, with a blank line between blocks and one line's end after the last."""
    joined = with_attachments(blocks, attachments)
    path = F.when(F.col("filename").isNotNull(), export_path(F.col("attachment_id"), F.col("filename"))) if exported else F.col("storage_path")
    text = block_functions.markdown(F.struct(*_BLOCK), F.col("filename"), path)
    own = joined.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(text, F.lit("")).alias("t")))).alias("b"))
    return own.select("entry_id", F.concat(trimmed(F.array_join(F.transform("b", lambda x: x["t"]), "\n\n")), F.lit("\n")).alias("md"))


def entry_html(blocks: DataFrame, attachments: DataFrame) -> DataFrame:
    """(entry_id, html): each entry's blocks in order as HTML."""
    joined = with_attachments(blocks, attachments)
    text = block_functions.html(F.struct(*_BLOCK), F.col("filename"), F.col("storage_path"), F.col("thumbnail"))
    own = joined.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("b"))
    return own.select("entry_id", F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("html"))


def _with_parents(experiments: DataFrame, projects: DataFrame) -> DataFrame:
    p = projects.select(F.col("id").alias("project_id"), F.col("title").alias("project_title"), F.lit(True).alias("has_project"))
    return experiments.select(F.col("id").alias("experiment_id"), F.col("title").alias("experiment_title"), "project_id", "protocol_ref").join(p, "project_id", "left")


def experiment_markdown(entries: DataFrame, blocks: DataFrame, attachments: DataFrame, experiments: DataFrame, projects: DataFrame, exported_at: str, prefix: str = "notebook") -> DataFrame:
    """(experiment_id, folder, name, content) of each experiment's file; its entries stand in the order of their creation.

    The folder is named prefix_date_title.
    """
    texts = entry_markdown(blocks, attachments)
    own = entries.join(texts, entries.id == texts.entry_id, "left")
    dates = F.concat(F.lit("Created "), long_date(F.col("created_ts")), F.lit(" · Last edited "), long_date(F.col("last_edited_ts")))
    part = _lines(F.concat(F.lit("## "), F.col("title")), dates, F.coalesce("md", F.lit("\n")))
    grouped = own.where("experiment_id IS NOT NULL").groupBy("experiment_id").agg(F.array_sort(F.collect_list(F.struct("created_ts", "seq", part.alias("t")))).alias("e"))
    whole = _with_parents(experiments, projects).join(grouped, "experiment_id", "left")
    head = F.concat(F.lit("# "), F.col("experiment_title"))
    content = _lines(head, _labelled("- Project: ", F.col("project_title")), _labelled("- Protocol: ", F.col("protocol_ref")), F.lit(f"- Exported: {exported_at}"), F.array_join(F.transform("e", lambda x: x["t"]), "\n"))
    folder = safe_file_name(F.concat(F.lit(f"{prefix}_{exported_at[:10]}_"), F.col("experiment_title")))
    return whole.select("experiment_id", folder.alias("folder"), safe_file_name(F.concat("experiment_title", F.lit(".md"))).alias("name"), content.alias("content"))


def entry_files(entries: DataFrame, blocks: DataFrame, attachments: DataFrame) -> DataFrame:
    """(experiment_id, name, content) of each entry's own file."""
    texts = entry_markdown(blocks, attachments)
    tags = F.array_join(F.concat(listed(F.col("tags")), listed(F.col("project_tags")), listed(F.col("experiment_tags"))), ", ")
    own = entries.join(texts, entries.id == texts.entry_id, "left")
    content = _lines(F.concat(F.lit("# "), F.col("title")), F.concat(F.lit("- Created: "), iso_text(F.col("created_ts"))), F.concat(F.lit("- Last edited: "), iso_text(F.col("last_edited_ts"))), _labelled("- Tags: ", tags), F.coalesce("md", F.lit("\n")))
    name = F.concat(safe_file_name(F.concat_ws("_", F.col("date_bucket").cast("string"), "id")), F.lit(".md"))
    return own.select("experiment_id", name.alias("name"), content.alias("content"))


def manifests(entries: DataFrame, attachments: DataFrame, experiments: DataFrame, projects: DataFrame, exported_at: str) -> DataFrame:
    """(experiment_id, manifest): a JSON text for each experiment, absent values as null."""
    row = F.struct(
        "id", "title", F.col("date_bucket").cast("string").alias("dateBucket"), iso_text(F.col("created_ts")).alias("createdDatetime"), iso_text(F.col("last_edited_ts")).alias("lastEditedDatetime"),
        "tags", listed(F.col("project_tags")).alias("projectTags"), listed(F.col("experiment_tags")).alias("experimentTags"), F.col("linked_files").alias("linkedFiles"),
    )
    listed_entries = entries.where("experiment_id IS NOT NULL").groupBy("experiment_id").agg(F.sort_array(F.collect_list(F.struct("created_ts", "seq", row.alias("row")))).alias("e"))
    file = F.struct(
        "id", F.col("entry_id").alias("entryId"), "type", "filename", "filesize", F.col("storage_path").alias("storagePath"), F.col("cached_path").alias("cachedPath"),
        F.coalesce("pinned_offline", F.lit(False)).alias("pinnedOffline"), "tag", F.col("sample_id").alias("sampleId"),
    )
    owners = entries.where("experiment_id IS NOT NULL").select(F.col("id").alias("entry_id"), "experiment_id")
    files = attachments.join(owners, "entry_id").groupBy("experiment_id").agg(F.sort_array(F.collect_list(F.struct("seq", file.alias("row")))).alias("a"))
    whole = _with_parents(experiments, projects).join(listed_entries, "experiment_id", "left").join(files, "experiment_id", "left")
    known = F.col("has_project")
    scope = F.struct(F.lit("experiment").alias("type"), F.col("experiment_id").alias("experimentId"), F.col("experiment_title").alias("experimentTitle"), F.when(known, F.col("project_id")).alias("projectId"), F.col("project_title").alias("projectTitle"))
    rows = lambda c, row: F.coalesce(F.transform(c, lambda x: row(x["row"])), F.array())
    with_path = lambda f: f.withField("exportPath", export_path(f["id"], f["filename"]))
    return whole.select("experiment_id", F.to_json(F.struct(F.lit(exported_at).alias("exportedAt"), scope.alias("scope"), rows("e", lambda x: x).alias("entries"), rows("a", with_path).alias("attachments")), {"ignoreNullFields": "false"}).alias("manifest"))


def printable(entries: DataFrame, blocks: DataFrame, attachments: DataFrame, experiments: DataFrame, projects: DataFrame, exported_at: str) -> DataFrame:
    """(experiment_id, name, html): one page for each experiment; titles are escaped."""
    texts = entry_html(blocks, attachments)
    own = entries.join(texts, entries.id == texts.entry_id, "left")
    when = F.concat(F.lit("Created "), long_datetime(F.col("created_ts")), F.lit(" · Last edited "), long_datetime(F.col("last_edited_ts")))
    part = F.concat(F.lit('<section class="entry"><h2>'), escape_html(F.col("title")), F.lit('</h2><div class="meta">'), when, F.lit("</div>"), F.coalesce("html", F.lit("")), F.lit("</section>"))
    grouped = own.where("experiment_id IS NOT NULL").groupBy("experiment_id").agg(F.array_sort(F.collect_list(F.struct("created_ts", "seq", part.alias("t")))).alias("e"))
    whole = _with_parents(experiments, projects).join(grouped, "experiment_id", "left")
    title = escape_html(F.col("experiment_title"))
    meta = F.concat(F.coalesce(_labelled("Project: ", F.concat(escape_html(F.col("project_title")), F.lit(" · "))), F.lit("")), F.coalesce(_labelled("Protocol: ", F.concat(escape_html(F.col("protocol_ref")), F.lit(" · "))), F.lit("")), F.lit(f"Exported: {exported_at}"))
    page = F.concat(
        F.lit('<!doctype html><html><head><meta charset="utf-8" /><title>'), safe_file_name(F.col("experiment_title")), F.lit("</title></head><body><header><h1>"), title, F.lit('</h1><div class="meta">'), meta,
        F.lit("</div></header>"), F.coalesce(F.array_join(F.transform("e", lambda x: x["t"]), "\n"), F.lit("")), F.lit("</body></html>"),
    )
    return whole.select("experiment_id", F.concat(safe_file_name(F.col("experiment_title")), F.lit(".html")).alias("name"), page.alias("html"))


def bundle(entries: DataFrame, blocks: DataFrame, attachments: DataFrame, experiments: DataFrame, projects: DataFrame, exported_at: str, blobs: DataFrame | None = None) -> DataFrame:
    """(path, content): all files of all experiments' folders: the experiment's Markdown, manifest.json, entries/ and, with blobs (id, content), attachments/."""
    tables = (entries, blocks, attachments, experiments, projects)
    whole = experiment_markdown(*tables, exported_at)
    folders = whole.select("experiment_id", "folder")
    texts = whole.select("folder", "name", F.encode("content", "UTF-8").alias("content"))
    manifest = manifests(entries, attachments, experiments, projects, exported_at).select("experiment_id", F.lit("manifest.json").alias("name"), F.encode("manifest", "UTF-8").alias("content"))
    own = entry_files(entries, blocks, attachments).select("experiment_id", F.concat(F.lit("entries/"), "name").alias("name"), F.encode("content", "UTF-8").alias("content"))
    parts = manifest.unionByName(own)
    if blobs is not None:
        held = attachments.join(blobs, "id").join(entries.select(F.col("id").alias("entry_id"), "experiment_id"), "entry_id")
        parts = parts.unionByName(held.select("experiment_id", export_path(F.col("id"), F.col("filename")).alias("name"), "content"))
    files = texts.unionByName(parts.join(folders, "experiment_id").select("folder", "name", "content"))
    return files.select(F.concat_ws("/", "folder", "name").alias("path"), "content")


def write_bundle(files: DataFrame, root: str) -> DataFrame:
    """Write files (path, content binary) under root, a folder or URI that all executors share; (path, bytes) of what was written.

    Each file is written beside its place and then moved there, so that a
    repeated task leaves whole files.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(root) if "://" in root else (LocalFileSystem(), root)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base}/{path}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(content)
                store.move(draft, target)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select("path", "content").mapInArrow(put, "path string, bytes long")


def write_blobs(attachments: DataFrame, blobs: DataFrame, root: str) -> None:
    """Write what attachments hold (blobs: id, content) as rows of (path, content); attachments without content are left out."""
    kept = attachments.join(blobs, "id").select(export_path(F.col("id"), F.col("filename")).alias("path"), "content")
    kept.write.mode("overwrite").parquet(root)
