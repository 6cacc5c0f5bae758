"""The notebook's tables: schemas, seed rows, templates, and reading and writing them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldbook.functions.arrays import ITEMS, RUNS, listed, united
from fieldbook.functions.text import attachment_type, basename, has_scheme, long_date, long_datetime, new_id, size_label, trimmed, without_scheme

BLOCK = (
    "block_id string, type string, text string, level int, runs " + RUNS + ", data array<array<string>>, caption string, header_row boolean, "
    "attachment_id string, label string, items " + ITEMS + ", locked boolean, align string, updated_ts timestamp, updated_by string"
)
SCHEMAS = {
    "users": "id string, name string, email string, role string, settings struct<theme:string,default_lab_id:string,default_project_id:string>",
    "labs": "id string, name string, members array<struct<user_id:string,permission:string>>, storage struct<location:string,path:string>",
    "projects": "id string, lab_id string, title string, description string, tags array<string>, archived boolean",
    "experiments": "id string, project_id string, title string, protocol_ref string, animal_model string, cell_line string, start_ts timestamp, end_ts timestamp, default_raw_data_path string",
    "entries": "id string, seq bigint, experiment_id string, project_id string, created_ts timestamp, last_edited_ts timestamp, author_id string, title string, date_bucket date, is_daily boolean, "
    "tags array<string>, project_tags array<string>, experiment_tags array<string>, search_terms array<string>, linked_files array<string>",
    "blocks": "entry_id string, pos int, " + BLOCK,
    "attachments": "id string, seq bigint, entry_id string, type string, filename string, filesize string, storage_path string, thumbnail string, linked_region_id string, tag string, sample_id string, "
    "pinned_offline boolean, cached_path string",
    "regions": "id string, entry_id string, label string, block_ids array<string>, linked_attachments array<string>, summary string",
    "changes": "id string, seq bigint, entry_id string, blocks array<string>, status string, updated_ts timestamp, attempts int, last_tried_ts timestamp, last_error string",
}

#: Fixed values of the seed.
SEED_VERSION = "2025-12-26-guided-template-v2"
SEED_TIME = datetime(2025, 12, 26, 12, tzinfo=UTC)
SECTIONS = [
    ("Context", "What question are you answering today? Include model, conditions, and expected outcome."),
    ("Setup", ["Sample IDs and groups confirmed", "Controls + blanks prepared", "Reagents + lot IDs logged"]),
    ("Procedure", "Step-by-step protocol. Note timing windows and any deviations from SOP."),
    ("Observations", "Record time-stamped observations, anomalies, and instrument readouts."),
    ("Next steps", "What happens next? Add follow-ups, analysis tasks, or handoff notes."),
]
LOCKED_LABELS = ["Context", "Setup", "Procedure", "Observations", "Next steps", "Summary", "Protocol", "Objective", "Aim", "Experiment", "Results"]
PROJECT_TAGS = ["IL-17 WT KO aging project", "TNF dose + microglia activation", "Neuroimmune baseline"]
EXPERIMENT_TAGS = ["FACS", "Immunofluorescence", "Genotyping", "Behaviour", "qPCR", "ELISA", "Sequencing"]
_SEED_IDS = ["context", "setup", "proc", "obs", "next"]
_SETTINGS = ("dark", "lab-main", "proj-guided")


def _seed_rows(now: datetime) -> dict[str, list[dict]]:
    blocks = []
    for short, (label, body) in zip(_SEED_IDS, SECTIONS, strict=True):
        stamp = {"entry_id": "entry-guided", "updated_ts": now, "updated_by": "me"}
        blocks.append({**stamp, "block_id": f"b-{short}-h", "type": "heading", "level": 2, "text": label, "locked": True})
        if isinstance(body, str):
            blocks.append({**stamp, "block_id": f"b-{short}", "type": "paragraph", "text": body})
        else:
            blocks.append({**stamp, "block_id": f"b-{short}", "type": "checklist", "items": [(f"c-{short}-{k}", text, False, None, None) for k, text in enumerate(body, 1)]})
    return {
        "users": [
            {"id": "u1", "name": "Megha Sharma", "email": "megha@northlab.edu", "role": "student", "settings": _SETTINGS},
            {"id": "u2", "name": "Dr. Rana Iyer", "email": "rana.iyer@northlab.edu", "role": "PI", "settings": _SETTINGS},
        ],
        "labs": [{"id": "lab-main", "name": "Neuroimmunology Lab", "members": [("u1", "editor"), ("u2", "owner")], "storage": ("institutional", "\\\\labserver\\tnf_project\\2025")}],
        "projects": [{"id": "proj-guided", "lab_id": "lab-main", "title": "Guided lab notebook", "description": "A clean starting point for new experiment notes and quick capture.", "tags": ["template", "starter"], "archived": False}],
        "experiments": [{"id": "exp-guided", "project_id": "proj-guided", "title": "Guided template entry", "protocol_ref": "TEMPLATE-01", "start_ts": now}],
        "entries": [
            {"id": "entry-guided", "seq": 0, "experiment_id": "exp-guided", "project_id": "proj-guided", "created_ts": now, "last_edited_ts": now, "author_id": "u1", "title": "Guided template - start here",
             "date_bucket": now.date(), "is_daily": True, "tags": [], "project_tags": ["IL-17 WT KO aging project"], "experiment_tags": ["Genotyping"], "search_terms": [], "linked_files": []},
        ],
        "blocks": [{**b, "pos": k} for k, b in enumerate(blocks)],
    }


def seed(spark: SparkSession, name: str, now: datetime = SEED_TIME) -> DataFrame:
    """A table's constant rows, stamped with one time."""
    kind = spark.createDataFrame([], SCHEMAS[name]).schema
    rows = [tuple(r.get(f.name) for f in kind.fields) for r in _seed_rows(now).get(name, [])]
    return spark.createDataFrame(rows, kind)


def read_or_seed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table's JSON lines, or all of its seed where the path is missing or any line is broken."""
    try:
        found = spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST").json(path)
        found.write.format("noop").mode("overwrite").save()
        return found
    except (PySparkException, Py4JJavaError):
        return seed(spark, name)


def with_seeds(saved: DataFrame, seeds: DataFrame) -> DataFrame:
    """Saved rows, and the seed rows whose id is not saved."""
    return saved.unionByName(seeds.join(saved, "id", "left_anti"))


def version_matches(spark: SparkSession, path: str, version: str = SEED_VERSION) -> bool:
    """Whether the folder's version file holds this version; if not, saved tables give way to seeds."""
    try:
        rows = spark.read.text(path).take(2)
    except PySparkException:
        return False
    return [r.value for r in rows] == [version]


def write_version(spark: SparkSession, path: str, version: str = SEED_VERSION) -> None:
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: What a new version of the seed takes away; the theme and the blobs stay.
RESET = ["entries", "attachments", "projects", "experiments", "project_tags", "experiment_tags", "master_sync_path"]


def reset_if_outdated(spark: SparkSession, root: str, version: str = SEED_VERSION) -> bool:
    """Whether the folder `root` of saved tables was of another version; if so, its tables of RESET are gone, and its version is this one."""
    if version_matches(spark, f"{root}/version", version):
        return False
    for name in RESET:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    write_version(spark, f"{root}/version", version)
    return True


def write_json(table: DataFrame, path: str) -> None:
    """Overwrite a table's JSON lines as a whole."""
    table.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def template_blocks(entries: DataFrame, template: str, now: Column) -> DataFrame:
    """New blocks for each entry id: five headed sections ('guided') or one empty paragraph ('blank').

    Ids follow from the entry's id and the place, so that a retried task makes the same ones.
    """
    if template == "blank":
        rows = [F.struct(F.lit("paragraph").alias("type"), F.lit("").alias("text"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("locked"), F.array().cast("array<string>").alias("todo"))]
    else:
        rows = []
        for label, body in SECTIONS:
            todo = body if isinstance(body, list) else []
            rows.append(F.struct(F.lit("heading").alias("type"), F.lit(label).alias("text"), F.lit(2).alias("level"), F.lit(True).alias("locked"), F.array().cast("array<string>").alias("todo")))
            rows.append(F.struct(F.lit("checklist" if todo else "paragraph").alias("type"), F.lit(None if todo else body).cast("string").alias("text"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("locked"), F.array(*[F.lit(t) for t in todo]).cast("array<string>").alias("todo")))
    placed = entries.select(F.col("id").alias("entry_id"), F.posexplode(F.array(*rows)).alias("pos", "b"))
    block_id = F.concat(F.lit("b-"), F.col("entry_id"), F.lit("-"), F.col("pos").cast("string"))
    items = F.transform("b.todo", lambda t, i: F.struct(F.concat(F.lit("ci-"), F.col("entry_id"), F.lit("-"), i.cast("string")).alias("id"), t.alias("text"), F.lit(False).alias("done"), F.lit(None).cast("int").alias("timer_minutes"), F.lit(None).cast(RUNS).alias("runs")))
    return placed.select("entry_id", "pos", block_id.alias("block_id"), "b.type", "b.text", "b.level", "b.locked", F.when(F.col("b.type") == "checklist", items).alias("items"), now.alias("updated_ts"), F.lit("me").alias("updated_by"))


def template_regions(blocks: DataFrame) -> DataFrame:
    """A region for each heading of a guided template: the heading and the block after it."""
    body = blocks.select("entry_id", (F.col("pos") - 1).alias("pos"), F.col("block_id").alias("body"))
    heads = blocks.where("type = 'heading'").select("entry_id", "pos", "block_id", F.col("text").alias("label"))
    rows = heads.join(body, ["entry_id", "pos"])
    return rows.select(F.concat(F.lit("region-"), "block_id").alias("id"), "entry_id", "label", F.array("block_id", "body").alias("block_ids"), F.array().cast("array<string>").alias("linked_attachments"), F.lit(None).cast("string").alias("summary"))


def attachments_from_files(files: DataFrame, folder: str = "fs") -> DataFrame:
    """Attachment rows for files (entry_id, seq, name, mime, bytes) that are kept under folder://name."""
    kind = attachment_type(F.col("mime"))
    path = F.concat(F.lit(f"{folder}://"), F.col("name"))
    return files.select(
        F.concat(F.lit("att-"), F.sha2(F.concat_ws("/", "entry_id", F.col("seq").cast("string"), "name"), 256).substr(1, 16)).alias("id"),
        "seq", "entry_id", kind.alias("type"), F.col("name").alias("filename"), size_label(F.col("bytes")).alias("filesize"), path.alias("storage_path"), path.alias("cached_path"), (kind == "image").alias("pinned_offline"),
    )


def attachments_from_paths(paths: DataFrame) -> DataFrame:
    """Attachment rows of type 'raw' for paths (entry_id, seq, path, label); a blank path raises an error."""
    path = trimmed(F.col("path"))
    checked = F.when(F.coalesce(path, F.lit("")) == "", F.raise_error(F.lit("Path is required."))).otherwise(path)
    return paths.select(F.concat(F.lit("att-"), F.sha2(F.concat_ws("/", "entry_id", F.col("seq").cast("string"), "path"), 256).substr(1, 16)).alias("id"), "seq", "entry_id", F.lit("raw").alias("type"), basename(path, F.col("label")).alias("filename"), F.lit("—").alias("filesize"), checked.alias("storage_path"))


def link_files(entries: DataFrame, attachments: DataFrame, now: Column) -> DataFrame:
    """entries with the ids of new attachments in linked_files, once each, and a new time of editing."""
    new = attachments.groupBy(F.col("entry_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("id").alias("att")))), lambda a: a["att"]).alias("new_files"))
    joined = entries.join(new, "id", "left")
    touched = F.col("new_files").isNotNull()
    return joined.withColumns({"linked_files": F.when(touched, united(F.col("linked_files"), F.col("new_files"))).otherwise(F.col("linked_files")), "last_edited_ts": F.when(touched, now).otherwise(F.col("last_edited_ts"))}).drop("new_files")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, bytes, content) of a folder's files."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("bytes"), "content")


def put_blobs(files: DataFrame, path: str) -> None:
    """Append (key, content) rows to a blob table; the key is the content's hash, so that a repeated put changes nothing."""
    files.select(F.sha2("content", 256).alias("key"), "content").write.mode("append").parquet(path)


def get_blobs(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, content) of the wanted keys (key), one row each."""
    return spark.read.parquet(path).join(keys.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def hydrated(attachments: DataFrame, blobs: DataFrame, files: DataFrame) -> DataFrame:
    """attachments with what they are shown from: blobs (key, url) for idb://, files (name, url) else the thumbnail for fs://, else the thumbnail."""
    path = F.col("cached_path")
    own = attachments.withColumn("_key", F.when(has_scheme(path, "idb"), without_scheme(path, "idb"))).withColumn("_name", F.when(has_scheme(path, "fs"), without_scheme(path, "fs")))
    own = own.join(blobs.select(F.col("key").alias("_key"), F.col("url").alias("_blob")), "_key", "left").join(files.select(F.col("name").alias("_name"), F.col("url").alias("_file")), "_name", "left")
    url = F.when(F.col("_key").isNotNull(), F.col("_blob")).otherwise(F.coalesce("_file", "thumbnail"))
    return own.withColumn("url", url).drop("_key", "_name", "_blob", "_file")


def new_days(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted entries without quick captures and daily ones whose date has its daily entry; of several for one new date the first by seq stays."""
    quick = F.coalesce(F.col("quick_capture"), F.lit(False)) if "quick_capture" in wanted.columns else F.lit(False)
    rows = wanted.withColumn("_day", F.when(quick | F.coalesce("is_daily", F.lit(False)), F.col("date_bucket")))
    known = entries.where("is_daily").select(F.col("date_bucket").alias("_day")).distinct()
    open_days = rows.where("_day IS NOT NULL").join(known, "_day", "left_anti")
    makes = F.coalesce("is_daily", quick)  # only a daily entry stops the next one
    first = open_days.where(makes).groupBy("_day").agg(F.min("seq").alias("_first"))
    kept = open_days.join(first, "_day", "left").where("_first IS NULL OR seq <= _first")
    return kept.select(*wanted.columns).unionByName(rows.where("_day IS NULL").select(*wanted.columns))


def cache_files(files: DataFrame, folder: str, blobs: str, outcomes: str, now_ms: int) -> DataFrame:
    """files (name, content and what else there is) with cached_path: fs://<now_ms>-<name> where the folder took the file, else idb://<key> in the blob table.

    The outcome of each write is a row of the table `outcomes`, so that a file
    is written to one place. A file is written beside its place and then
    moved; one whose name has a slash is not tried. The folder is one that all
    executors share, as in export.write_bundle.
    """
    spark = files.sparkSession
    names = F.concat(F.lit(f"{now_ms}-"), F.col("name"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_stored(folder, n, c) for n, c in zip(batch.column("_stored").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield batch.append_column("_done", pa.array(done, pa.bool_()))

    tried = files.withColumn("_stored", names)
    schema = StructType([*tried.schema.fields, *StructType.fromDDL("_done boolean").fields])
    tried.mapInArrow(put, schema).write.mode("overwrite").parquet(outcomes)
    done = spark.read.schema(schema).parquet(outcomes)
    failed = done.where("NOT _done AND content IS NOT NULL")
    if failed.take(1):
        put_blobs(failed, blobs)
    path = F.when(F.col("_done"), F.concat(F.lit("fs://"), "_stored")).otherwise(F.concat(F.lit("idb://"), F.sha2("content", 256)))
    return done.withColumn("cached_path", path).select(*files.columns, "cached_path")


def _store(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(folder) if "://" in folder else (LocalFileSystem(), folder)


def _stored(folder: str, name: str | None, content: bytes | None) -> bool:
    """Whether a folder took a file."""
    if name is None or content is None or "/" in name or "\0" in name:
        return False
    try:
        store, base = _store(folder)
        draft = f"{base}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(content)
        store.move(draft, f"{base}/{name}")
        return True
    except (OSError, pa.ArrowException):
        return False


def attachment_contents(attachments: DataFrame, folder: str | None, blobs: DataFrame, fetched: DataFrame) -> DataFrame:
    """(id, content) of the attachments (id, cached_path, thumbnail) that can be read; the rest is left out.

    idb:// reads the blob table (key, content) alone and fs:// the folder
    alone, none if there is no folder or no such file; neither falls back to
    the thumbnail. What has no such path is fetched by its url, if it has one,
    else by its thumbnail: data: URLs are decoded, others are looked up in
    fetched (url, content).
    """
    path = F.col("cached_path")
    url = F.coalesce("url", "thumbnail") if "url" in attachments.columns else F.col("thumbnail")
    own = attachments.select("id", F.when(has_scheme(path, "idb"), without_scheme(path, "idb")).alias("key"), F.when(has_scheme(path, "fs"), without_scheme(path, "fs")).alias("name"), url.alias("url"))
    held = own.where("key IS NOT NULL").join(blobs.dropDuplicates(["key"]), "key").select("id", "content")
    plain = own.where("key IS NULL AND name IS NULL AND url IS NOT NULL")
    data = plain.where(F.startswith("url", F.lit("data:")))
    body = F.substring_index("url", ",", -1)
    coded = F.endswith(F.substring_index("url", ",", 1), F.lit(";base64"))
    decoded = F.when(coded, F.expr("try_to_binary(substring_index(url, ',', -1), 'base64')")).otherwise(F.encode(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))), "UTF-8"))
    out = held.unionByName(data.select("id", decoded.alias("content"))).unionByName(plain.where(~F.startswith("url", F.lit("data:"))).join(fetched, "url").select("id", "content"))
    if folder is None:
        return out.where("content IS NOT NULL")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(batch.column("name").to_pylist()):  # a file at a time
                try:
                    store, base = _store(folder)
                    with store.open_input_stream(f"{base}/{name}") as f:
                        yield pa.RecordBatch.from_arrays([batch.column("id").slice(k, 1), pa.array([f.read()], pa.binary())], names=["id", "content"])
                except (OSError, pa.ArrowException):
                    continue

    files = own.where("name IS NOT NULL AND NOT contains(name, '/')").select("id", "name").mapInArrow(read, StructType([own.schema["id"], *StructType.fromDDL("content binary").fields]))
    return out.where("content IS NOT NULL").unionByName(files)


def created_entries(wanted: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Entry rows for wanted (id, seq, title, project_id, experiment_id, is_daily, date_bucket), with defaults for title, project and author.

    wanted may have project_tags and experiment_tags, which are kept, and
    quick_capture, which alone decides how an untitled entry is called and
    makes it a daily one where is_daily is null. The author is the second user
    in the order of ids, else the first, else 'me'. new_days() leaves out what
    a day has already.
    """
    given = lambda c, other: F.col(c) if c in wanted.columns else other
    ranked = users.select("id", F.col("settings.default_project_id").alias("project")).orderBy("id").limit(2)
    second = ranked.agg(F.array_sort(F.collect_list(F.struct("id", "project"))).alias("u")).select(F.coalesce(F.get("u", F.lit(1))["id"], F.get("u", F.lit(0))["id"], F.lit("me")).alias("author_id"), F.get("u", F.lit(1))["project"].alias("_project"))
    quick = F.coalesce(given("quick_capture", F.lit(False)), F.lit(False))
    shown = F.when(quick, F.concat(F.lit("Quick capture – "), long_datetime(now))).otherwise(F.concat(F.lit("Untitled note – "), long_date(now)))
    title = F.coalesce(F.nullif(trimmed(F.col("title")), F.lit("")), shown)
    empty = F.array().cast("array<string>")
    tags = {c: listed(given(c, empty)) for c in ("project_tags", "experiment_tags")}
    return wanted.join(F.broadcast(second)).select(
        F.coalesce("id", new_id("entry-")).alias("id"), "seq", "experiment_id", F.coalesce("project_id", "_project").alias("project_id"), now.alias("created_ts"), now.alias("last_edited_ts"), "author_id", title.alias("title"), "date_bucket", F.coalesce(F.col("is_daily"), quick).alias("is_daily"),
        *[tags.get(c, empty).alias(c) for c in ("tags", "project_tags", "experiment_tags", "search_terms", "linked_files")],
    )

