"""Seed, filters, sections, search, export and the change queue on small tables."""

import json
import re
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import blocks as block_functions
from fieldbook.operators import collections, export, filters, joins, search
from fieldbook.sources import notebook
from fieldbook.streaming import changes



@pytest.fixture
def now(spark):
    return F.lit("2025-12-26 13:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def book(spark):
    return {name: notebook.seed(spark, name) for name in notebook.SCHEMAS}


def test_seed_counts(book):
    assert {n: t.count() for n, t in book.items()} == {"users": 2, "labs": 1, "projects": 1, "experiments": 1, "entries": 1, "blocks": 10, "attachments": 0, "regions": 0, "changes": 0}


def test_broken_or_missing_json_gives_the_seed(spark, book, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    notebook.write_json(book["projects"].withColumn("title", F.lit("saved")), good)
    spark.createDataFrame([("{broken",)], "v string").write.text(bad)
    assert notebook.read_or_seed(spark, good, "projects").first().title == "saved"
    assert notebook.read_or_seed(spark, bad, "projects").first().title == "Guided lab notebook"
    assert notebook.read_or_seed(spark, str(tmp_path / "none"), "projects").count() == 1


def test_version_gate(spark, tmp_path):
    path = str(tmp_path / "version")
    assert not notebook.version_matches(spark, path)
    notebook.write_version(spark, path)
    assert notebook.version_matches(spark, path)
    assert not notebook.version_matches(spark, path, "other")


def test_reset_of_an_old_version(spark, book, tmp_path):
    root = str(tmp_path)
    for name in ("entries", "theme"):
        notebook.write_json(book["entries"], f"{root}/{name}")
    assert notebook.reset_if_outdated(spark, root) and not (tmp_path / "entries").exists() and (tmp_path / "theme").exists()
    notebook.write_json(book["entries"], f"{root}/entries")
    assert not notebook.reset_if_outdated(spark, root) and (tmp_path / "entries").exists()


def test_files_and_blobs_of_attachments(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one")
    got = notebook.read_files(spark, str(tmp_path / "in")).first()
    assert (got.name, got.bytes, bytes(got.content)) == ("a.txt", 3, b"one")
    a = spark.createDataFrame([("1", "x y.png"), ("2", "none")], "id string, filename string")
    export.write_blobs(a, spark.createDataFrame([("1", bytearray(b"z"))], "id string, content binary"), str(tmp_path / "out"))
    assert [(r.path, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("attachments/1-x_y.png", b"z")]


def test_templates(spark, book, now):
    ids = book["entries"].select(F.lit("e1").alias("id"))
    made = notebook.template_blocks(ids, "guided", now)
    regions = notebook.template_regions(made)
    assert (made.count(), regions.count()) == (10, 5)
    assert notebook.template_blocks(ids, "blank", now).first().type == "paragraph"
    unlocked = made.withColumn("locked", F.lit(None).cast("boolean"))
    assert joins.lock_headings(unlocked, regions).where("locked").count() == 5


def test_filters(spark, book):
    e, a = book["entries"], book["attachments"]
    day = notebook.SEED_TIME.date()
    count = lambda **by: filters.filtered(e, a, filters.EntryFilter(**by)).count()
    assert count() == 1
    assert count(day=day) == 1 and count(day=day - timedelta(1)) == 0
    assert count(experiment="none") == 0 and count(experiment="exp-guided") == 1
    assert count(project_tags=["IL-17 WT KO aging project"]) == 1 and count(project_tags=["il-17 wt ko aging project"]) == 0
    assert count(has_image=True) == 0
    none = e.withColumn("experiment_id", F.lit("")).unionByName(e.withColumn("experiment_id", F.lit(None).cast("string")))
    assert filters.filtered(none, a, filters.EntryFilter(experiment="none")).count() == 2
    assert filters.valid_experiment(book["experiments"], "other", "exp-guided") == "all"
    assert filters.selected(e, "gone").first().id == "entry-guided"


def test_sections(spark):
    rows = [("e", 0, "p0", "paragraph", None), ("e", 1, "h1", "heading", 2), ("e", 2, "p1", "paragraph", None), ("e", 3, "h3", "heading", 3), ("e", 4, "h2", "heading", 2), ("e", 5, "hx", "heading", None)]
    got = collections.section_blocks(spark.createDataFrame(rows, "entry_id string, pos int, block_id string, type string, level int")).orderBy("section_no").collect()
    assert [(r.section_id, r.block_ids) for r in got] == [("intro", ["p0"]), ("h1", ["h1", "p1", "h3"]), ("h2", ["h2", "hx"])]


def test_runs(spark):
    rows = [("e", 0, "a", None, None, None), ("e", 1, "b", False, None, None), ("e", 2, "c", True, None, None), ("e", 3, "d", True, False, None)]
    df = spark.createDataFrame(rows, "e string, pos int, text string, bold boolean, italic boolean, underline boolean")
    assert [(r.text, r.bold) for r in collections.merge_runs(df, ["e"]).orderBy("pos").collect()] == [("ab", False), ("cd", True)]
    packed = df.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "bold", "italic", "underline"))).alias("r"))
    assert [(r.text, r.bold) for r in packed.select(collections.merged_runs(F.col("r"))).first()[0]] == [("ab", False), ("cd", True)]
    assert packed.select(collections.merged_runs(F.slice("r", 1, 2))).first()[0] is None


def test_get_or_create(spark):
    known = spark.createDataFrame([("p1", "My Plan")], "id string, title string")
    got = collections.get_or_create(known, spark.createDataFrame([("  my   plan ",), ("New\tone",), ("new one",), (" ",)], "title string"), [], "proj-").collect()
    assert sorted(r.title for r in got) == ["My Plan", "New one"]
    known = spark.createDataFrame([("p1", " Wide  Plan ", ["t"])], "id string, title string, tags array<string>")
    wanted = spark.createDataFrame([("wide plan",)], "title string")
    got = collections.get_or_create(known, wanted, [], "proj-", {"tags": F.array().cast("array<string>")}).orderBy("id").collect()
    assert [(r.title, r.tags) for r in got] == [(" Wide  Plan ", ["t"]), ("wide plan", [])]  # inner white space of a table's own title counts


def test_daily_is_reused(spark, book):
    wanted = spark.createDataFrame([(notebook.SEED_TIME.date(),), (notebook.SEED_TIME.date(),), (notebook.SEED_TIME.date() + timedelta(1),)], "date_bucket date")
    got = {r.date_bucket: (r.id, r.created) for r in collections.daily_entries(book["entries"], wanted).collect()}
    assert got == {notebook.SEED_TIME.date(): ("entry-guided", False), notebook.SEED_TIME.date() + timedelta(1): ("entry-2025-12-27", True)}


def test_ingest(spark, book, now):
    files = spark.createDataFrame([("entry-guided", 1, "a b.png", "image/png", 2048), ("entry-guided", 2, "x.pdf", "application/pdf", 10)], "entry_id string, seq bigint, name string, mime string, bytes bigint")
    a = notebook.attachments_from_files(files)
    assert [(r.type, r.filesize, r.pinned_offline) for r in a.orderBy("seq").collect()] == [("image", "2 KB", True), ("pdf", "1 KB", False)]
    linked = notebook.link_files(book["entries"], a, now).first()
    assert len(linked.linked_files) == 2 and linked.last_edited_ts.hour == 13
    paths = spark.createDataFrame([("e", 1, " \\\\srv\\raw\\run1 ", None)], "entry_id string, seq bigint, path string, label string")
    assert notebook.attachments_from_paths(paths).first().filename == "run1"
    with pytest.raises(Exception, match="Path is required"):
        notebook.attachments_from_paths(paths.withColumn("path", F.lit(" "))).collect()


def test_hydrate(spark):
    a = spark.createDataFrame([("1", "idb://k", "t1"), ("2", "idb://gone", "t2"), ("3", "fs://f", "t3"), ("4", "fs://gone", "t4"), ("5", None, "t5")], "id string, cached_path string, thumbnail string")
    blobs, files = spark.createDataFrame([("k", "blob")], "key string, url string"), spark.createDataFrame([("f", "file")], "name string, url string")
    assert {r.id: r.url for r in notebook.hydrated(a, blobs, files).collect()} == {"1": "blob", "2": None, "3": "file", "4": "t4", "5": "t5"}


def test_new_entries(spark, book, now):
    wanted = spark.sql("SELECT 'n' AS id, 5L AS seq, '  ' AS title, CAST(NULL AS string) AS project_id, CAST(NULL AS string) AS experiment_id, false AS is_daily, date'2025-12-26' AS date_bucket")
    row = notebook.created_entries(wanted, book["users"], now).first()
    assert (row.title, row.project_id, row.author_id, row.project_tags) == ("Untitled note – Dec 26, 2025", "proj-guided", "u2", [])
    daily = notebook.created_entries(wanted.withColumn("is_daily", F.lit(True)), book["users"], now).first()
    assert (daily.title, daily.is_daily) == ("Untitled note – Dec 26, 2025", True)
    quick = wanted.withColumn("quick_capture", F.lit(True)).withColumn("project_tags", F.array(F.lit("mine")))
    row = notebook.created_entries(quick, book["users"].where("id = 'u1'"), now).first()
    assert (row.title, row.author_id, row.project_tags) == ("Quick capture – Dec 26, 2025, 01:00 PM", "u1", ["mine"])


def test_toggle_and_insert(spark, book, now):
    b = book["blocks"]
    done = collections.toggle_item(b, "b-setup", "c-setup-2", True, now).where("block_id = 'b-setup'").first()
    assert [i.done for i in done["items"]] == [False, True, False]
    new = spark.createDataFrame([("entry-guided", 0, "x", "divider"), ("entry-guided", 1, "y", "paragraph")], "entry_id string, pos int, block_id string, type string")
    after = spark.createDataFrame([("entry-guided", 2)], "entry_id string, after int")
    got = [r.block_id for r in collections.insert_blocks(b, new, after).orderBy("pos").collect()]
    assert got[2:6] == ["b-setup-h", "x", "y", "b-setup"] and len(got) == 12


GOLDEN = """## Context

What question are you answering today? Include model, conditions, and expected outcome.

## Setup

- [ ] Sample IDs and groups confirmed
- [ ] Controls + blanks prepared
- [ ] Reagents + lot IDs logged

## Procedure

Step-by-step protocol. Note timing windows and any deviations from SOP.

## Observations

Record time-stamped observations, anomalies, and instrument readouts.

## Next steps

What happens next? Add follow-ups, analysis tasks, or handoff notes.
"""


def test_markdown(book):
    assert export.entry_markdown(book["blocks"], book["attachments"]).first().md == GOLDEN


def test_bundle(spark, book, tmp_path):
    at = "2025-12-26T13:00:00.000Z"
    args = (book["entries"], book["blocks"], book["attachments"], book["experiments"], book["projects"], at)
    row = export.experiment_markdown(*args).first()
    assert (row.folder, row.name) == ("notebook_2025-12-26_Guided_template_entry", "Guided_template_entry.md")
    lines = row.content.split("\n")
    assert lines[:6] == ["# Guided template entry", "- Project: Guided lab notebook", "- Protocol: TEMPLATE-01", f"- Exported: {at}", "## Guided template - start here", "Created Dec 26, 2025 · Last edited Dec 26, 2025"]
    m = json.loads(export.manifests(book["entries"], book["attachments"], book["experiments"], book["projects"], at).first().manifest)
    assert m["scope"]["projectTitle"] == "Guided lab notebook" and m["attachments"] == [] and m["entries"][0]["createdDatetime"] == "2025-12-26T12:00:00.000Z"
    assert "<h2>Context</h2>" in export.printable(*args).first().html
    assert export.entry_files(book["entries"], book["blocks"], book["attachments"]).first().name == "2025-12-26_entry-guided.md"
    a = spark.createDataFrame([("a1", 0, "entry-guided", "image", "p q.png"), ("a2", 1, "entry-guided", "file", "gone")], "id string, seq bigint, entry_id string, type string, filename string")
    a = a.unionByName(book["attachments"], allowMissingColumns=True)
    blobs = spark.createDataFrame([("a1", bytearray(b"\x89PNG"))], "id string, content binary")
    files = export.bundle(book["entries"], book["blocks"], a, book["experiments"], book["projects"], at, blobs)
    written = {r.path: r.bytes for r in export.write_bundle(files, str(tmp_path / "b")).collect()}
    top = tmp_path / "b" / "notebook_2025-12-26_Guided_template_entry"
    there = {str(p.relative_to(tmp_path / "b")): p.stat().st_size for p in top.rglob("*") if p.is_file()}
    assert there == written and sorted(p.name for p in top.rglob("*") if p.is_file()) == ["2025-12-26_entry-guided.md", "Guided_template_entry.md", "a1-p_q.png", "manifest.json"]
    assert (top / "attachments" / "a1-p_q.png").read_bytes() == b"\x89PNG"
    assert (top / "Guided_template_entry.md").read_text() == row.content


def test_block_kinds(spark):
    rows = [
        ("table", None, [["a|", "b_"], ["1"]], "cap", None, None, None, "", "| a| | b\\_ |\n| --- | --- |\n| 1 |\n*cap*"),
        ("table", None, [["x", "y"], ["1"]], None, False, None, None, "", "| Col 1 | Col 2 |\n| --- | --- |\n| x | y |\n| 1 |"),
        ("quote", "l1\nl2", None, None, None, None, None, "", "> l1\n> l2"),
        ("image", None, None, None, None, None, None, "", "![image](missing)"),
        ("file", None, None, None, None, "L", "f.txt", "p/f", "[L](p/f)"),
        ("divider", None, None, None, None, None, None, "", "---"),
    ]
    df = spark.createDataFrame(rows, "type string, text string, data array<array<string>>, caption string, header_row boolean, label string, filename string, path string, want string")
    df = df.withColumn("items", F.lit(None).cast("array<struct<id:string,text:string,done:boolean>>")).withColumn("level", F.lit(None).cast("int"))
    b = F.struct("type", "text", "data", "caption", "header_row", "label", "items", "level")
    for r in df.select("want", block_functions.markdown(b, F.col("filename"), F.col("path")).alias("md"), block_functions.html(b, F.col("filename"), F.col("path"), F.lit(None).cast("string")).alias("html")).collect():
        assert r.md == r.want
        assert r.html.startswith("<")


def test_search(spark, book):
    docs = search.search_documents(book["entries"], book["blocks"], book["attachments"])
    ix = search.index(docs)
    hits = lambda q: search.search(book["entries"], ix, q).count()
    assert [hits(q) for q in ("", "observations", "tags:genotyping", "title:genotyping", "anomal*", "protocl~1", "+protocol -anomalies", "nothing protocol", "nofield:x", "a:b:c")] == [1, 1, 1, 0, 1, 1, 0, 1, 0, 0]
    assert search.stem_word("observations") == search.stem_word("observation")


def test_scores_with_and_without_an_index(spark):
    rows = [(1, "cell dose cell", "x"), (2, "Dose, (dose) well-fed mouse", "cell"), (3, "no such", None), (4, "", None), (5, "excellent cellar", "")]
    docs = spark.createDataFrame(rows, "id long, body string, tags string")
    plain = search.index(docs, ["body", "tags"], frozenset(), stem=False)
    want = {r.id: round(r.score, 9) for r in search.ranked(plain, ["cell", "dose"]).collect()}
    assert sorted(want) == [1, 2]
    assert {r.id: round(r.score, 9) for r in search.scored(docs, ["Cell", "dose"], ["body", "tags"]).collect()} == want
    assert {r.term for r in plain.where("id = 2").collect()} == {"dose", "well", "fed", "mouse", "cell"}


def test_queue(spark, now):
    ids = [f"chg-{k}" for k in range(40)]
    then = datetime(2025, 12, 26, tzinfo=UTC)
    q = spark.createDataFrame([(i, -k, "e", ["b"], "pending", then, 0, None, None) for k, i in enumerate(ids)], notebook.SCHEMAS["changes"])
    bad = {i for i in ids if changes._fnv(i) % 5 == 0}
    one = changes.synced(q, now)
    assert {r.id for r in one.where("status = 'failed'").collect()} == bad and bad
    assert one.where("status = 'failed' AND last_error = 'Mock API error (500)'").count() == len(bad)
    two = changes.synced(one, now)
    assert two.where("status = 'synced'").count() == 40 and two.where("attempts = 2").count() == len(bad)
    assert changes.synced(q, now, online=False).where("last_error = 'Offline'").count() == 40
    assert changes.synced(q, now, no_fail=True).where("status = 'synced'").count() == 40
    forced = changes.synced(q, now, no_fail=False, fail_next=True).where("last_error = 'Mock API error (forced)'")
    assert [r.id for r in forced.collect()] == ["chg-39"]  # the newest
    twice = q.unionByName(q.limit(1))
    assert changes.synced(twice, now).count() == 41
    new = spark.createDataFrame([("e", ["b1"], 0), ("e", ["b2"], 1)], "entry_id string, blocks array<string>, pos int")
    queue = collections.prepended(q, changes.enqueued(new, now)).orderBy("seq").limit(3).collect()
    assert [r.blocks for r in queue] == [["b1"], ["b2"], ["b"]] and queue[0].id.startswith("chg-2025-12-26T13:00:00.000Z-") and queue[2].id == "chg-39"


def test_stream_agrees_with_batch(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = [(f"chg-{k}", "e", 10 * k + n, kind, datetime(2025, 1, 1, 0, 0, n, tzinfo=UTC)) for k in range(12) for n, kind in enumerate(["enqueue", "attempt", "attempt"][: 1 + k % 3])]
    spark.createDataFrame(rows, changes.EVENT).repartition(3).write.json(source)
    changes.write_latest(changes.tracked(changes.read_events(spark, source)), sink, mark).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.change_id: (r.status, r.attempts) for r in spark.read.parquet(sink).orderBy("seq").collect()}
    want = {r.change_id: (r.status, r.attempts) for r in changes.latest(spark.read.schema(changes.EVENT).json(source)).collect()}
    assert got == want


def test_one_stream_of_a_name_at_a_time(spark, tmp_path):
    start = lambda: spark.readStream.format("rate").load().writeStream.format("memory").queryName("once").start()
    first = changes.single_flight(spark, "once", start)
    try:
        assert changes.single_flight(spark, "once", start) is None
    finally:
        first.stop()
    again = changes.single_flight(spark, "once", start)
    again.stop()


def test_keep_latest(spark, tmp_path):
    row = lambda k, seq, status: (k, "e", seq, status, 1, None, None)
    path = str(tmp_path / "states")
    spark.createDataFrame([row("a", 1, "failed"), row("b", 5, "synced")], changes.STATE).write.parquet(path)
    got = changes.keep_latest(spark.createDataFrame([row("a", 2, "synced"), row("b", 4, "failed")], changes.STATE), path)
    assert {(r.change_id, r.seq, r.status) for r in got.collect()} == {("a", 2, "synced"), ("b", 5, "synced")}


def test_merge_of_versions(spark):
    base, mine, theirs = (spark.createDataFrame(rows, "entry_id string, block_id string, text string") for rows in ([("e", "1", "a"), ("e", "2", "b"), ("e", "3", "c")], [("e", "1", "A"), ("e", "2", "b"), ("e", "3", "x")], [("e", "1", "a"), ("e", "2", "B"), ("e", "3", "y")]))
    got = {r.block_id: (r.text, r.conflict) for r in joins.merged_versions(base, mine, theirs, ["entry_id", "block_id"], "text").collect()}
    assert got == {"1": ("A", False), "2": ("B", False), "3": ("x", True)}


def test_blobs(spark, tmp_path):
    path = str(tmp_path / "blobs")
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "name string, content binary")
    notebook.put_blobs(files, path)
    notebook.put_blobs(files.limit(1), path)
    keys = files.where("name = 'a'").select(F.sha2("content", 256).alias("key"))
    assert [bytes(r.content) for r in notebook.get_blobs(spark, path, keys).collect()] == [b"1"]


def test_nodes_and_updates(book, now):
    back = collections.from_nodes(collections.to_nodes(book["blocks"])).orderBy("pos").collect()
    want = book["blocks"].orderBy("pos").collect()
    assert [(r.block_id, r.type, r.text, r.level, r.locked, r["items"]) for r in back] == [(r.block_id, r.type, r.text, r.level, r.locked, r["items"]) for r in want]
    bare = book["blocks"].sparkSession.sql("SELECT 'e' AS entry_id, 3 AS pos, CAST(NULL AS string) AS id, 'table' AS type, CAST(NULL AS boolean) AS locked, 'sideways' AS align").withColumns({c: F.lit(None).cast(t) for c, t in collections.to_nodes(book["blocks"]).dtypes if c in ("children", "items", "meta")})
    row = collections.from_nodes(bare).first()
    assert (row.block_id, row.type, row.data, row.header_row, row.align) == ("b-e-3", "table", [], True, None)
    row = collections.from_nodes(bare.withColumn("type", F.lit("attachment"))).first()
    assert (row.block_id, row.type) == ("b-e-3", "divider")
    assert collections.from_nodes(bare.withColumn("type", F.lit("other"))).first().type == "paragraph"
    edited = collections.update_block(book["blocks"], "b-obs", {"text": F.lit("seen")}, now).where("text = 'seen'").collect()
    assert [(r.block_id, r.updated_by, r.updated_ts.hour) for r in edited] == [("b-obs", "me", 13)]


def test_files_of_a_sample_are_counted_apart(spark):
    a = spark.createDataFrame([(1, "s", "f"), (1, "s", "g"), (2, "s", "f"), (2, None, "h"), (9, "s", "z"), (2, "t", None)], "entry_id long, sample_id string, filename string")
    e = spark.createDataFrame([(1, "one"), (2, "two")], "id long, title string")
    got = joins.counted_files(a, e)
    assert sorted(map(tuple, got.collect())) == [("s", 2, 2), ("t", 0, 1)]
    lists = joins.mapped_files(a, e).collect()
    assert sorted((r.sample_id, len(r.files), len(r.entries)) for r in lists) == [("s", 2, 2), ("t", 0, 1)]
    # Names are keys of a shuffle, no sample's list.
    assert "collect_set" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_manifests_deal_files_out_once(spark):
    from fieldbook.plans.block_queries import manifests

    plan = manifests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entry_id#" in plan and not re.search(r"hashpartitioning\(entry_id#\d+L?, [a-z]", plan)
    assert "array_sort" not in plan
