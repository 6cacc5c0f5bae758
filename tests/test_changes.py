"""Debounced streams, whole overwrites, one flight of several drivers, files with a fallback, and untyped nodes."""

import os
import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import collections, joins
from fieldbook.sources import notebook
from fieldbook.sources.commits import Snapshot, lease
from fieldbook.streaming import changes

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def test_a_debounced_stream_equals_sessions(spark, tmp_path):
    """Events come in many batches, out of order within the time that is waited for late ones."""
    r = random.Random(3)
    rows, at = [], dict.fromkeys("abc", 0.0)
    for n in range(160):
        k = r.choice("abc")
        at[k] += r.choice([0.0, 0.3, 0.899, 0.9, 0.901, 1.5, 4.0])
        rows.append((k, "e", n, "enqueue", T0 + timedelta(seconds=round(at[k], 3))))
    rows.sort(key=lambda x: x[4] + timedelta(seconds=r.uniform(0, 4)))
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(0, len(rows), 20):
        spark.createDataFrame(rows[k : k + 20], changes.EVENT).coalesce(1).write.mode("append").json(source)
        time.sleep(0.05)
    stream = spark.readStream.schema(changes.EVENT).option("maxFilesPerTrigger", 1).json(source)
    out = changes.debounced(stream, "change_id", "ts", 900, "5 seconds")
    start = lambda: out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", sink).trigger(availableNow=True).start().awaitTermination(300)
    start()
    # Later events of another key let the watermark pass; the stream goes on from its checkpoint.
    for k in (1, 2):
        spark.createDataFrame([("end", "e", 999 + k, "enqueue", T0 + timedelta(hours=k))], changes.EVENT).coalesce(1).write.mode("append").json(source)
        start()
    got = sorted((x.key, x.events, x.first, x.last) for x in spark.read.parquet(sink).where("key <> 'end'").collect())
    batch = changes.sessions(spark.createDataFrame(rows, changes.EVENT), "change_id", "ts", 0.9).collect()
    assert got == sorted((x.change_id, x.events, x.first, x["last"]) for x in batch) and len(got) > 20


def states(spark, *rows):
    return spark.createDataFrame([(k, "e", seq, status, 1, None, None) for k, seq, status in rows], changes.STATE)


def test_a_stream_overwrites_the_whole(spark, tmp_path):
    source, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))

    def run():
        stream = changes.read_events(spark, source)
        rows = stream.select("change_id", "entry_id", "seq", F.col("kind").alias("status"), F.lit(1).alias("attempts"), F.col("ts").alias("last_tried_ts"), F.lit(None).cast("string").alias("last_error"))
        changes.overwrite_latest(rows, table, mark).trigger(availableNow=True).start().awaitTermination(120)
        return {x.change_id: (x.seq, x.status) for x in Snapshot(spark, table).read().collect()}

    event = lambda *rows: spark.createDataFrame([(k, "e", seq, kind, T0) for k, seq, kind in rows], changes.EVENT).write.mode("append").json(source)
    event(("a", 1, "x"), ("b", 2, "x"))
    assert run() == {"a": (1, "x"), "b": (2, "x")}
    event(("a", 3, "y"), ("b", 1, "old"), ("c", 4, "z"))
    assert run() == {"a": (3, "y"), "b": (2, "x"), "c": (4, "z")}
    held = Snapshot(spark, table)
    assert not held.write(states(spark, ("q", 1, "again")), number=1)  # the batch is there already
    assert held.read().count() == 3
    for name in ("1", ".1.crc"):
        os.remove(f"{mark}/commits/{name}")  # killed after the table was written and before the batch counted as done
    assert run() == {"a": (3, "y"), "b": (2, "x"), "c": (4, "z")}


def test_one_flight_of_two_drivers(spark, tmp_path):
    other, folder = spark.newSession(), str(tmp_path / "flight")
    start = lambda s: s.readStream.format("rate").load().writeStream.format("noop").queryName("sync").start()
    first = changes.single_flight(spark, "sync", lambda: start(spark), folder, 6)
    try:
        assert first and changes.single_flight(other, "sync", lambda: start(other), folder, 6) is None
        time.sleep(7)  # renewed while it runs
        assert changes.single_flight(other, "sync", lambda: start(other), folder, 6) is None
    finally:
        first.stop()
    deadline = time.time() + 20
    while (second := changes.single_flight(other, "sync", lambda: start(other), folder, 6)) is None and time.time() < deadline:
        time.sleep(0.3)
    assert second
    second.stop()


def test_a_failed_start_lets_others_in(spark, tmp_path):
    with pytest.raises(ZeroDivisionError):
        changes.single_flight(spark, "bad", lambda: 1 // 0, str(tmp_path / "f"), 60)
    assert lease(spark, str(tmp_path / "f"), 60)


def test_files_go_to_the_folder_or_to_the_blobs(spark, tmp_path):
    files = spark.createDataFrame([("a.txt", bytearray(b"one"), 1), ("b/c.txt", bytearray(b"two"), 2), ("ü 1.pdf", bytearray(b""), 3), (None, bytearray(b"four"), 4)], "name string, content binary, n int")
    folder, blobs = tmp_path / "cache", str(tmp_path / "blobs")
    folder.mkdir()
    key = lambda c: __import__("hashlib").sha256(c).hexdigest()
    out = {x.n: x.cached_path for x in notebook.cache_files(files, str(folder), blobs, str(tmp_path / "o1"), 1700).collect()}
    assert out == {1: "fs://1700-a.txt", 2: f"idb://{key(b'two')}", 3: "fs://1700-ü 1.pdf", 4: f"idb://{key(b'four')}"}
    assert sorted(p.name for p in folder.iterdir()) == ["1700-a.txt", "1700-ü 1.pdf"]
    nowhere = {x.n: x.cached_path for x in notebook.cache_files(files, str(tmp_path / "missing"), blobs, str(tmp_path / "o2"), 5).collect()}
    assert all(p.startswith("idb://") for p in nowhere.values())
    held = spark.read.parquet(blobs)
    thumb = "data:text/plain;base64,aGk="
    rows = [(k, p, thumb) for k, p in out.items()] + [(9, "fs://none", thumb), (10, "idb://none", thumb), (11, None, thumb), (12, "", "data:,a%20b"), (13, None, "http://x/1"), (14, None, "http://x/2"), (15, None, None), (16, None, "data:;base64,!!"), (17, "fs://../o1/_SUCCESS", thumb)]
    att = spark.createDataFrame(rows, "id int, cached_path string, thumbnail string")
    web = spark.createDataFrame([("http://x/1", bytearray(b"web"))], "url string, content binary")
    got = {x.id: bytes(x.content) for x in notebook.attachment_contents(att, str(folder), held, web).collect()}
    assert got == {1: b"one", 2: b"two", 3: b"", 4: b"four", 11: b"hi", 12: b"a b", 13: b"web"}
    assert 1 not in {x.id for x in notebook.attachment_contents(att, None, held, web).collect()}
    shown = att.withColumn("url", F.when(F.col("id") == 11, "http://x/1"))
    assert {x.id: bytes(x.content) for x in notebook.attachment_contents(shown, None, held, web).collect()}[11] == b"web"


def test_titles_follow_quick_capture_alone(spark, now):
    users = notebook.seed(spark, "users")
    day, other = datetime(2025, 1, 1).date(), datetime(2025, 1, 2).date()
    wanted = spark.createDataFrame([("1", 1, None, True, None, day), ("2", 2, " ", None, True, day), ("3", 3, None, None, None, day), ("4", 4, "own", None, True, other), ("5", 5, None, False, True, other)], "id string, seq long, title string, is_daily boolean, quick_capture boolean, date_bucket date").withColumns({"project_id": F.lit("p"), "experiment_id": F.lit(None).cast("string")})
    made = {x.id: (x.title.split(" – ")[0], x.is_daily) for x in notebook.created_entries(wanted, users, now).collect()}
    assert made == {"1": ("Untitled note", True), "2": ("Quick capture", True), "3": ("Untitled note", False), "4": ("own", True), "5": ("Quick capture", False)}
    none = wanted.limit(0)
    assert {x.id for x in notebook.new_days(wanted, none).collect()} == {"1", "3", "4"}
    there = spark.createDataFrame([(other, True), (day, False)], "date_bucket date, is_daily boolean")
    assert {x.id for x in notebook.new_days(wanted, there).collect()} == {"1", "3"}


@pytest.fixture
def now():
    return F.lit("2025-12-26 13:00:00").cast("timestamp")


def test_many_instants(spark):
    r = random.Random(2)
    versions = [(r.choice("ab"), r.randrange(40), k) for k in range(60)]
    asked = [(k, t) for k in "abc" for t in range(-2, 45, 3)]
    stamp = lambda df, c: df.withColumn(c, F.timestamp_seconds(F.col(c) * 40_000))
    history = joins.validity(stamp(spark.createDataFrame(versions, "k string, ts long, v int"), "ts"), ["k"], "ts", "v").drop("ts")
    got = {(x.k, x.n): x.v for x in joins.at_instants(history, stamp(spark.createDataFrame([(k, t, t) for k, t in asked], "k string, n long, at long"), "at"), ["k"], "at", 100_000).collect()}
    want = {(k, t): max((s, v) for j, s, v in versions if j == k and s <= t)[1] for k, t in asked if any(j == k and s <= t for j, s, _ in versions)}
    assert got == want


def test_odd_json(spark):
    texts = [None, "", "null", "7", "{}", "[]", "[null, 1, [], {}, {\"children\": {}}]", '[{"type":"image","children":[{"text":"x"}],"meta":[1]}]']
    rows = collections.nodes_of_json(spark.createDataFrame(list(enumerate(texts)), "entry_id int, nodes string"))
    assert sorted((x.entry_id, x.pos, x.type, len(x.children), x.meta) for x in rows.collect()) == [(6, k, "paragraph", 0, None) for k in range(5)] + [(7, 0, "image", 1, None)]
    assert {x.type for x in collections.from_nodes(rows).collect()} == {"paragraph"}
