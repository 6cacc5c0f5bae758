"""The corpus pipeline, and the library without it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
TABLES = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")


@needs_tables
def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, str(TABLES)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        # Filters keep most documents; a mix keeps what its scarcest source, language or topic allows.
        assert set(now) <= set(kept) and len(now) > (rows // 5 if name == "mixing" else rows // 2)
        if name != "line_dedup":
            assert all(now[i] == kept[i] for i in now)
        kept = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(TABLES)).collect()
    assert {p.doc_id for p in pieces} == set(kept)


@needs_tables
def test_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(TABLES)).count() == 0
        assert stage(spark, odd, str(TABLES)).count() <= 3


def test_near_copies_of_repeated_and_missing_ids(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a), (5, a + " end"), (5, b), (7, c), (7, c), (None, d), (None, d), (None, b + " end"), (None, ""), (None, ""), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, a), (5, b), (7, c), (None, d), (None, ""), (None, ""), (None, None), (8, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "fieldbook", tmp_path / "fieldbook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'filtered_entries' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_entry_with_it():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in names if q.startswith("op")} and "pipeline" in names
