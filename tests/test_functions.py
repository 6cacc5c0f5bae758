"""Column functions against values derived by hand and against small models."""

import re
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldbook.functions import arrays, text


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or (0,)
    kinds = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'bigint' if isinstance(v, int) else 'date'}" for n, v in zip(names, row, strict=True))
    return spark.createDataFrame([row], kinds).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    ("raw", "want"),
    [('  a/b: c*  é "d".md ', "a_b__c_____d_.md"), ("", "export"), ("///", "export"), ("Plan (v2).txt", "Plan_(v2).txt")],
)
def test_safe_file_name(spark, raw, want):
    assert one(spark, text.safe_file_name(F.col("x")), x=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("", 2166136261), ("chg-1", 4220800985), ("\U0001f600", 3409036472)])
def test_fnv(spark, raw, want):
    assert one(spark, text.fnv1a(F.col("x")), x=raw) == want


def test_trim_takes_all_white_space(spark):
    assert one(spark, text.tidy(F.col("x")), x="﻿\t a \n  b ") == "a b"


@pytest.mark.parametrize(("raw", "want"), [("a\tb\nc\td", [["a", "b"], ["c", "d"]]), ("a,b", None), ("x", None), ("a\t\r\nb", [["a", ""], ["b"]])])
def test_clipboard(spark, raw, want):
    got = one(spark, text.table_from_clipboard(F.col("x")), x=raw)
    assert got == (want if raw != "a\t\r\nb" else [["a", ""], ["b"]])


@pytest.mark.parametrize(("path", "label", "want"), [("\\\\srv\\a\\b.txt", None, "b.txt"), ("/x/y/", None, "y"), ("///", "scan", "scan"), ("", None, "file")])
def test_basename(spark, path, label, want):
    assert one(spark, text.basename(F.col("p"), F.col("l")), p=path, l=label) == want


def test_calendar(spark):
    days = one(spark, text.calendar_days(text.month_start(F.col("x"))), x="2024-02")
    assert (len(days), days[0], days[-1]) == (42, date(2024, 1, 29), date(2024, 3, 10))


def test_months_under_one_are_january(spark):
    assert one(spark, text.month_start(F.col("x")), x="2024-0") == date(2024, 1, 1)


@pytest.mark.parametrize(("n", "want"), [(0, "1 KB"), (1536, "2 KB"), (10240, "10 KB")])
def test_size(spark, n, want):
    assert one(spark, text.size_label(F.col("x")), x=n) == want


def test_tags(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(arrays.has_all(F.col("t"), [])).collect()] == [True, True, True]
    assert [r[0] for r in df.select(arrays.has_all(F.col("t"), ["a"])).collect()] == [True, False, False]
    assert [r[0] for r in df.where("size(t) = 2").select(arrays.toggled(F.col("t"), F.lit("a"))).collect()] == [["b"]]
    assert [r[0] for r in df.where("size(t) = 2").select(arrays.toggled(F.col("t"), F.lit("c"))).collect()] == [["a", "b", "c"]]


def test_tabs(spark):
    df = spark.createDataFrame([(list("abcde"),)], "t array<string>")
    row = df.select(arrays.opened(F.col("t"), F.lit("z")).alias("new"), arrays.opened(F.col("t"), F.lit("c")).alias("old"), arrays.closed(F.col("t"), F.lit("a")).alias("less")).first()
    assert (row.new, row.old, row.less) == (list("zabcd"), list("abcde"), list("bcde"))


def test_tables(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]],)], "d array<array<string>>")
    row = df.select(arrays.with_row(F.col("d")).alias("r"), arrays.with_column(F.col("d")).alias("c"), arrays.with_cell(F.col("d"), 1, 0, F.lit("x")).alias("x")).first()
    assert row.r == [["a", "b"], ["c"], ["", ""]]
    assert row.c == [["a", "b", ""], ["c", ""]]
    assert row.x == [["a", "b"], ["x"]]


def test_last_key_wins(spark):
    df = spark.sql("SELECT array(struct('a' AS key, 1 AS value), struct('b' AS key, 2 AS value), struct('a' AS key, 3 AS value)) AS e")
    assert df.select(arrays.last_wins(F.col("e"))).first()[0] == {"a": 3, "b": 2}


def test_checklists(spark):
    df = spark.sql("SELECT array(named_struct('id', 'i', 'text', 'one two', 'done', true), named_struct('id', 'j', 'text', ' ', 'done', false)) AS items")
    cut = df.select(arrays.split_item(F.col("items"), F.lit("i"), F.lit(3), F.lit("k"))).first()[0]
    assert [(r.id, r.text, r.done) for r in cut] == [("i", "one", True), ("k", " two", False), ("j", " ", False)]
    assert [r.id for r in df.select(arrays.without_blank_item(F.col("items"), F.lit("j"))).first()[0]] == ["i"]
    assert [r.done for r in df.select(arrays.done_set(F.col("items"), F.lit("j"), F.lit(True))).first()[0]] == [True, True]


def model_safe(name):
    cleaned = re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|]+', "_", name.strip())).strip()
    return re.sub(r"^_+|_+$", "", re.sub(r" +", "_", re.sub(r"[^a-zA-Z0-9 ._()-]+", "_", cleaned))) or "export"


def model_fnv(value):
    h = 2166136261
    data = value.encode("utf-16-le")
    for k in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[k : k + 2], "little")) * 16777619 % 2**32
    return h


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from('aB/ :*"<.é_()\t'), max_size=12), min_size=1, max_size=60))
def test_models_agree(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.safe_file_name(F.col("n")).alias("safe"), text.fnv1a(F.col("n")).alias("h")).collect()
    assert [r.safe for r in rows] == [model_safe(r.n) for r in rows]
    assert [r.h for r in rows] == [model_fnv(r.n) for r in rows]
