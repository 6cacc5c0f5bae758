"""The stemmer, weights, the kept index, and versions in a shared folder."""

import itertools
import math
import random
import re
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldbook.functions.stem import measure, stem_sql, stem_word
from fieldbook.operators import search
from fieldbook.operators.postings import Postings
from fieldbook.plans import block_queries
from fieldbook.plans.catalog import SQL
from fieldbook.sources.commits import Commits, Snapshot, lease, shared_folder

# Examples of the published description, word and stem.
STEMS = """
caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll cry cri say say by by is is
""".split()


@pytest.mark.parametrize("word, stem", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, stem):
    assert stem_word(word) == stem


@pytest.mark.parametrize("word, m", [("tr", 0), ("ee", 0), ("y", 0), ("by", 0), ("trouble", 1), ("oats", 1), ("trees", 1), ("ivy", 1), ("troubles", 2), ("private", 2), ("oaten", 2), ("orrery", 2)])
def test_measure(word, m):
    assert measure(word) == m


@pytest.mark.parametrize("word, stem", [("6d3e417d62c7155ed", "6d3e417d62c7155"), ("a__ing", "a__"), ("u..eds", "u.."), ("uééed", "uéé"), ("cyyed", "cyi"), ("a1bbed", "a1b"), ("a1lled", "a1ll")])
def test_only_pairs_of_consonant_letters_lose_one(word, stem):
    assert stem_word(word) == stem


def test_stems_of_odd_words_equal_their_sql():
    odd = sorted({"".join(x) + end for k in range(5) for x in itertools.product("ayl1.éb", repeat=k) for end in ("ed", "ing", "eeds", "y", "e")})
    rows = duckdb.execute(f"SELECT term, {stem_sql('term')} FROM (SELECT unnest(?) AS term)", [odd]).fetchall()
    assert len(rows) == len(odd) and [r for r in rows if stem_word(r[0]) != r[1]] == []


def test_index_stems_of_hexadecimal_words_equals_its_sql(spark, tmp_path):
    docs = spark.createDataFrame([(1, "keys 6d3e417d62c7155ed and 6d3e417d62c7155"), (2, "hopped hop a__ing")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = block_queries.index_stems(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.execute(SQL["index_stems"]).fetchall()
    assert sorted(map(tuple, got.select("term", "n").collect())) == sorted(want) and ("6d3e417d62c7155", 2) in want


def test_words_as_parts_without_marks(spark):
    odd = ["", None, "a-b", "--x--", "...a.b...", "e.g. (this) [that]", "é été naïve", "_x_ 'quoted'", "tab\tand\nline", "- . -", "ABC-def--GHI", "x" * 3000 + "!" * 3000, "\U0001f600 a\U0001f600b"]
    frame = spark.createDataFrame([(t,) for t in odd], "t string").select(search.terms_of(F.col("t")).alias("w"))
    trim = lambda w: re.sub(r"^[^a-zA-Z0-9_]+|[^a-zA-Z0-9_]+$", "", w)
    want = [[x for x in map(trim, re.split(r"[ \t\n\x0b\f\r\-]+", (t or "").lower())) if x] for t in odd]
    assert [r.w for r in frame.collect()] == want


DOCS = "id long, title string, tags string, body string, attachments string"


def plain_scores(docs, clauses):
    """id -> score of clauses (term, field, weight), by the formula in words."""
    fields = ["title", "tags", "body", "attachments"]
    own = {d[0]: {f: [w for w in (d[k + 1] or "").lower().split() if w] for k, f in enumerate(fields)} for d in docs}
    df = {t: sum(t in o[f] for o in own.values() for c, g, _ in clauses for f in ([g] if g else fields) if c == t) for t, _, _ in clauses}
    out = {}
    for i, o in own.items():
        for f in fields:
            weights = {}
            for t, g, w in clauses:
                if g in (None, f) and any(t in x[f] for x in own.values()):
                    weights[t] = weights.get(t, 0) + w
            size = math.sqrt(sum(w * w for w in weights.values()))
            mean = sum(len(x[f]) for x in own.values()) / len(own)
            for t, w in weights.items():
                tf, n = o[f].count(t), len(o[f])
                if tf:
                    idf = math.log(1 + abs((len(own) - df[t] + 0.5) / (df[t] + 0.5)))
                    out[i] = out.get(i, 0) + w / size * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    return {i: round(s, 9) for i, s in out.items()}


def test_weights_change_the_order(spark, tmp_path):
    docs = [(1, "cell dose", "red", "cell", ""), (2, "dose", "blue", "dose dose cell wall", ""), (3, "wall", "cell", "wall", None), (4, None, "", "", "")]
    kept = Postings(spark, str(tmp_path / "ix"), stop_words=frozenset(), stem=False)
    frame = spark.createDataFrame(docs, DOCS)
    kept.update(frame)
    got = lambda q: {r.id: round(r.score, 9) for r in kept.ranked(frame, q).collect()}
    assert got("cell dose") == plain_scores(docs, [("cell", None, 1), ("dose", None, 1)])
    assert got("cell dose^9") == plain_scores(docs, [("cell", None, 1), ("dose", None, 9)])
    assert got("tags:cell^3 dose") == plain_scores(docs, [("cell", "tags", 3), ("dose", None, 1)])
    order = lambda q: [r.id for r in search.best(kept.ranked(frame, q), 2).collect()]
    assert order("wall^9 cell") != order("wall cell^9")
    assert got("-cell") == {4: 0.0} and got("nofield:x") == {} and got(" ") == dict.fromkeys((1, 2, 3, 4), 0.0)


@pytest.mark.parametrize("stem", [False, True])
def test_updates_equal_a_rebuild(spark, tmp_path, monkeypatch, stem):
    monkeypatch.setattr("fieldbook.operators.postings.SEGMENTS", 3)
    r = random.Random(5)
    text = lambda: " ".join(r.choice(["cell", "cells", "dose", "wall", "walled", "redness", "blue-green", "thorn", "thor"]) for _ in range(r.randrange(0, 9)))
    now = {k: (k, text(), text(), text(), text()) for k in range(60)}
    kept = Postings(spark, str(tmp_path / "kept"), stem=stem, parts=4)
    kept.update(spark.createDataFrame(list(now.values()), DOCS))
    for _ in range(4):
        changed, gone = r.sample(range(70), 8), r.sample(range(60), 3)
        now |= {k: (k, text(), text(), text(), text()) for k in changed}
        new = [now[k] for k in changed if k not in gone]
        for k in gone:
            now.pop(k, None)
        kept.update(spark.createDataFrame(new, DOCS), spark.createDataFrame([(k,) for k in gone], "id long"))
    kept.update(spark.createDataFrame([], DOCS))
    frame = spark.createDataFrame(list(now.values()), DOCS)
    fresh = Postings(spark, str(tmp_path / "fresh"), stem=stem, parts=4)
    fresh.update(frame)

    def same():
        assert kept._segments()[1] == fresh._segments()[1]
        for q in ["cell", "+cell -dose", "thor* blue~1^3", "tags:wall^2 green", "-cell"]:
            answers = [sorted((x.id, round(x.score, 9)) for x in ix.ranked(frame, q).collect()) for ix in (kept, fresh)]
            assert answers[0] == answers[1], q

    same()
    kept.merge()
    kept.sweep()
    assert len(kept._segments()[0]) == 1 and len(list((tmp_path / "kept" / "postings").glob("segment=*"))) == 1
    same()


def test_a_query_reads_only_its_terms_parts(spark, tmp_path):
    kept = Postings(spark, str(tmp_path), ["body"], frozenset(), stem=False, parts=16)
    kept.update(spark.createDataFrame([(k, f"w{k} w{k + 1}") for k in range(200)], "id long, body string"))
    assert len(list(tmp_path.glob("postings/*/part=*"))) == 16
    plan = kept.postings([search.Clause("w7")])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (=|IN) ", plan)
    assert sorted(x.id for x in kept.postings([search.Clause("w7")]).collect()) == [6, 7]
    assert sorted(x.id for x in kept.postings([search.Clause("w19*")]).select("id").distinct().collect()) == [18, 19, *range(189, 200)]


@pytest.mark.parametrize("bytewise, want", [(True, [1, 2]), (False, [1, 2, 3])])
def test_edits_of_bytes_or_characters(spark, tmp_path, bytewise, want):
    docs = spark.createDataFrame([(1, "oner"), (2, "one"), (3, "onér"), (4, "onère")], "id long, body string")
    kept = Postings(spark, str(tmp_path / "index"), ["body"], frozenset(), stem=False, bytewise=bytewise)
    kept.update(docs)
    assert sorted(r.id for r in kept.search(docs.select("id"), "oner~1").collect()) == want
    words = search.words(docs, ["body"], frozenset())
    assert sorted(r.id for r in search.search(docs, words, "oner~1", ["body"], stem=False, bytewise=bytewise).collect()) == want


@pytest.mark.parametrize("meant", [0, 1000])
def test_a_wildcard_shuffles_no_postings(spark, tmp_path, monkeypatch, meant):
    monkeypatch.setattr("fieldbook.operators.postings.MEANT", meant)
    docs = spark.createDataFrame([(1, "thorn oner"), (2, "one two"), (3, ""), (4, None)], "id long, body string")
    kept = Postings(spark, str(tmp_path / "index"), ["body"], frozenset(), stem=False)
    kept.update(docs)
    rows = kept.postings(search.parse("tho* oner~1", ["body"], stem=False))
    assert sorted((r.id, r.term) for r in rows.collect()) == [(1, "oner"), (1, "thorn"), (2, "one")]
    assert not re.search("Exchange|Join", rows._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.term for r in kept.terms().collect()) == ["one", "oner", "thorn", "two"]
    everything = kept.postings(search.parse("*", ["body"], stem=False))
    assert sorted(r.term for r in everything.collect()) == ["one", "oner", "thorn", "two"]
    assert sorted(map(tuple, kept.lengths().collect())) == [(1, 2), (2, 2)]


def test_an_entrys_terms_are_counted_before_a_shuffle(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "b a b  b c a"), (2, ""), (3, None), (4, "x")], "id long, body string")
    made = []
    monkeypatch.setattr(Postings, "_write", lambda self, rows, *rest: made.append(rows) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        Postings(spark, str(tmp_path / "index"), ["body"], frozenset(), stem=False).update(docs)
    rows = made[0]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in rows.where("term IS NOT NULL").select("id", "term", "tf", "n").collect())
    assert got == [(1, "a", 2, 6), (1, "b", 3, 6), (1, "c", 1, 6), (4, "x", 1, 1)]


@pytest.mark.parametrize("stem", [True, False])
def test_vocabulary_equals_the_index_and_has_no_ids(spark, stem):
    docs = spark.createDataFrame([(1, "cats cat the", "cat"), (2, "ponies", None), (1, "cat", "pony"), (3, "", "the")], "id long, body string, title string")
    got = search.vocabulary(docs, ["body", "title"], stem=stem)
    want = search.index(docs, ["body", "title"], stem=stem).groupBy("term").agg(F.sum("tf").alias("n"))
    assert got.columns == ["term", "n"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and not re.search(r"Aggregate \[id", plan)


def test_a_version_is_made_once(spark, tmp_path):
    folder = str(tmp_path / "v")
    won = []
    each = [Commits(spark, folder) for _ in range(8)]
    threads = [threading.Thread(target=lambda c=c, k=k: won.append(k) if c.add(5, {"by": k}) else None) for k, c in enumerate(each)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and each[0].latest() == (5, {"by": won[0]}) and not each[0].add(5, {})
    assert [p.name for p in (tmp_path / "v").glob("*.json")] == ["000000000005.json"]


def test_snapshot_is_old_or_new(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"))
    assert table.read() is None
    rows = lambda n: spark.range(n).withColumn("n", F.lit(n))
    assert table.write(rows(3)) and table.read().count() == 3
    reader = table.read()
    assert table.write(rows(5)) and not table.write(rows(9), number=1)
    assert reader.count() == 3 and table.read().count() == 5  # who began earlier reads on

    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).cast("long").alias("id"), F.lit(1).alias("n"))
    with pytest.raises(Exception, match="killed"):
        table.write(bad, number=2)
    assert table.read().count() == 5  # a killed batch shows nothing
    assert table.write(rows(7), number=2) and table.read().count() == 7 and not table.write(rows(7), number=2)
    assert table.write(rows(0)) and table.read().count() == 0
    assert len(list((tmp_path / "t").glob("data-*/_SUCCESS"))) == 2


def test_lease(spark, tmp_path):
    folder = str(tmp_path / "lease")
    first = lease(spark, folder, 60, now=1000)
    assert first and lease(spark.newSession(), folder, 60, now=1059) is None
    assert first.renew(60, now=1050) and lease(spark, folder, 60, now=1105) is None
    second = lease(spark.newSession(), folder, 60, now=1111)
    assert second and not first.renew(60, now=1112)  # expired, and lost
    second.release()
    assert lease(spark, folder, 60, now=1113)
    held = []
    threads = [threading.Thread(target=lambda: held.append(lease(spark, str(tmp_path / "many"), 60))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(h is not None for h in held) == 1


def test_shared_folder(spark):
    assert shared_folder(spark, "a") != shared_folder(spark, "a")
