"""Jaccard join, mixing, URL filters, suffix dedup and nearest neighbours against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.llm import common, jaccard_join, mixing, nearest, suffix_dedup, url_filters
from fieldbook.llm.common import Scratch, connected

from .test_text_operators import ODD, WORDS, documents, texts


def components(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_connected(spark, both_ways):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {x.node: x.root for x in connected(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    want = components(links, {n for l in links for n in l})
    assert got == {n: c for n, c in want.items() if any(a != b and n in (a, b) for a, b in links)}
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.fixture(params=["broadcast", "shuffled"])
def both_ways(request, spark, monkeypatch):
    """Small tables broadcast; and shuffled as large ones are, with hot keys dealt out."""
    if request.param == "shuffled":
        monkeypatch.setattr(common, "LEAST", 3)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def plain_jaccard(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(s), components(links, sets)[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "num", "cell"), [(4, 85, 1 << 19), (5, 80, 64), (2, 50, 1 << 19)])
def test_jaccard_against_brute_force(spark, monkeypatch, both_ways, words, num, cell):
    monkeypatch.setattr(jaccard_join, "CELL_SHINGLES", cell)
    r = random.Random(words)
    rows = []
    for k, base in enumerate(texts(11, 12, 8)):
        for c in range(r.choice([1, 2, 9])):
            t = base.split(" ")
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = "changed"
            rows.append((1000 - 10 * k - c, " ".join(t)))
    rows += [(i, t) for i, t in dict(ODD).items() if i is not None] + [(50, "ONE"), (51, "ab cd ef"), (52, "AB\tcd\x0bef"), (53, "\n ")]
    got = jaccard_join.link_documents(documents(spark, rows, ["key", "n", "token", "component_id"]), words, num, 100)
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got.collect()} == plain_jaccard(rows, words, num, 100)


@pytest.mark.parametrize(("words", "num"), [(5, 80), (3, 60)])
def test_jaccard_of_many_near_sets(spark, both_ways, monkeypatch, words, num):
    """Large groups of near copies whose sizes and similarities lie on both sides of the bound."""
    monkeypatch.setattr(jaccard_join, "CELL_MEMBERS", 24)
    r = random.Random(num)
    rows = []
    for base in texts(num, 5, 14):
        t = base.split()
        for _ in range(r.choice([3, 60])):
            own = t[r.randrange(4) : len(t) - r.randrange(40)]
            for _ in range(r.randrange(6)):
                own[r.randrange(len(own))] = f"edit{r.randrange(3)}"
            rows.append((len(rows), " ".join(own)))
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in jaccard_join.link_documents(documents(spark, rows), words, num, 100).collect()}
    assert got == plain_jaccard(rows, words, num, 100)
    assert 5 < len({c for _, c in got.values()}) < len(rows) - 20


@pytest.mark.parametrize(("words", "edits"), [(200, [1, 2, 3, 3, 4, 10]), (60, [1, 1, 2, 3])])
def test_jaccard_of_heavy_cells(spark, monkeypatch, words, edits):
    """2500 edits of one text, of which many (200 words) or few (60) are linked, and 2500 texts that share a passage: whole results, the former with less than half the rows of all pairs of blocks."""
    r = random.Random(5)
    body, passage = [f"w{k}" for k in range(words)], [f"p{k}" for k in range(40)]
    rows = []
    for i in range(2500):
        own = list(body)
        for _ in range(r.choice(edits)):
            own[r.randrange(words)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(own)))
        rows.append((i + 2500, " ".join(passage + [f"u{i}-{k}" for k in range(r.randrange(18, 26))])))
    met, pairs = [], []
    plain, cells_of = jaccard_join.verified, jaccard_join.cells_of

    def counted(*args):
        cells = cells_of(*args)
        pairs.append(cells.agg(F.sum("blocks")).first()[0])
        return cells

    monkeypatch.setattr(jaccard_join, "cells_of", counted)
    monkeypatch.setattr(jaccard_join, "verified", lambda cells, num, den: met.append(cells.count()) or plain(cells, num, den))
    got = {g.doc_id: g.component_id for g in jaccard_join.link_documents(documents(spark, rows), 5, 80, 100).collect()}

    names: dict[tuple, int] = {}
    sets = [{names.setdefault(tuple(w[k : k + 5]), len(names)) for k in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    holders = Counter(x for s in sets for x in s)
    column = {x: k for k, x in enumerate(x for x, n in holders.items() if n > 1)}
    m = np.zeros((len(sets), len(column)), np.float32)
    for k, s in enumerate(sets):
        m[k, [column[x] for x in s if x in column]] = 1
    both, n = m @ m.T, np.array([len(s) for s in sets])
    links = [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(np.triu(180 * both >= 80 * (n[:, None] + n[None, :]), 1)), strict=True)]
    assert got == components(links, [i for i, _ in rows])
    print("rows of cells", met, "of all pairs of blocks", pairs)
    assert words < 200 or sum(met) < pairs[0] / 2


def test_pairs_of_groups_lose_no_link():
    """Every linked pair passes the filter in the cell of its first shared kept shingle."""
    r = np.random.default_rng(3)
    num, den = 80, 100
    for _ in range(300):
        whole = r.integers(0, 1 << 62, 90)
        a, b = (np.unique(r.choice(whole, r.integers(60, 90), replace=False)) for _ in range(2))
        if (den + num) * len(np.intersect1d(a, b)) < num * (len(a) + len(b)):
            continue
        kept = [s[: len(s) - jaccard_join.at_least(len(s), num, den) + jaccard_join.spare(len(s))] for s in (a, b)]
        shared = np.intersect1d(*kept)
        rest = [int((k >= shared[0]).sum()) for k in kept]
        assert jaccard_join.pairs_of_groups(np.array([len(a), len(b)]), np.array([True, False]), np.array(rest), num, den)[0, 1]


def test_jaccard_edge_cases(spark):
    got = jaccard_join.link_documents(documents(spark, ODD))
    rows = [(g.doc_id, g.component_id) for g in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (6, 5), (None, None)], key=str)
    assert jaccard_join.link_documents(documents(spark, [])).count() == 0


def plain_raking(cells, power, budget, rounds=400):
    """Weights of at most a cell's tokens over the budget: each value's factor is found by bisection."""
    w = {k: float(v) for k, v in cells.items() if v}
    total = sum(w.values())
    for _ in range(rounds):
        for d in range(3):
            have = Counter()
            for k in w:
                have[k[d]] += cells[k]
            whole = sum(n**power for n in have.values())
            for v, n in have.items():
                own, goal = [k for k in w if k[d] == v], n**power / whole * total
                low, high = 0.0, 1e9
                for _ in range(120):
                    f = (low + high) / 2
                    low, high = (f, high) if sum(min(cells[k] / budget, f * w[k]) for k in own) < goal else (low, f)
                for k in own:
                    w[k] *= low
    return {k: min(x, cells[k] / budget) for k, x in w.items()}


@pytest.mark.parametrize(("few", "budget"), [(20_000, 0.5), (20_000, 1.0), (0, 0.7)])
def test_mixing_against_plain_raking(spark, monkeypatch, both_ways, few, budget):
    """Some cells are full, and the shares are still the targets."""
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-8)
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(1, 30), r.choice(["en"] * 6 + ["de", None]), r.choice(["a"] * 5 + ["b", "c"]), 0, r.choice("xyz")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, topic string").withColumn("_all", F.lit(1)).withColumn("tokens", F.lit("mine"))
    got = mixing.mix(docs, {n: F.col(n) for n in ("source", "lang", "topic")}, power=0.6, budget=budget).collect()
    cells, chances = Counter(), {}
    for g in got:
        cells[g.source, g.lang, g.topic] += g.tokens
        chances[g.source, g.lang, g.topic] = g.probability
    asked = sum(cells[k] * p for k, p in chances.items()) / sum(cells.values())
    assert 0.2 < asked <= budget and max(chances.values()) <= 1
    if budget > 0.5:
        assert max(chances.values()) == 1
    want = plain_raking(cells, 0.6, asked, 60 if few == 0 else 200)
    for k, p in chances.items():
        assert abs(p - asked * want[k] / cells[k]) < 1e-4
    for d in range(3):
        tokens, mixed = Counter(), Counter()
        for k, n in cells.items():
            tokens[k[d]] += n
            mixed[k[d]] += n * chances[k]
        whole = sum(n**0.6 for n in tokens.values())
        assert all(abs(mixed[v] / sum(mixed.values()) / (n**0.6 / whole) - 1) < 1e-3 for v, n in tokens.items())
    assert abs(sum(g.sampled for g in got) - sum(g.probability for g in got)) < 60


@pytest.mark.parametrize("few", [20_000, 0])
def test_mixing_tells_of_impossible_targets(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    monkeypatch.setattr(mixing, "GIVE_UP", 4)
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    docs = spark.createDataFrame([(1, "a a", "en", "x"), (2, "b b", "de", "y")], "doc_id long, text string, lang string, source string")
    share = lambda rows: spark.createDataFrame(rows, "value string, share double")
    with pytest.warns(UserWarning, match="no weights have all target shares"):
        got = mixing.mix(docs, {n: F.col(n) for n in ("lang", "source")}, {"lang": share([("en", 0.9), ("de", 0.1)]), "source": share([("x", 0.5), ("y", 0.5)])}).collect()
    assert [round(g.cell_weight, 6) for g in sorted(got)] == [2, 2]


def test_mixing_edge_cases(spark):
    docs = documents(spark, ODD)
    dims = {n: F.col(n) for n in ("source", "lang")}
    got = mixing.mix(docs, dims).collect()
    assert len(got) == len(ODD) and all(0 < g.probability <= 1 for g in got) and all(g.probability == 1 for g in got if not g.tokens)
    assert all(g.probability == pytest.approx(1) for g in mixing.mix(docs, dims, power=1).collect())
    target = spark.createDataFrame([("s", 0.5), ("absent", 0.5)], "value string, share double")
    assert mixing.mix(docs, dims, {"source": target}).agg(F.max("probability")).first()[0] == pytest.approx(1)
    assert mixing.mix(docs.limit(0), dims).count() == 0
    assert mixing.mix(docs.where("text IS NULL"), dims).first().sampled
    topics = spark.createDataFrame([(5, 2), (5, 1), (None, 3), (3, None)], "vec_id long, label int")
    assert {r.doc_id: r.topic for r in mixing.with_topic(docs.withColumn("topic", F.lit("mine")), topics).collect()}[5] == "1"


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("com/fr/", "allow")]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://a.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en", "example.org", "/en", "org/", "allow"),
        ("http://notexample.org.com/fr/9#a", "notexample.org.com", "/fr/9", "com/fr/", "allow"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("://h/p?q://z", "h", "/p", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filters.judge(pages, labels, RULES).drop("page_id", "url").first() == (host, path, rule, verdict)


def test_mined_rules(spark, both_ways):
    r = random.Random(2)
    rows = [(i, f"http://{r.choice(['spam', 'good', 'mixed'])}.net/{r.choice(['win', 'read'])}/{i % 4}") for i in range(300)]
    label = lambda u: "spam" in u or ("mixed" in u and "win" in u)
    labels = spark.createDataFrame([(i, int(not label(u)), 0) for i, u in rows[:200]] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([*rows, (None, None), (1, rows[1][1])], "page_id long, url string").withColumn("key", F.lit("mine")).withColumn("own", F.lit("mine"))
    got = url_filters.judge(pages, labels, [])
    assert got.count() == len(rows) + 2
    tokens = lambda u: set(re.findall(r"[a-z0-9]+", u.split("//")[1].split("/")[0])) | {"/" + w for w in u.split("/")[3:]}
    seen, hit = Counter(), Counter()
    for _, u in rows[:200]:
        for n in (1, 2, 3):
            for c in combinations(sorted(tokens(u)), n):
                seen[c] += 1
                hit[c] += label(u)
    mined = [set(c) for c in seen if hit[c] >= 5 and hit[c] >= 0.5 * seen[c]]
    assert all((g.verdict == "block") == bool(g.url and any(m <= tokens(g.url) for m in mined)) for g in got.collect())
    index = [set(x["items"]) for x in url_filters.mine(pages, labels)[0].collect()]
    assert {"h:spam"} in index and not any(a < b for a in index for b in index)
    assert url_filters.judge(pages.limit(0), labels, RULES).count() == 0


def test_rare_bad_hosts_of_large_tables(spark, both_ways):
    rows = [(i, f"http://host{i % 40}.net/page/{i % 7}") for i in range(4000)] + [(5000 + i, f"http://rare.net/page/{i}") for i in range(6)]
    labels = spark.createDataFrame([(i, int("rare" not in u), 0) for i, u in rows], "doc_id long, quality int, toxic int")
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, []).collect()
    assert {g.host for g in got if g.verdict == "block"} == {"rare.net"}


def test_rules_of_four_tokens(spark, both_ways):
    """Each part of {a, b, c, d} has six bad pages and more good ones; all four together are bad."""
    four = ["a", "b", "c", "d"]
    urls = [("http://h.net/" + "/".join(four), False)] * 6 + [("http://h.net/" + "/".join(x for x in four if x != w), True) for w in four for _ in range(9)]
    rows = [(i, u) for i, (u, _) in enumerate(urls)]
    labels = spark.createDataFrame([(i, int(good), 0) for i, (_, good) in enumerate(urls)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([*rows, (900, "http://other.org/d/c/b/a/e")], "page_id long, url string")
    assert {g.page_id for g in url_filters.judge(pages, labels, []).collect() if g.verdict == "block"} == {0, 1, 2, 3, 4, 5, 900}
    assert [sorted(x["items"]) for x in url_filters.mine(pages, labels)[0].collect()] == [["p:a", "p:b", "p:c", "p:d"]]


def test_one_long_url_on_many_pages(spark, both_ways):
    """40 words that always stand together are one item; with a word of another URL they make a rule."""
    words = [f"w{k}" for k in range(40)]
    rows = [(i, "http://long.net/" + "/".join(words) + ("/ad" if i < 5 else "")) for i in range(11)] + [(i, f"http://other.net/ad/{i}") for i in range(20, 30)]
    labels = spark.createDataFrame([(i, int(i >= 5), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([*rows, (90, "http://x.net/w39/ad"), (91, "http://x.net/w3/w4"), (92, "http://x.net/ad"), (93, "http://x.net/" + "a/" * 20_000), (94, "http://x.net/" + "/".join(f"u{k}" for k in range(5000)))], "page_id long, url string")
    index, names = url_filters.mine(pages, labels)
    assert [sorted(x["items"]) for x in index.collect()] == [["h:long", "p:ad"]]
    assert {x.token for x in names.where("item = 'h:long'").collect()} == {"h:long", *(f"p:{w}" for w in words)}
    got = url_filters.judge(pages.unionByName(pages.where("page_id = 90")), labels, []).collect()
    assert sorted(g.page_id for g in got if g.verdict == "block") == [0, 1, 2, 3, 4, 90, 90]


def plain_repeats(rows, length):
    count = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, sum(gone), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "runs"), [(100, 2048), (100, 1), (65, 3)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, both_ways, length, runs):
    monkeypatch.setattr(suffix_dedup, "BUCKET_RUNS", runs)
    r = random.Random(length)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(60)) for _ in range(8)]
    rows = []
    for i in range(50):
        t = ""
        for _ in range(r.randrange(1, 4)):
            b = r.choice(base)
            a = r.randrange(len(b))
            t += b[a : a + r.randrange(40, 300)] + r.choice(["", "é", " fresh%d " % r.randrange(999)])
        rows.append((i, t))
    rows += [(90, "ab" * 200), (91, "z" * 150), (92, rows[3][1]), (92, rows[3][1]), (93, ""), (94, None), (95, "short"), (None, rows[5][1])]
    got = suffix_dedup.remove_repeats(documents(spark, rows, ["anchor", "content", "start", "wanted"]), length).collect()
    assert sorted(((g.doc_id, g.n_removed, bytes(g.kept)) for g in got), key=str) == plain_repeats([(i, (t or "").encode()) for i, t in rows], length)
    for g in got:
        assert sum(s.end - s.start for s in g.spans) == g.n_removed
    assert suffix_dedup.remove_repeats(documents(spark, []), length).count() == 0


def test_suffix_dedup_counts_bytes_of_passages(spark):
    """60 words that two documents share stay with 399 bytes and go with 400; n_bytes is the input's size either way."""
    rows, want = [], []
    for c, n in (("s", 399), ("g", 400), ("é", 399), ("ö", 400)):
        passage = " ".join(f"{c}{k:02d}a" for k in range(60))
        passage += "x" * (n - len(passage.encode()))
        for a, b in ("<>", "[]"):
            want.append((len(rows), n + 2, n * (n >= 400), a + b if n >= 400 else a + passage + b))
            rows.append((len(rows), a + passage + b))
    got = suffix_dedup.remove_repeats(documents(spark, rows)).collect()
    assert sorted((g.doc_id, g.n_bytes, g.n_removed, g.kept_text) for g in got) == want


def test_difference_cover():
    d = suffix_dedup.difference_cover(32)
    assert {(a - b) % 32 for a in d for b in d} == set(range(32)) and len(d) <= 10


def cosine(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize(("heavy", "fits"), [(20_000, True), (200, True), (200, False)])
def test_nearest_recall(spark, monkeypatch, heavy, fits):
    monkeypatch.setattr(nearest, "HEAVY_ROWS", heavy)
    if not fits:  # no index finds enough: all rows are compared
        monkeypatch.setattr(nearest, "fit", lambda *_: None)
    monkeypatch.setattr(nearest, "PART_ROWS", 2 * heavy)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").withColumn("part", F.lit(1))
    got = {}
    for g in nearest.nearest(df, 50, 5).collect():
        got.setdefault(g.query_id, {})[g.rank] = (g.vec_id, g.score)
    assert sorted(got) == list(range(0, 1500, 50))
    y = x.astype(float)
    hit = 0
    for q, found in got.items():
        s = {k: cosine(y[q], y[k]) for k in range(1500) if k != q}
        hit += len({v for v, _ in found.values()} & set(sorted(s, key=lambda k: (-s[k], k))[:5]))
        assert [found[r][1] for r in range(1, 6)] == pytest.approx([s[found[r][0]] for r in range(1, 6)], abs=1e-12)
        assert [found[r][1] for r in range(1, 6)] == sorted((found[r][1] for r in found), reverse=True)
    assert hit / (5 * len(got)) >= (0.9 if fits else 1)


def test_nearest_share_of_clustered_vectors(spark):
    """Few rows are compared where vectors have neighbours that stand out."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(200, 32))
    x = (centres[rng.integers(0, 200, 6000)] + 0.25 * rng.normal(size=(6000, 32))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = nearest.fit(df, 6000, df.where("vec_id % 50 = 0"), 5)
    assert index.share <= 0.3
    y = nearest.unit(x.astype(float))
    seen = nearest.first_visit(index, y[::50], y) < index.probes
    true = np.argsort(-(y[::50] @ y.T), axis=1)[:, 1:6]
    assert np.take_along_axis(seen, true, 1).mean() >= 0.9 and seen.mean() <= 0.3


def test_nearest_ids_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.5, 1.0]), (50, [0.0, 2.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50, 3).collect()
    assert [g.vec_id for g in sorted(got, key=lambda g: (g.query_id, g.rank))] == [1, 3, 2, 1, 2, 3]


@pytest.mark.parametrize("share", [1e-160, 1.0, 1e160])
def test_nearest_of_tiny_and_huge_doubles(spark, share):
    """Cosines as of whole numbers in exact arithmetic: the size of vectors says nothing."""
    r = np.random.default_rng(9)
    x = r.integers(-9, 10, (120, 5))
    x[(x == 0).all(1)] = 1
    size = share * 2.0 ** r.integers(-30, 30, 120)
    df = spark.createDataFrame([(k, (v * s).tolist()) for k, (v, s) in enumerate(zip(x, size, strict=True))], "vec_id long, embedding array<double>")
    got = {(g.query_id, g.vec_id): g.score for g in nearest.nearest(df, 10, 119).collect()}
    assert len(got) == 12 * 119
    for (q, k), s in got.items():
        a, b = [[int(c) for c in x[n]] for n in (q, k)]
        dot = sum(c * d for c, d in zip(a, b, strict=True))
        assert s == pytest.approx(dot / (sum(c * c for c in a) * sum(d * d for d in b)) ** 0.5, abs=2e-15)


def test_nearest_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    bad = [(7, None, 0), (8, [0.0, 0.0], 0), (9, [1.0, None], 0), (10, [float("nan"), 1.0], 0), (11, [float("inf"), 1.0], 0), (12, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0)]
    few = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0), (2, [1.0, 1.0], 0)]
    got = nearest.nearest(spark.createDataFrame(few + bad, schema), 50, 5).orderBy("query_id", "rank").collect()
    assert [(g.query_id, g.rank, g.vec_id) for g in got] == [(0, 1, 1), (0, 2, 2)]
    copies = [(k, [1.0, 2.0], 0) for k in range(200)] + [(300, [1.0, 2.1], 0)]
    got = nearest.nearest(spark.createDataFrame(copies, schema), 50, 5).collect()
    for q in (0, 50, 100, 150):
        assert [g.vec_id for g in sorted(got, key=lambda g: g.rank) if g.query_id == q] == [k for k in range(6) if k != q][:5]
    assert nearest.nearest(spark.createDataFrame([], schema)).count() == 0
    assert nearest.nearest(spark.createDataFrame(bad, schema)).count() == 0
