"""Merkle manifest, fill-in-the-middle and exact top-k search against brute force."""

import random
from hashlib import sha256
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from fieldbook.llm import fill_in_middle, merkle, topk

from .test_corpus_operators import both_ways  # noqa: F401  a fixture

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place string, n int, row int"


def sha(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(digests):
    """(top, proofs) level by level."""
    proofs, owners, level = [[] for _ in digests], [[k] for k in range(len(digests))], list(digests)
    while len(level) > 1:
        above, held = [], []
        for s in range(0, len(level), 3):
            run = level[s : s + 3]
            for k in range(len(run)):
                for leaf in owners[s + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            held.append([x for o in owners[s : s + 3] for x in o])
        level, owners = above, held
    return (level or [None])[0], proofs


def plain_manifest(rows):
    """Rows (doc_id, source, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    null_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    leaves = sorted(((r[1], r[0], plain_leaf(*r)) for r in rows), key=lambda x: (null_first(x[0]), null_first(x[1]), x[2]))
    trees = [(s, list(g)) for s, g in groupby(leaves, key=lambda x: x[0])]
    tops = [plain_tree([x[2] for x in g]) for _, g in trees]
    root, over = plain_tree([t for t, _ in tops])
    return [(i, s, leaf, top, root, tuple(proofs[k] + over[n])) for n, ((s, g), (top, proofs)) in enumerate(zip(trees, tops, strict=True)) for k, (_, i, leaf) in enumerate(g)]


def manifest_of(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, s, n, "x", "y", 7, 8) for i, s, lang, n, t in rows], DOCS)
    kept = merkle.manifest(docs, {"again": F.col("n_chars")}).withColumns({"fold": merkle.folded(F.col("leaf"), F.col("proof")), "digest": merkle.proof_digest(F.col("proof"))})
    out = kept.collect()
    for r in out:
        assert r.fold == r.root
        assert r.digest == sha("".join((s.before + s.after).hex() for s in r.proof))
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((s.before.hex(), s.after.hex()) for s in r.proof)) for r in out), key=str)


@pytest.mark.parametrize("levels, part", [(1, 40), (2, 1000)])
def test_manifest_against_plain_trees(spark, monkeypatch, both_ways, levels, part):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "PART_ROWS", part)
    r = random.Random(levels)
    sizes = {None: 2, "": 1, "é": 9, "z": 10, "web": 85, "b": 27, "c": 28, "\U0001f600": 3, "￮": 1, "a": 4}
    rows = [(k, s, r.choice(["en", None]), r.choice([None, 5]), r.choice(["", None, "a\nb", "é" * 3, "x" * 5000])) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    r.shuffle(rows)
    rows += [(None, "web", None, None, None)] * 12 + [(3, "é", "en", 1, "t"), (3, "é", "en", 1, "t"), (3, "é", "en", 2, "u")]
    assert manifest_of(spark, rows) == sorted(plain_manifest(rows), key=str)


def test_manifest_of_few_rows(spark):
    one = [(5, "s", "en", 1, "t")]
    leaf = plain_leaf(*one[0])
    assert manifest_of(spark, one) == [(5, "s", leaf, leaf, leaf, ())]
    assert manifest_of(spark, []) == []
    assert manifest_of(spark, one * 4) == sorted(plain_manifest(one * 4), key=str)


def test_a_changed_row_does_not_fold_to_the_root(spark):
    docs = spark.createDataFrame([(k, "a\nb" if k % 2 else "ab", "en", "s", 3) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    text = {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    out = merkle.manifest(docs, {"now": merkle.leaf(*[text.get(c, F.col(c)) for c in merkle.COLUMNS])}).select("doc_id", (merkle.folded(F.col("now"), F.col("proof")) == F.col("root")).alias("same")).collect()
    assert all(r.same == (r.doc_id % 2 == 0) for r in out) and len(out) == 30


def plain_arrangement(doc_id, text):
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    t = text or ""
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, t)
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_against_plain_slices(spark):
    r = random.Random(4)
    letters = "ab\n\r\t <>PSM\\$.é ́\U0001f600\x00"
    rows = [(k, "".join(r.choice(letters) for _ in range(r.randrange(12)))) for k in range(400)]
    rows += [(None, "no id"), (None, None), (7, None), (7, ""), (8, "again"), (8, "again"), (-3, "below zero"), (1000, "a long text, " * 20_000), (1001, "has <S> in it"), (1002, "<" * 9)]
    docs = spark.createDataFrame([(i, t, "x", 1, "u") for i, t in rows], "doc_id long, text string, form string, n int, units string")
    out = fill_in_middle.rearrange(docs)
    assert out.columns == ["doc_id", "text", "units", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((x.doc_id, x.text, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got), key=str) == sorted(((i, t, *plain_arrangement(i, t)) for i, t in rows), key=str)
    assert all(x.back == (x.text or "") for x in got)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.rearrange(docs.limit(0)).count() == 0


def test_other_sentinels(spark):
    docs = spark.createDataFrame([(k, "some text") for k in range(40)], "doc_id long, text string")
    marks = ("[p|", "[s|", "[m|")
    out = fill_in_middle.rearrange(docs, seed=2, sentinels=marks, rearranged=100, suffix_first=50)
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {x.back for x in got} == {"some text"} and {x.form for x in got} == {"psm", "spm"}
    for bad in [("", "b", "c"), ("a", "a", "c"), ("ab", "bc", "d"), ("abc", "b", "d"), ("aba", "c", "d")]:
        with pytest.raises(ValueError):
            fill_in_middle.rearrange(docs, sentinels=bad)


def plain_top(rows, every, k):
    most = topk.MOST
    whole = [(i, [max(-most, min(most, int((64 * x) // 1))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    asked = {}
    for i, v in whole:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scores = [(max(-most, min(most, sum(a * b for a, b in zip(v, x, strict=False)))), i) for i, x in whole if i != q]
        out += [(q, rank, i, s) for rank, (s, i) in enumerate(sorted(scores, key=lambda p: (-p[0], p[1]))[:k], 1)]
    return sorted(out)


def top_of(spark, rows, every, k, kind="float"):
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, row int, v int, block int")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top(frame, every, k).collect())


@pytest.mark.parametrize("kind, bits, rows_of, queries_of", [("float", 1, 64, 16), ("double", 3, 50, 7), ("double", 8, 2048, 1024)])
def test_top_against_brute_force(spark, monkeypatch, kind, bits, rows_of, queries_of):
    for name, value in [("BITS", bits), ("BINS", 1 << bits), ("BLOCK_ROWS", rows_of), ("BLOCK_QUERIES", queries_of), ("SCORED", 5)]:
        monkeypatch.setattr(topk, name, value)
    r = random.Random(bits)
    rows = [(k, [r.randrange(-64, 65) / 64 for _ in range(8)]) for k in range(400)]
    rows += [(1000 + k, rows[3][1]) for k in range(150)] + [(20, rows[3][1])] * 30  # copies, and one id with many rows
    r.shuffle(rows)
    assert top_of(spark, rows, 20, 20, kind) == plain_top(rows, 20, 20)


def test_top_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (5, []), (6, [0.0, 0.0]), (7, [0.3, -0.3, 9.0]), (None, [1.0, 1.0]), (8, [1e-60, -1e-60]), (-20, [-1.0, 0.5]), (20, [])]
    assert top_of(spark, rows, 20, 20, "double") == plain_top(rows, 20, 20)
    huge = [(0, [1e18, 1e18]), (1, [1e300, -1e300]), (2, [3e7, 1.0]), (3, [-1e17, 2.0]), (20, [-3e7, 2.5]), (40, [1.0, 1.0])]
    assert top_of(spark, huge, 20, 3, "double") == plain_top(huge, 20, 3)
    assert top_of(spark, [(20, [1.0])], 20, 5) == [] and top_of(spark, [], 20, 5) == [] and top_of(spark, [(3, [1.0])], 20, 5) == []
