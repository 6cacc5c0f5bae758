"""Quality classifier, sharding, packing, fingerprints and line dedup on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldbook.llm import common, fingerprints, line_dedup, packing, quality_classifier, sharding
from fieldbook.llm.bytehash import PLACES, mix, spans, sums
from fieldbook.llm.queries import QUERIES, tokenizer_path

TABLES = Path("/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and note cell mouse dose wash stain image day plan buffer sample".split()


def texts(seed, n, lines=6, words=9):
    r = random.Random(seed)
    return ["\n".join(" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(words)) for _ in range(lines)) for _ in range(n)]


def documents(spark, rows, extra=()):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("mine"))
    return df


ODD = [(1, None), (2, ""), (3, "one"), (4, "x " * 30_000), (5, "same text here"), (6, "same text here"), (6, "same text here"), (None, "no id")]


@needs_tables
def test_quality_on_held_out_rows(spark):
    out = QUERIES["op1_quality_classifier"](spark, str(TABLES))
    rows = out.where("held_out").join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == y] for y in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (900, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, ("fine words here " if i % 2 else "$$$ 111 !!! ") * (i % 7)) for i in range(7, 40)]
    docs = documents(spark, [*ODD, *rows], ["score", "label", "quality"])
    got = quality_classifier.classify(docs, labels)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "score"]
    scores = got.select("doc_id", "text", "score").collect()
    assert len(scores) == len(ODD) + len(rows) and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if not r.text}) == 1
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0
    assert quality_classifier.classify(docs, labels.limit(0)).count() == len(ODD) + len(rows)
    assert quality_classifier.classify(docs, labels.where("quality = 1")).where("score < 0.5").count() == 0


def test_quality_learns_from_long_and_repeated_texts(spark):
    rows = [(i, ("fine words here " if i % 2 else "$$$ 111 !!! ") * 40) for i in range(60)]
    docs = documents(spark, [*rows, *[(1, "fine words here again")] * 50, *[(i, None) for i in range(60, 120)]])
    known = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, label int")
    keys = quality_classifier.chosen(docs, known, 20)
    assert Counter(r.label for r in keys.collect()) == {0: 20, 1: 20}
    got = quality_classifier.texts_of(docs, keys, F.col("text")).collect()
    assert sorted((r.label, r.place) for r in got) == [(y, k) for y in (0, 1) for k in range(1, 21)]
    scores = {r.doc_id: r.score for r in quality_classifier.classify(documents(spark, [(i, t * 50) for i, t in rows]), known.withColumnRenamed("label", "quality"), 20).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


def test_quality_model_against_plain_fit(spark):
    """The score is the logistic regression of the features under the two dictionaries, learned from no held-out row."""
    rows = [(i, t if i % 2 else t.replace("the", "$$").upper()) for i, t in enumerate(texts(21, 160, 4))]
    docs, known = documents(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows if zlib.crc32(str(i).encode()) % 5], "doc_id long, label int")
    model = quality_classifier.fit(docs, known, 1000)
    good, bad = model.compressors()
    x = {i: np.array(quality_classifier.features(t.encode(), good, bad)) for i, t in rows}
    for i, t in rows[:20]:
        parts = [t.encode()[k : k + 512] for k in range(0, len(t), 512)]
        g, b = (sum(len(c.compress(p)) for p in parts) for c in (good, bad))
        assert x[i][0] == pytest.approx((b - g) / (b + g))
    keys = {(r.label, r.place): r.doc_id for r in quality_classifier.chosen(docs, known, 1000).collect()}
    held = [i for (_, place), i in keys.items() if place % 4 == 0]
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    z = np.array([(x[i] - model.mean) / model.scale for i in held])
    y = np.array([i % 2 for i in held])
    p = 1 / (1 + np.exp(-(z @ model.weights + quality_classifier.logistic(z, y)[1])))
    assert np.abs(z.T @ (p - y) + 1e-3 * model.weights).max() < 1e-3  # where the penalised likelihood is greatest
    labels = known.withColumnRenamed("label", "quality")
    for r in quality_classifier.classify(docs, labels, 1000).collect():
        assert r.score == pytest.approx(float(model.probability(x[r.doc_id][None, :])[0]), abs=1e-9)


@pytest.mark.parametrize(("n", "k", "m"), [(10, 4, 5), (50, 20, 7), (7, 7, 3), (9, 0, 4), (1000, 400, 500)])
def test_hypergeometric_draws_follow_the_exact_law(spark, n, k, m):
    steps = 2000
    df = spark.range(steps).select(((F.col("id") + 0.5) / steps).alias("u"))
    got = Counter(r[0] for r in df.select(sharding.hypergeometric(F.lit(n), F.lit(k), F.lit(m), F.col("u"))).collect())
    total = math.comb(n, m)
    for x in range(max(0, m + k - n), min(k, m) + 1):
        assert abs(got[x] / steps - math.comb(k, x) * math.comb(n - k, m - x) / total) <= 2 / steps


def test_shards(spark):
    docs = documents(spark, [*ODD, *enumerate(texts(1, 300), 10)], ["shard", "slot", "block", "size", "part"])
    a = sharding.shuffle_shards(docs, block_rows=16).collect()
    b = sharding.shuffle_shards(docs.repartition(7), block_rows=16).collect()
    key = lambda r: (r.doc_id or 0, r.size, r.text_crc32 or 0, r.shard, r.slot)
    assert sorted(a, key=key) == sorted(b, key=key)
    count = Counter(r.shard for r in a)
    assert sorted(count) == list(range(24)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r.slot for r in a if r.shard == s) == list(range(n))
    by = {r.doc_id: r for r in a}
    assert (by[1].size, by[1].text_crc32, by[2].size) == (8, None, 8)
    assert by[3].text_crc32 == zlib.crc32(b"one")
    assert sharding.shuffle_shards(docs.limit(0)).count() == 0


def test_packing_is_a_round_trip(spark):
    rows = [*ODD, *enumerate(texts(2, 200, 30), 10), (899, "x <|endoftext|> y"), (898, "a<|endoftext|>"), (900, "tab\there  and\n\nlines \u00a0x <|endoftext|> ünï 漢字 🎉"), (901, " lead"), (902, "trail ")]
    docs = documents(spark, rows, ["ids", "start"])
    pieces = packing.pack_documents(docs, tokenizer_path(), set_tokens=20_000, keep_ids=True).collect()
    enc = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, tuple(enc.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows)
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids) > 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at == 1 << (at.bit_length() - 1)
    for (i, n), ps in by_doc.items():
        copies = sum(c for (j, ids), c in want.items() if j == i and len(ids) == n)
        assert sum(p.length for p in ps) == n * copies
        if copies == 1:
            assert (i, tuple(x for p in sorted(ps, key=lambda p: p.start) for x in p.ids)) in want
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_long_texts_are_cut_at_spaces(monkeypatch):
    some = [t.replace("\n", " ") for t in texts(13, 6, 12)] + ["x" * 300, "y" * 90 + " " + "z" * 200 + " end", "ünï " * 50 + "漢字", ""]
    for t in some:
        parts = packing.cut_at_spaces(t.encode(), 64)
        assert b"".join(parts) == t.encode() and all(p[:1] == b" " for p in parts[1:])
        assert all(len(p) <= 64 or b" " not in p[1:] for p in parts)
    monkeypatch.setattr(packing, "LOOKED_UP", 64)
    plain = Tokenizer.from_file(tokenizer_path())
    got = packing.Tokenizer(tokenizer_path()).encode(some)
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in some]


def plain_pack(lengths, capacity):
    """Each document, longest first, goes piece by piece to the sequence of least cost, then most room, then least number."""
    total = sum(lengths)
    room = [capacity] * (total // capacity) + [p for p in (1 << b for b in range(20, -1, -1)) if p < capacity and total % capacity & p]
    cost, used, out = [0.0] * len(room), [0] * len(room), []
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start = 0
        while start < lengths[d]:
            s = min((s for s in range(len(room)) if used[s] < room[s]), key=lambda s: (cost[s], used[s] - room[s], s))
            n = min(lengths[d] - start, room[s] - used[s])
            out.append((d, start, n, s, used[s]))
            used[s], start, cost[s] = used[s] + n, start + n, cost[s] + n + n * n / 1024
    return out


def test_a_scan_of_few_tasks_is_spread(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(1000)] + [(None, None), (1, ""), (1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    out = common.spread(one)
    assert out.rdd.getNumPartitions() >= cores
    assert sorted(out.collect(), key=str) == sorted(one.collect(), key=str)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(rows) if cores > 1 else sizes == [len(rows)]
    many = one.repartition(cores + 1)
    assert common.spread(many) is many
    assert common.spread(one.limit(0)).count() == 0


def test_packing_against_plain_assignment():
    r = random.Random(4)
    for _ in range(20):
        lengths = [r.choice([1, 5, 40, 200, 900, 3000]) + r.randrange(9) for _ in range(r.randrange(1, 60))]
        assert packing.pack(lengths, 1024) == plain_pack(lengths, 1024)


def test_packing_balances_cost():
    rows = packing.pack([1500, 900, 500, 500, 300, 100], 1024)
    assert sum(n for *_, n, _, _ in rows) == 3800
    cost = Counter()
    for _, _, n, s, _ in rows:
        cost[s] += n + n * n / 1024
    full = [c for s, c in cost.items() if s < 3800 // 1024]
    assert max(full) <= 2 * 1024 and min(full) >= 1024


def plain_line_dedup(rows):
    seen, out = {}, []
    runs = []
    for k, (i, t) in enumerate(rows):
        lines = [x.strip(" ") for x in t.split("\n")]
        runs += [(i, k, p, 2, tuple(lines[p : p + 2])) for p in range(len(lines) - 1)]
        runs += [(i, k, p, 1, (x,)) for p, x in enumerate(lines) if len(x) - len(x.replace(" ", "")) + 1 >= 50]
    for i, k, p, n, c in sorted(runs, key=lambda r: (r[0], r[2])):
        seen.setdefault((n, c), (i, p))
    for k, (i, t) in enumerate(rows):
        gone = {p + d for j, kk, p, n, c in runs if kk == k and seen[n, c] != (i, p) for d in range(n)}
        lines = t.split("\n")
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone)))
    return out


def test_line_dedup_against_brute_force(spark):
    r = random.Random(5)
    pool = [" ".join(r.choice(WORDS) for _ in range(r.choice([2, 3, 60]))) for _ in range(12)]
    rows = [(i, "\n".join(r.choice(pool) + " " * r.randrange(2) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(70, ""), (71, rows[3][1]), (71, rows[3][1]), (72, "\n".join([pool[0]] * 5)), (73, "\n\n\n"), (74, "x " * 40_000)]
    docs = documents(spark, [*rows, (75, None)], ["_gone", "mark", "runs", "content", "n"])
    got = line_dedup.remove_repeated_lines(docs).collect()
    assert sorted((g.doc_id, g.text, g.n_removed) for g in got if g.doc_id != 75) == sorted(plain_line_dedup(rows))
    assert [(g.text, g.n_lines, g.n_removed) for g in got if g.doc_id == 75] == [(None, 0, 0)]
    assert all(sum(s.lines for s in g.spans) == g.n_removed for g in got)


def test_line_dedup_edge_cases(spark):
    docs = documents(spark, ODD, ["n_lines", "spans", "first"])
    got = line_dedup.remove_repeated_lines(docs)
    assert got.count() == len(ODD)
    by = {r.doc_id: r for r in got.collect()}
    assert (by[1].text, by[1].n_lines, by[2].text, by[2].n_lines) == (None, 0, "", 1)
    assert by[1].first == "mine"
    assert line_dedup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_entropy_of_windows():
    data = random.Random(3).randbytes(300) + b"a" * 200
    bins = fingerprints.entropy_bins(np.frombuffer(data, np.uint8))
    for k in range(0, len(bins), 17):
        c = Counter(data[k : k + 64]).values()
        h = -sum(n / 64 * math.log2(n / 64) for n in c) / 6
        assert abs(bins[k] - 1000 * h) <= 2


def plain_chain(text, rank):
    """Votes of every run of 64 windows, gaps filled, and bits set one by one."""
    buf = np.frombuffer(text, np.uint8)
    bins = fingerprints.entropy_bins(buf)
    votes = Counter()
    for k in range(len(bins) - 63):
        keys = [(rank[bins[w]], w) for w in range(k, k + 64) if bins[w] >= fingerprints.LEAST_BIN]
        if keys:
            votes[min(keys)[1]] += 1
    at = sorted(w for w, n in votes.items() if n >= 16)
    edges, places = [-64, *at, len(text)], set(at)
    for a, b in zip(edges, edges[1:]):
        if b - a > fingerprints.GAP:
            places |= set(range(a + 64, b - 63, 64))
    running = sums(buf)
    h, seen = [], Counter()
    for w in sorted(places):
        x = spans(running, np.array([w]), np.array([w + 64]))
        n = seen[int(x[0])] if w not in at else 0
        seen[int(x[0])] += w not in at
        h.append(int((mix(x + np.uint64(n) * PLACES[0]) if n else x)[0]))
    h = list(dict.fromkeys(h))
    bits = np.zeros((-(-len(h) // 160), 2048), np.uint8)
    for k, x in enumerate(h):
        for e in range(5):
            bits[k // 160, x >> 11 * e & 2047] = 1
    return bits


def plain_likeness(a, b):
    def one(x, y):
        n, m, both = x.sum(), y.sum(), (x & y).sum()
        chance, most = n * m / 2048, min(n, m)
        least = chance + 0.3 * max(0, most - chance)
        return min(1, max(0, (both - least) / max(most - least, 1e-9)))

    rows = np.mean([max(one(x, y) for y in b) for x in a])
    columns = np.mean([max(one(x, y) for x in a) for y in b])
    return rows if len(a) < len(b) else columns if len(b) < len(a) else (rows + columns) / 2


def test_fingerprints_against_plain_votes():
    r = random.Random(6)
    some = [t.encode() for t in texts(12, 6, 30)]
    some += [b"x" * 700 + some[0][:400], bytes(r.randrange(256) for _ in range(9000)), some[1][:1500] + some[2][:900]]
    rank = np.random.default_rng(1).permutation(fingerprints.BINS)
    chains = fingerprints.chains(some, rank)
    plain = [plain_chain(t, rank) for t in some]
    for t, a, b in zip(some, chains, plain, strict=True):
        assert np.array_equal(np.unpackbits(a, axis=1), b), len(t)
    for a, pa in zip(chains, plain, strict=True):
        for b, pb in zip(chains, plain, strict=True):
            assert fingerprints.likeness(a, b) == pytest.approx(plain_likeness(pa, pb), abs=1e-9)
    assert any(len(a) > 1 for a in chains)


@pytest.mark.parametrize("intervals", [1024, 3])
def test_next_documents_in_many_parts(spark, monkeypatch, intervals):
    monkeypatch.setattr(fingerprints, "INTERVALS", intervals)
    r = random.Random(2)
    rows = [(r.choice([None, *range(-50, 90, 3)]), f"t{k % 37}") for k in range(150)] + [(1 << 40, "far"), (4, None)]
    got = fingerprints.compare_edited(documents(spark, rows), np.arange(fingerprints.BINS), parts=13).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want = [(i, hashlib.sha256(((t or "")[: len(t or "") - len(t or "") // 4] + (order[(k + 1) % len(order)][1] or "")[: len(t or "") // 4]).encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    assert Counter((g.doc_id, g.edited_sha256) for g in got) == Counter(want)


def test_fingerprints(spark):
    rows = [*ODD[:-1], *enumerate(texts(7, 60, 20), 10)]
    docs = documents(spark, rows, ["fingerprint", "part", "mark", "head"])
    rank = fingerprints.rarity(docs)
    got = sorted(fingerprints.compare_edited(docs, rank, parts=5).collect(), key=lambda r: (r.doc_id, r.n_chars))
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: x[0])
    assert [(g.doc_id, g.n_chars) for g in got] == [(i, len(t)) for i, t in order]
    for k, g in enumerate(got):
        t, nxt = order[k][1], order[(k + 1) % len(order)][1]
        q = len(t) // 4
        assert g.edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    long = [g for g in got if 500 < g.n_chars < 5000]
    assert np.mean([g.near_edited for g in long]) > 0.5 > 0.1 > np.mean([g.near_next for g in long])
    same = {g.fingerprint for g in got if g.doc_id in (5, 6)}
    assert len(same) == 1
    own = fingerprints.fingerprint(docs, rank)
    assert {r.doc_id: r.fingerprint for r in own.collect() if r.doc_id}[20] == next(g.fingerprint for g in got if g.doc_id == 20)
    assert fingerprints.compare_edited(docs.limit(0), fingerprints.rarity(docs.limit(0))).count() == 0


def test_fingerprints_of_short_and_plain_texts(spark):
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n))
    rows = [*enumerate(some(n) for n in (*range(20, 142), *range(142, 700, 31))), *enumerate((some(n) for n in range(4, 20)), 500)]
    rows += [(1000 + k, x * (n // len(x))) for k, (x, n) in enumerate((x, n) for x in ("a", "x ", "=-=", "0123456789") for n in (30, 100, 400, 3000, 70_000))]
    rank = fingerprints.rarity(documents(spark, [*rows, *enumerate(texts(9, 30, 20), 2000)]))
    got = {g.doc_id: g for g in fingerprints.compare_edited(documents(spark, rows), rank, parts=3).collect()}
    assert all(0.2 < g.near_edited for i, g in got.items() if i < 500) and all(g.near_edited < 0.999 for g in got.values() if 20 <= g.n_chars <= 141 and g.doc_id < 500)
    assert all(got[i].near_edited > 0.1 for i in range(500, 516))
    assert np.mean([g.near_next for i, g in got.items() if i < 500]) < 0.05
    plain = [fingerprints.chains([t.encode(), (t[: len(t) - len(t) // 4] + some(len(t) // 4)).encode()], rank) for i, t in rows if i >= 1000]
    assert all(0.2 < fingerprints.likeness(a, b) < 0.999 for a, b in plain)
