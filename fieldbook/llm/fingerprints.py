"""Document fingerprints: an improbable-feature digest.

Every 64-byte window of a text has an entropy. How often each entropy occurs
among all windows of all documents says how improbable it is; of each run of
64 neighbouring windows the rarest one gets a vote, and windows with enough
votes are the features. Where none is for long, as in text that repeats
itself, every 64th window is one, and a text that still has few takes its
short grams too. Features go into a chain of Bloom filters of 256
bytes, 160 to each, and two chains compare by the overlap of their bits beyond
what chance gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldbook.llm.bytehash import PLACES, U, groups, mix, spans, sums
from fieldbook.llm.common import Scratch, small_batches

WIDTH = 64
VOTES = 16
BITS = 2048
PER_FILTER = 160
HASHES = 5
BINS = 1001
#: Windows below this share of the full entropy (in thousandths) are never features.
LEAST_BIN = 100
#: Share of the possible overlap beyond chance that still counts as none.
CUTOFF = 0.3
#: Bytes without a feature beyond which windows side by side are features.
GAP = 256
#: A text of fewer features than FEW takes all its grams of GRAM bytes, and if under TINY bytes those of two bytes as well.
FEW, GRAM, TINY = 8, 6, 16
GROUP_BYTES = 192 << 10
#: Bytes of texts in a part on average, the least where smaller parts would give each core one, and the quantiles of doc_id that part them.
PART_BYTES = 16 << 20
LEAST_PART_BYTES = 1 << 20
INTERVALS = 1024

_count = np.arange(WIDTH + 2, dtype=float)
_weight = np.zeros(WIDTH + 2)
_weight[1:] = _count[1:] * np.log2(_count[1:])
#: What one more equal byte adds to the sum of c * log2(c), in fixed point.
_STEP = np.round(np.diff(_weight) * (1 << 20)).astype(np.int64)
_TOTAL = np.concatenate([[0], np.cumsum(_STEP)])


def entropy_bins(buf: np.ndarray) -> np.ndarray:
    """The entropy of each window of the buffer, in thousandths of six bits."""
    n = len(buf) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int64)
    ahead, behind = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    for lag in range(1, WIDTH):
        same = (buf[:-lag] == buf[lag:]).view(np.uint8)
        ahead[:-lag] += same
        behind[lag:] += same
    s = np.empty(n, np.int64)
    s[0] = _TOTAL[np.bincount(buf[:WIDTH], minlength=256)].sum()
    s[1:] = _STEP[behind[WIDTH:]] - _STEP[ahead[: n - 1]]
    return np.clip(1000 - np.cumsum(s) * 1000 // (6 * WIDTH << 20), 0, BINS - 1)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy among all windows of all documents; 0 is the rarest."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            for lo, hi in groups([len(t) for t in texts], GROUP_BYTES):
                buf, starts = _concat(texts[lo:hi])
                bins = entropy_bins(buf)
                total += np.bincount(bins[_inside(starts, len(bins), WIDTH)], minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bin", "n"])

    got = docs.select(text).mapInArrow(counted, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect()
    total = np.zeros(BINS, np.int64)
    for b, n in got:
        total[b] = n
    rank = np.empty(BINS, np.int64)
    rank[np.argsort(total, kind="stable")] = np.arange(BINS)
    return rank


def _concat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), np.uint8), starts


def _inside(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the first n spans of this width lie in one text."""
    ok = np.zeros(n + width + 1, bool)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        ok[a : max(a, b - width + 1)] = True
    return ok[:n]


def chains(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of filters, an array of rows of 256 bytes.

    A text of one byte has one feature, all of itself; an empty one has no filter.
    """
    out: list[np.ndarray] = []
    for lo, hi in groups([len(t) for t in texts], GROUP_BYTES):
        buf, starts = _concat(texts[lo:hi])
        running = sums(buf)
        bins = entropy_bins(buf)
        n = len(bins)
        place = max(1, n.bit_length())
        key = (np.where(bins < LEAST_BIN, BINS, rank[bins]) << place) | np.arange(n)
        for step in (1, 2, 4, 8, 16, 32):  # the least of 64 neighbours, by doubling
            key = np.minimum(key[:-step], key[step:]) if len(key) > step else key[:0]
        best = key[_inside(starts, len(key), 2 * WIDTH - 1)]
        best = best[(best >> place) < BINS] & ((1 << place) - 1)
        votes = np.bincount(best, minlength=n)
        at = np.flatnonzero(votes >= VOTES)
        h = spans(running, at, at + WIDTH)
        first = np.searchsorted(at, starts)
        for k in range(hi - lo):
            own = _features(running, starts[k], starts[k + 1], at[first[k] : first[k + 1]], h[first[k] : first[k + 1]])
            out.append(_filters(own))
    return out


def _features(running: np.ndarray, start: int, end: int, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A text's features: h, of the windows selected at `at`, and what fills long gaps and short texts.

    Gaps are filled from the feature before them (or the text's start), so
    that a change leaves what lies before it as it was.
    """
    edges = np.concatenate([[start - WIDTH], at, [end]])
    wide = np.flatnonzero(np.diff(edges) > GAP)
    if len(wide):
        more = np.concatenate([np.arange(edges[k] + WIDTH, edges[k + 1] - WIDTH + 1, WIDTH) for k in wide])
        h = np.concatenate([h, _numbered(spans(running, more, more + WIDTH))])[np.argsort(np.concatenate([at, more]), kind="stable")]
    if len(h) < FEW:
        for width in (GRAM, 2) if end - start < TINY else (GRAM,):
            grams = np.arange(start, max(start, end - width + 1))
            h = np.concatenate([h, _numbered(spans(running, grams, grams + width))])
        if not len(h) and end > start:
            h = spans(running, np.array([start]), np.array([end]))
    return h


def _numbered(h: np.ndarray) -> np.ndarray:
    """h, where each repeat of a value becomes another by its number, so that how often it occurs counts."""
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    k = np.empty(len(h), U)
    k[np.argsort(inverse, kind="stable")] = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.where(k > 0, mix(h + k * PLACES[0]), h)


def _filters(features: np.ndarray) -> np.ndarray:
    _, first = np.unique(features, return_index=True)
    own = features[np.sort(first)]
    n = -(-len(own) // PER_FILTER)
    bits = np.zeros(n * BITS, np.uint8)
    base = np.arange(len(own)) // PER_FILTER * BITS
    for k in range(HASHES):
        bits[base + ((own >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).reshape(n, BITS // 8)


def encode(chain: np.ndarray) -> str:
    """The chain as text: its number of filters, then their bytes in base 64."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how far the bits of each filter of the shorter chain overlap with its best partner's, beyond chance.

    Of chains of one length, the mean of both directions. Two empty chains are
    alike, an empty and another are not.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = a.view(np.uint64), b.view(np.uint64)
    na, nb = np.bitwise_count(x).sum(1, dtype=float), np.bitwise_count(y).sum(1, dtype=float)
    both = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(2, dtype=float)
    most = np.minimum(na[:, None], nb[None, :])
    chance = na[:, None] * nb[None, :] / BITS
    least = chance + CUTOFF * np.maximum(most - chance, 0)
    score = np.clip((both - least) / np.maximum(most - least, 1e-9), 0, 1)
    rows, columns = score.max(1).mean(), score.max(0).mean()
    return float(rows if len(a) < len(b) else columns if len(b) < len(a) else (rows + columns) / 2)


def fingerprint(docs: DataFrame, rank: np.ndarray, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with each whole text's fingerprint; a null text counts as empty, a column of that name is replaced."""
    from pyspark.sql.types import StringType, StructField, StructType

    docs = docs.drop(out)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(rank)
    place = docs.columns.index(text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([encode(c) for c in chains(texts, shared.value)], pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(made, StructType([*docs.schema.fields, StructField(out, StringType())]))


def _part(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key, by a balanced tree of comparisons; 0 for null."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= bounds[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, mark, doc_id, text), sorted in each partition so that every document's next one follows it.

    Documents are cut into parts by ranges of doc_id: between quantiles, and
    where there are more parts than INTERVALS, evenly within these. The first
    document of the next part that has any (after the last part: of the first)
    is added to each part's end, with mark 1.
    """
    docs, key = docs.select("doc_id", "text"), F.col("doc_id")
    wide = min(parts, INTERVALS)
    sub = -(-parts // wide)
    edges = [int(x) for x in docs.approxQuantile("doc_id", [k / wide for k in range(wide + 1)], 0.25 / wide)] if parts > 1 else []
    bounds = sorted({x for x in edges[1:-1] if x > edges[0]})
    part = _part(key, bounds)
    if sub > 1 and edges:
        ends = F.array(*map(F.lit, [edges[0], *bounds, edges[-1] + 1]))
        low, high = F.get(ends, part), F.get(ends, part + 1)
        inside = F.floor((key - low) / (high - low) * sub).cast("int")
        part = part * sub + F.greatest(F.lit(0), F.least(F.lit(sub - 1), F.coalesce(inside, F.lit(0))))
    docs = docs.withColumn("part", part)
    # The order of documents: doc_id with nulls first, then text.
    heads = docs.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    heads = Scratch(docs.sparkSession, "fingerprints").save("heads", heads)  # a document for each part
    w = Window.orderBy("part")  # only numbers of parts are ordered in one task
    after = F.coalesce(F.lead("part").over(w), F.first("part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    following = heads.select(F.col("part").alias("_part"), after.alias("part"))
    marks = following.join(heads, "part").select(F.col("_part").alias("part"), F.lit(1).alias("mark"), "head.doc_id", "head.text")
    rows = docs.select("part", F.lit(0).alias("mark"), "doc_id", "text").unionByName(marks)
    return rows.repartitionById(wide * sub, "part").sortWithinPartitions("part", "mark", "doc_id", "text")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, rank: np.ndarray, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likeness to the edited text and to the next document.

    The edited text has its last quarter (rounded down) of code points replaced
    by the first as many, or all, of the next document's. Null texts are empty.
    The order is that of doc_id, nulls first, then of text; the last document's
    next is the first, a lone one's next itself. Repeated rows follow each
    other; a doc_id may be null. A text too short for windows has its short
    grams as features, and one of a single byte itself. Only doc_id and text are
    read. Texts move once, and tasks stream over them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, size // PART_BYTES, min(spark.sparkContext.defaultParallelism, size // LEAST_PART_BYTES))
    shared = spark.sparkContext.broadcast(rank)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str, str]]]:
        """Lists of (doc_id, text, next text), of bounded size."""
        waiting: tuple[int | None, str] | None = None
        out: list[tuple[int | None, str, str]] = []
        size = 0
        for batch in batches:
            for mark, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                text = text or ""
                if waiting is not None:
                    out.append((*waiting, text))
                    size += len(waiting[1])
                waiting = None if mark else (doc_id, text)
                if size >= GROUP_BYTES // 2:
                    yield out
                    out, size = [], 0
        if out:
            yield out

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in rows(batches):
            edited = [(t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]).encode() for _, t, nxt in docs]
            # A next text is the following row's own, but at a part's end.
            own = [t.encode() for _, t, _ in docs]
            apart = [k for k in range(len(docs)) if k + 1 == len(docs) or docs[k + 1][1] is not docs[k][2]]
            made = chains([*own, *edited, *(docs[k][2].encode() for k in apart)], shared.value)
            n = len(docs)
            later = dict(zip(apart, made[2 * n :], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _, _ in docs], pa.int64()),
                    pa.array([len(t) for _, t, _ in docs], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([encode(c) for c in made[:n]]),
                    pa.array([encode(c) for c in made[n : 2 * n]]),
                    pa.array([likeness(made[k], made[n + k]) for k in range(n)]),
                    pa.array([likeness(made[k], later[k] if k in later else made[k + 1]) for k in range(n)]),
                ],
                names=[c.split()[0] for c in COMPARED.split(", ")],
            )

    return with_next(docs, parts).mapInArrow(compared, COMPARED)
