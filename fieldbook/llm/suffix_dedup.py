"""Suffix-array dedup: remove every byte of a long string that starts elsewhere too, by blockwise suffix sorting.

A string of `length` bytes belongs to the bucket of its anchor: of all its
grams of GRAM bytes the one of least hash (the first of equals). Equal strings
have equal anchors in equal places, so each bucket is complete, and a bucket
with one member needs no sorting. Neighbouring strings with one anchor form a
run; runs of equal content are counted, and one of them goes to its bucket.

A task sorts one bucket's suffixes at a time. Runs are laid out with their
anchors on multiples of the period of a difference cover. The suffixes at the
positions of the cover are ranked first, by prefix doubling; others compare by
the few bytes before their next cover position, and then by its rank, however
long the tie. Neighbours in the sorted order are compared byte by byte.
Buckets with too many different runs are dealt out further, down to single
strings, and counted with partial sums, so that no task holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.bytehash import groups, spans, sums
from fieldbook.llm.common import Scratch, dealt_join

LENGTH = 400
GRAM = 64
#: Bytes of a text that are looked at together; a longer one is cut into overlapping segments.
SEGMENT = 1 << 20
#: Low bits of a gram's sorting key that hold its position, which is below SEGMENT + LENGTH or GROUP_BYTES.
PLACE = 28
PERIOD = 32
#: Different runs of a bucket up to which one task sorts it.
BUCKET_RUNS = 2048
#: Neighbouring strings of a run in a bucket beyond that which are dealt out together.
BLOCK = 4
#: Bytes of runs that are sorted together.
SORTED_BYTES = 1 << 20
GROUP_BYTES = 256 << 10


def difference_cover(period: int) -> list[int]:
    """Residues of which every residue is a difference, chosen greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda x: len({d for c in cover for d in ((x - c) % period, (c - x) % period)} & missing)
        new = max((x for x in range(period) if x not in cover), key=lambda x: (gain(x), -x))
        missing -= {d for c in cover for d in ((new - c) % period, (c - new) % period)}
        cover.append(new)
    return sorted(cover)


COVER = np.array(difference_cover(PERIOD))
IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Bytes from a residue to the next one in the cover.
TO_COVER = np.array([int(((COVER - r) % PERIOD).min()) for r in range(PERIOD)])

RUNS = "doc_id long, text_hash long, anchor long, content long, start long, strings int, inside int"


def least_grams(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    out, reach = key, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


def runs_of(docs: DataFrame, length: int) -> DataFrame:
    """RUNS: each run's anchor and content as hashes, its first string, its number of strings and the anchor's place in it."""
    width = length - GRAM + 1

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            segments = []  # (row, place, bytes): every string starts in one segment and lies whole in it
            for row, t in enumerate(batch.column(2).to_pylist()):
                data = (t or "").encode()
                segments += [(row, k, data[k : k + SEGMENT + length - 1]) for k in range(0, len(data) - length + 1, SEGMENT)]
            for lo, hi in groups([len(x) for *_, x in segments], GROUP_BYTES):
                some = segments[lo:hi]
                starts = np.zeros(hi - lo + 1, np.int64)
                np.cumsum([len(x) for *_, x in some], out=starts[1:])
                buf = np.frombuffer(b"".join([x for *_, x in some]), np.uint8)
                running = sums(buf)
                at = np.arange(len(buf) - GRAM + 1)
                gram = spans(running, at, at + GRAM)
                least = least_grams((gram >> np.uint64(PLACE) << np.uint64(PLACE)) | at.astype(np.uint64), width)
                inside = np.zeros(len(buf) + 1, bool)
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    inside[a : max(a, b - length + 1)] = True
                s = np.flatnonzero(inside[: len(least)])
                if not len(s):
                    continue
                p = (least[s] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
                n = np.diff(np.append(first, len(s)))
                start, anchor = s[first], p[first]
                own = np.searchsorted(starts, start, "right") - 1
                row, place = (np.array([x[k] for x in some])[own] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row)),
                        hashes.take(pa.array(row)),
                        pa.array(gram[anchor].view(np.int64)),
                        pa.array(spans(running, start, start + n - 1 + length).view(np.int64)),
                        pa.array(start - starts[own] + place),
                        pa.array(n.astype(np.int32)),
                        pa.array((anchor - start).astype(np.int32)),
                    ],
                    names=[c.split()[0] for c in RUNS.split(", ")],
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(made, RUNS)


PIECES = "anchor long, content long, strings int, inside int, crowded boolean, piece binary"


def pieces_of(docs: DataFrame, length: int) -> DataFrame:
    """PIECES: the bytes of wanted runs, of docs with text and wanted (array of structs)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                for w in wanted:
                    piece = data[w["start"] : w["start"] + w["strings"] - 1 + length]
                    rows.append((w["anchor"], w["content"], w["strings"], w["inside"], w["crowded"], piece))
                    held += len(piece)
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return docs.select("text", "wanted").mapInArrow(made, PIECES)


def ranks(*words: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples, the first word first."""
    out = np.unique(words[0], return_inverse=True)[1]
    for w in words[1:]:
        out = np.unique(out * np.int64(len(w) + 1) + np.unique(w, return_inverse=True)[1], return_inverse=True)[1]
    return out


def repeated_strings(pieces: list[bytes], buckets: np.ndarray, inside: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece which of its strings of this length another piece of its bucket has too."""
    base = np.zeros(len(pieces), np.int64)
    at = 0
    for k, piece in enumerate(pieces):  # anchors on multiples of the period
        at += -(at + int(inside[k])) % PERIOD
        base[k] = at
        at += len(piece)
    buf = np.zeros(at + 2 * length + 4 * PERIOD + 8, np.uint8)
    for k, piece in enumerate(pieces):
        buf[base[k] : base[k] + len(piece)] = np.frombuffer(piece, np.uint8)
    word = np.lib.stride_tricks.as_strided(buf[:8].view(">u8"), (len(buf) - 7,), (1,))
    # Ranks of the cover's suffixes, to a depth of at least the length.
    ends = at + PERIOD
    sample = np.flatnonzero(IN_COVER[np.arange(ends) % PERIOD])
    rank = ranks(*(word[sample + 8 * k].astype(np.uint64) for k in range(PERIOD // 8)))
    depth, per = PERIOD, len(COVER)
    while depth < length:
        ahead = np.append(rank[depth // PERIOD * per :], np.full(min(len(rank), depth // PERIOD * per), -1))
        rank = np.unique(rank.astype(np.int64) * (len(rank) + 1) + ahead + 1, return_inverse=True)[1]
        depth *= 2
    place = np.zeros(ends, np.int64)
    place[sample] = rank
    # The bucket's suffixes: strings whose anchor is equally far share a residue, and so the way to the cover.
    n = np.array([len(p) - length + 1 for p in pieces])
    owner = np.repeat(np.arange(len(pieces)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i = base[owner] + offset
    group = (buckets[owner].astype(np.int64) << 16) | (inside[owner] - offset)
    gap = TO_COVER[i % PERIOD]
    head = [np.where(gap >= 8 * k + 8, word[i + 8 * k], np.where(gap > 8 * k, word[i + 8 * k] >> np.clip(64 - 8 * (gap - 8 * k), 0, 63).astype(np.uint64), np.uint64(0))).astype(np.uint64) for k in range(-(-int(TO_COVER.max()) // 8))]
    order = np.lexsort((place[i + gap], *head[::-1], group))
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((group[a] == group[b]) & np.logical_and.reduce([h[a] == h[b] for h in head]))
    x, y = i[a[near]], i[b[near]]
    for k in [*range(0, length - 7, 8), length - 8]:
        same = word[x + k] == word[y + k]
        near, x, y = near[same], x[same], y[same]
    hit = np.zeros(len(i), bool)
    hit[a[near]] = hit[b[near]] = True
    return np.split(hit, np.cumsum(n)[:-1])


def stretches(hit: np.ndarray) -> list[dict]:
    """First and last place of each stretch of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[0::2], edge[1::2], strict=True)]


FOUND = "anchor long, content long, places array<struct<first:int,last:int>>"
PLACES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def sorted_buckets(pieces: DataFrame, length: int) -> DataFrame:
    """FOUND: where each run's strings occur in another run of its bucket."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            bucket = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
            hits = repeated_strings([r[3] for r in rows], bucket, np.array([r[2] for r in rows], np.int64), length) if rows else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([stretches(h) for h in hits], PLACES)], names=["anchor", "content", "places"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held >= SORTED_BYTES and row[0] != rows[-1][0]:
                    yield flush()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield flush()

    return pieces.select("anchor", "content", "inside", "piece").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(made, FOUND)


BLOCKS = "anchor long, content long, blocks array<struct<block:int,core:long,whole:long,place:int,strings:array<long>>>"


def crowded_buckets(pieces: DataFrame, length: int) -> DataFrame:
    """The same for buckets of many runs, whose suffixes are split by what they hold.

    A run's strings fall into blocks by how far their anchor is. A block's core
    is what all its strings share; blocks with different cores never meet.
    Equal blocks are counted, and only of different ones with one core is each
    string a bucket of its own. All counting is by hash, with partial sums.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece, inside in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                running = sums(np.frombuffer(piece, np.uint8))
                place = np.arange(len(piece) - length + 1)
                far = inside - place  # falls from place to place
                block = far // BLOCK
                first = np.flatnonzero(np.diff(block, prepend=block[0] + 1))
                n = np.diff(np.append(first, len(place)))
                nearest = inside - BLOCK * block[first]
                core = spans(running, nearest, nearest - BLOCK + 1 + length).view(np.int64)
                whole = (spans(running, first, first + n - 1 + length) + far[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                strings = spans(running, place, place + length).view(np.int64)
                out.append([{"block": int(block[f]), "core": int(c), "whole": int(w), "place": int(f), "strings": strings[f : f + k].tolist()} for f, k, c, w in zip(first, n, core, whole, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["anchor", "content", "blocks"])

    kind = pa.list_(pa.struct([("block", pa.int32()), ("core", pa.int64()), ("whole", pa.int64()), ("place", pa.int32()), ("strings", pa.list_(pa.int64()))]))
    each = pieces.select("anchor", "content", "inside", "piece").mapInArrow(made, BLOCKS).select("anchor", "content", F.explode("blocks").alias("b")).select("anchor", "content", "b.*")
    scratch = Scratch(pieces.sparkSession, "crowded")
    each = scratch.save("blocks", each)
    key = ["anchor", "block", "core"]
    spread = F.xxhash64("whole")
    wholes = each.groupBy(*key, "whole").agg(F.count("*").alias("copies"), F.min("strings").alias("strings"))
    wholes = scratch.save("wholes", wholes)
    mixed = wholes.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    single = dealt_join(wholes, mixed, key, spread).select(*key, "whole", F.posexplode("strings").alias("at", "string"))
    often = single.groupBy("string").agg(F.count("*").alias("n")).where("n > 1")
    hits = dealt_join(single, often, ["string"], spread).groupBy(*key, "whole").agg(F.array_sort(F.collect_set("at")).alias("hit"))
    every = F.sequence(F.lit(0), F.size("strings") - 1)
    marked = wholes.join(hits, [*key, "whole"], "left").select(*key, "whole", F.col("copies").alias("n"), F.when(F.col("copies") > 1, every).otherwise(F.col("hit")).alias("hit")).where("hit IS NOT NULL")
    placed = dealt_join(each.select(*key, "whole", "content", "place"), marked, [*key, "whole"], F.col("content"))
    hit = placed.groupBy("anchor", "content").agg(F.array_sort(F.flatten(F.collect_list(F.transform("hit", lambda x: x + F.col("place"))))).alias("hit"))
    first = F.array_except("hit", F.transform("hit", lambda x: x + 1))
    last = F.array_except("hit", F.transform("hit", lambda x: x - 1))
    return hit.select("anchor", "content", F.arrays_zip(first.alias("first"), last.alias("last")).alias("places"))


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, first, last): stretches of string starts that occur elsewhere too."""
    scratch = Scratch(docs.sparkSession, "suffix")
    runs = scratch.save("runs", runs_of(docs, length))
    often = scratch.save("often", runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    near = scratch.save("near", dealt_join(runs, often, ["anchor"], F.monotonically_increasing_id()))
    scratch.drop("runs", "often")
    place = F.struct("doc_id", "text_hash", "start", "strings", "inside")
    contents = scratch.save("contents", near.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(place).alias("one")))
    buckets = scratch.save("buckets", contents.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").withColumn("crowded", F.col("n") > BUCKET_RUNS))
    wanted = dealt_join(contents, buckets, ["anchor"], F.col("content")).select("anchor", "content", "one.*", "crowded")
    lists = wanted.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("anchor", "content", "start", "strings", "inside", "crowded")).alias("wanted"))
    texts = by_document(docs, scratch.save("wanted", lists), "inner")
    pieces = scratch.save("pieces", pieces_of(texts, length))
    found = sorted_buckets(pieces.where("NOT crowded"), length).unionByName(crowded_buckets(pieces.where("crowded"), length))
    found = found.groupBy("anchor", "content").agg(F.first("places").alias("places"))
    all_of = F.array(F.struct(F.lit(0).alias("first"), (F.col("one.strings") - 1).alias("last")))
    places = contents.join(found, ["anchor", "content"], "left").select("anchor", "content", F.col("copies").alias("n"), F.when(F.col("copies") > 1, all_of).otherwise(F.col("places")).alias("places"))
    places = scratch.save("places", places.where(F.size("places") > 0))
    scratch.drop("contents", "buckets", "wanted", "pieces")
    marks = dealt_join(near, places, ["anchor", "content"], F.monotonically_increasing_id())
    marks = marks.select("doc_id", "text_hash", "start", F.explode("places").alias("p")).select("doc_id", "text_hash", (F.col("start") + F.col("p.first")).alias("first"), (F.col("start") + F.col("p.last")).alias("last"))
    marks = scratch.save("marks", marks)
    scratch.drop("near", "places")
    return marks


def by_document(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs joined with saved lists (_doc, _hash, ...) of the rows with that doc_id and text."""
    same = docs["doc_id"].eqNullSafe(lists["_doc"]) & (docs["text_hash"] == lists["_hash"])
    return docs.join(lists, same, how)


def merged(first: list[int], end: list[int]) -> list[tuple[int, int]]:
    """The union of the stretches [first, end) as maximal ones, in order."""
    if not first:
        return []
    a, b = np.array(first, np.int64), np.array(end, np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[new].tolist(), b[np.append(new[1:] - 1, len(b) - 1)].tolist(), strict=True))


RESULT = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_text string"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept (the bytes that stay) and kept_text of each row.

    Removed is each byte of a string of `length` bytes that also starts at
    another place, in the same row or another. Spans are the maximal removed
    stretches, as byte places. kept_text holds the characters of which every
    byte stays. A null or empty text has no bytes. Texts of any length are read
    whole. Repeated rows are documents of their own, so they repeat each other.
    Only doc_id and text are read. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"))
    marks = repeated(docs.where(F.octet_length("text") >= length), length)
    lists = marks.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    lists = Scratch(docs.sparkSession, "suffix-lists").save("lists", lists)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans_, kept, texts = [], [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                cuts = merged([m["first"] for m in found or ()], [m["last"] + length for m in found or ()])
                edges = [0, *(x for cut in cuts for x in cut), len(data)]
                parts = [data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)]
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in cuts))
                spans_.append([{"start": a, "end": b} for a, b in cuts])
                kept.append(b"".join(parts))
                texts.append("".join(x.decode(errors="ignore") for x in parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(texts, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_text"],
            )

    joined = by_document(docs, lists, "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(made, "doc_id long, " + RESULT)
