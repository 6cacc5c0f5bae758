"""N-gram Jaccard join: a grouped prefix join over word shingles.

A document's set is that of its distinct word shingles. Equal sets are one
class. Of each class the first shingles of the order of hashes are kept (the
extended prefix: similar sets share many of it), and those that no other class
keeps are dropped, which leaves few classes. Their kept shingles are ordered
by frequency; the first of them are the prefix of which similar sets share at
least one. Classes with the same size and prefix form a group. The groups that
share a prefix shingle meet in cells, one for each range of sizes, so that no
cell holds groups of which none can be similar. Pairs of groups are filtered
by their sizes and by the places of their shared shingles; those that pass are
expanded to their members and verified, which gives at most one link per
member. Cells that are too heavy for a task are dealt out in blocks, and what
the blocks have connected is not compared again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.bytehash import mix, shingle_sets
from fieldbook.llm.common import Scratch, connected, dealt_join

#: Shingles and members of a cell that a task verifies at once; heavier cells are cut into blocks.
CELL_SHINGLES = 1 << 18
CELL_MEMBERS = 256
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096


def at_least(n: int, num: int, den: int) -> int:
    """The least overlap with a similar set that a set of size n can have, which is also that set's least size."""
    return -(-num * n // den)


def spare(n: int) -> int:
    """How many more shingles than one the extended prefixes of similar sets must share."""
    return max(1, n // 10)


def needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many kept shingles a set of size n shares with a similar one, at least."""
    return np.maximum(1, -(-num * n // den) // 10)


def set_key(s: np.ndarray) -> int:
    """A fingerprint of a whole set; equal ones of different sets have a chance of 2**-64."""
    return int(mix((mix(s + np.uint64(0x5BF03635)).sum(keepdims=True) + np.uint64(len(s))))[0])


def extended_prefixes(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, key, kept): the set's size, its key and its extended prefix in the order of hashes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], words)
            sizes = [len(s) for s in sets]
            kept = [s[: n - at_least(n, num, den) + spare(n)] if n else s for s, n in zip(sets, sizes, strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            flat = np.concatenate([*kept, np.empty(0, np.uint64)]).view(np.int64)
            keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "n", "key", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, n long, key long, kept array<long>")


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of each text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in batch.column(0).to_pylist()], words)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "shingles"])

    return docs.select("text").mapInArrow(made, "key long, shingles array<long>")


def similar(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets are linked: a matrix, from all intersections at once."""
    n = np.array([len(s) for s in sets], np.int32)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    shingle = np.cumsum(new) - 1
    often = np.bincount(shingle) > 1  # the others meet nobody
    column = np.cumsum(often) - 1
    keep = often[shingle]
    shingle, owner = column[shingle[keep]], owner[keep]
    both = np.zeros((len(sets), len(sets)), np.float32)
    bounds = np.searchsorted(shingle, np.arange(0, int(often.sum()) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], shingle[a:b] - k * COLUMNS] = 1
        both += m @ m.T
    both = np.round(both).astype(np.int32)
    return (den + num) * both >= num * (n[:, None] + n[None, :])


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (first, other) that connect what the matrix connects."""
    left = np.ones(len(near), bool)
    out = []
    for first in range(len(near)):
        if not left[first]:
            continue
        left[first] = False
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(near[front].any(0) & left)
            left[front] = False
            out += [(first, int(k)) for k in front]
    return out


def pairs_of_groups(n: np.ndarray, home: np.ndarray, rest: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of a cell's groups can hold links that are to be found in this cell: a matrix.

    n: their sizes; home: whether the cell's range of sizes is their own (two
    others meet elsewhere); rest: how many of their kept shingles come from the
    first that is in this cell on. A pair is found in the cell of its first
    shared shingle, from which on it shares as many as a link needs.
    """
    need = needed(n, num, den)
    sizes = den * np.minimum.outer(n, n) >= num * np.maximum.outer(n, n)
    places = np.minimum.outer(rest, rest) >= np.maximum.outer(need, need)
    return sizes & places & (home[:, None] | home[None, :])


def verified(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between keys, at most one fewer than members of each cell; cells: (cell, key, gid, home, rest, shingles)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}

        def links() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            keys = list(sets)
            if len(keys) > 1:
                group = np.unique(np.array([sets[k][1] for k in keys], np.int64), return_index=True, return_inverse=True)
                one = [sets[keys[k]] for k in group[1]]
                pairs = pairs_of_groups(*(np.array(x) for x in ([len(g[0]) for g in one], [g[2] for g in one], [g[3] for g in one])), num, den)
                # Groups that no pair holds are not expanded, nor is a group's pair with itself if it has one member.
                alone = np.bincount(group[2])[np.arange(len(one))] == 1
                met = (pairs & ~np.diag(alone)).any(1)[group[2]]
                keys, own = [k for k, m in zip(keys, met, strict=True) if m], group[2][met]
                if len(keys) > 1:
                    found = forest(similar([sets[k][0] for k in keys], num, den) & pairs[own[:, None], own[None, :]])
            return pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in found], pa.int64()), pa.array([keys[b] for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            values = batch.column(5)
            flat, ends = values.flatten().to_numpy(), values.offsets.to_numpy()
            ends = ends - ends[0]
            for k, (c, key, gid, home, rest) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if c != cell:
                    yield links()
                    cell, sets = c, {}
                sets[key] = (flat[ends[k] : ends[k + 1]], gid, home, rest)
        yield links()

    return cells.select("cell", "key", "gid", "home", "rest", "shingles").repartition("cell").sortWithinPartitions("cell").mapInArrow(made, "a long, b long")


def cells_of(groups: DataFrame, members: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(leader, band, key, gid, size, home, rest, blocks): the members of each cell and how many blocks it has, of groups (gid, n, prefix, kept, members) and members (gid, key).

    Sizes fall into bands, so that similar sets are of one band or of
    neighbouring ones; each group is at home in its own band and a guest in the
    next. The groups of a shingle and band belong to the cell of the least of
    them, so that shingles whose groups are nearly the same share a cell.
    """
    # A little wider than the ratio of sizes, so that rounding cannot part two sizes by two bands.
    band = F.floor(F.log("n") / math.log(den / num * 1.0001)).cast("int")
    each = groups.select(F.posexplode("prefix").alias("at", "token"), "gid", "n", "members", (F.col("kept") - F.col("at")).alias("rest"), band.alias("own"))
    entries = each.select("token", "gid", "n", "members", "rest", F.explode(F.array(F.struct(F.col("own").alias("band"), F.lit(True).alias("home")), F.struct((F.col("own") + 1).alias("band"), F.lit(False).alias("home")))).alias("b"))
    entries = entries.select("token", "gid", "n", "members", "rest", "b.*")
    least = entries.groupBy("token", "band").agg(F.min("gid").alias("leader"), F.sum("members").alias("all"), F.bool_or("home").alias("any"), F.count("*").alias("n"))
    least = scratch.save("least", least.where("any AND all > 1").select("token", "band", "leader", "n"))
    met = dealt_join(entries, least, ["token", "band"], F.col("gid")).groupBy("leader", "band", "gid", "n", "members", "home").agg(F.max("rest").alias("rest"))
    pairs = scratch.save("pairs", met)
    blocks = blocks_for(F.sum("members"), F.sum(F.col("n") * F.col("members")))
    cells = scratch.save("heads", pairs.groupBy("leader", "band").agg(blocks.alias("blocks"), F.count("*").alias("n")))
    rows = dealt_join(pairs.withColumnRenamed("n", "size"), cells, ["leader", "band"], F.col("gid"))
    rows = dealt_join(members, scratch.save("rows", rows.withColumnRenamed("members", "n")), ["gid"], F.col("key"))
    return rows.select("leader", "band", "key", "gid", "size", "home", "rest", "blocks")


def blocks_for(members: Column, shingles: Column) -> Column:
    """In how many blocks so many members with so many shingles are verified."""
    return F.ceil(F.greatest(members / CELL_MEMBERS, shingles / CELL_SHINGLES)).cast("int")


def in_blocks(rows: DataFrame, *block: Column) -> DataFrame:
    """rows as cells to be verified, one for each leader, band and block."""
    return rows.select(F.xxhash64("leader", "band", *block).alias("cell"), "key", "gid", "home", "rest")


def across_blocks(heavy: DataFrame, found: DataFrame, links: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """links, and those that heavy cells add between their blocks; heavy: (leader, band, key, gid, size, home, rest), links: those within blocks.

    What is connected already needs no more links. So one member of each
    connected set of a cell meets those of the other sets, as long as that
    halves the sets; near copies of one text become one set, with work in
    proportion to their number. Then members leave of whose shingles too few
    occur in other sets of the cell for a link; texts that merely share a
    passage go so. Those that remain meet the members of other sets, where
    pairs within the largest set are left out.
    """
    before, k = heavy.count(), 0
    while before:
        # Each round's sets, from all links so far.
        roots = connected(links, Scratch(heavy.sparkSession, "jaccard-sets"))
        named = heavy.join(roots, heavy.key == roots.node, "left").select(*heavy.columns, F.coalesce("root", "key").alias("set"))
        named = scratch.save(f"heavy-{k}", named)
        one = F.min(F.struct(~F.col("home"), F.xxhash64(F.lit(k), "key"), "key", "gid", "size", "home", "rest")).alias("one")
        parts = scratch.save(f"sets-{k}", named.groupBy("leader", "band", "set").agg(one).select("leader", "band", "one.*"))
        several = parts.groupBy("leader", "band").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
        several = scratch.save(f"several-{k}", several.withColumn("blocks", blocks_for(F.col("n"), F.col("shingles"))).drop("shingles"))
        now = several.agg(F.sum("n")).first()[0] or 0
        if 2 * now > before or not now:
            break
        parts = dealt_join(parts, several, ["leader", "band"], F.xxhash64("key"))
        more = in_blocks(parts, F.pmod(F.xxhash64(F.lit(k), "key"), F.col("blocks")))
        links = scratch.save(f"links-{k}", links.union(verified(more.join(found, "key"), num, den)).distinct())
        before, k = now, k + 1
    if not before or not now:
        return links
    every = named.groupBy("leader", "band").agg(F.count("*").alias("n")).join(several.select("leader", "band"), ["leader", "band"])
    stuck = scratch.save("stuck", dealt_join(named, scratch.save("every", every), ["leader", "band"], F.xxhash64("key")))
    stuck = possible(stuck, found, num, den, scratch)
    parts = stuck.groupBy("leader", "band", "set").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    main = F.max(F.struct("n", "shingles", "set")).alias("main")
    cells = parts.groupBy("leader", "band").agg(main, F.count("*").alias("sets"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).where("sets > 1")
    light = blocks_for(F.col("n"), F.col("shingles")) <= 1
    few = F.when(light, 1).otherwise(blocks_for(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles")))
    cells = cells.select("leader", "band", "n", few.alias("few"), F.when(light, 0).otherwise(blocks_for(F.col("main.n"), F.col("main.shingles"))).alias("many"), F.col("main.set").alias("main"))
    rows = dealt_join(stuck, scratch.save("dealt", cells), ["leader", "band"], F.xxhash64("key"))
    other = (F.col("set") != F.col("main")) | (F.col("many") == 0)
    own = F.when(other, F.pmod(F.xxhash64("key"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("key"), F.greatest("many", F.lit(1))))
    met = F.sequence(F.lit(0), F.when(other, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    rows = rows.select("leader", "band", "key", "gid", "home", "rest", own.alias("own"), F.explode(met).alias("other"))
    last = in_blocks(rows, F.least("own", "other"), F.greatest("own", "other"))
    return scratch.save("links-last", links.union(verified(last.join(found, "key"), num, den)).distinct())


def possible(stuck: DataFrame, found: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The rows of stuck (leader, band, key, size, set, ...) that can be linked with another set of their cell.

    A link takes num/den of a member's own shingles, which must therefore occur
    in other sets of the cell; whoever has fewer of these leaves, which may
    make others leave.
    """
    texts = found.join(stuck.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    texts, rows, k = scratch.save("stuck-texts", texts), stuck.count(), 0
    while True:
        tokens = stuck.select("leader", "band", "key", "set").join(texts, "key").select("leader", "band", "key", "set", F.explode("shingles").alias("token"))
        often = tokens.groupBy("leader", "band", "token").agg(F.count("*").alias("n"), F.min("set").alias("a"), F.max("set").alias("b")).where("a <> b")
        often = scratch.save(f"tokens-{k}", often.select("leader", "band", "token", "n"))
        counts = dealt_join(tokens, often, ["leader", "band", "token"], F.xxhash64("key")).groupBy("leader", "band", "key").agg(F.count("*").alias("shared"))
        stuck = scratch.save(f"stuck-{k}", stuck.join(counts, ["leader", "band", "key"]).where(den * F.col("shared") >= num * F.col("size")).drop("shared"))
        now = stuck.count()
        if 10 * now >= 9 * rows:
            return stuck
        rows, k = now, k + 1


def link_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: the least doc_id that links reach, itself included.

    Two documents are linked when the Jaccard similarity of their sets is
    num/den or more. With fewer words the whole sequence is the one shingle;
    without words or with a null text the set is empty, and linked with
    nothing. A row whose doc_id is null takes no part, and its component_id is
    null. Repeated rows are treated alike. Only doc_id and text are read. An
    empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    sets = scratch.save("sets", extended_prefixes(docs, words, num, den))
    some = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.save("classes", some.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    kept = some.join(classes.select("key", F.col("first").alias("doc_id")), ["key", "doc_id"]).select("key", F.col("n").alias("size"), F.explode("kept").alias("token"))
    often = scratch.save("often", kept.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").withColumn("often", F.col("n")))
    shared = dealt_join(kept, often, ["token"], F.col("key")).groupBy("key", "size").agg(F.array_sort(F.collect_set(F.struct("often", "token"))).alias("shared"))
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("size") * num / den) / 10)).cast("int")
    prefix = F.slice("shared.token", F.lit(1), F.size("shared") - need + 1)
    prefixes = shared.where(F.size("shared") >= need).select("key", F.col("size").alias("n"), F.size("shared").alias("kept"), prefix.alias("prefix"))
    prefixes = scratch.save("prefixes", prefixes.withColumn("gid", F.xxhash64("n", "prefix")))
    groups = scratch.save("groups", prefixes.groupBy("gid", "n", "kept", "prefix").agg(F.count("*").alias("members")))
    members = prefixes.select("gid", "key")
    wanted = prefixes.select("key").join(classes, "key").select(F.col("first").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(scratch.save("wanted", wanted), "doc_id")
    found = scratch.save("found", whole_sets(texts, words))
    cells = scratch.save("cells", cells_of(groups, members, num, den, scratch))
    first = in_blocks(cells, F.pmod(F.xxhash64("key"), F.col("blocks")))
    links = scratch.save("links", verified(first.join(found, "key"), num, den).distinct())
    links = across_blocks(cells.where("blocks > 1").drop("blocks"), found, links, num, den, scratch)
    scratch.drop("often", "prefixes", "groups", "wanted", "least", "pairs", "heads", "rows", "found", "cells")
    roots = connected(links, scratch)
    reached = roots.join(classes, roots.node == classes.key).select("key", "root", "first")
    least_id = reached.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    reached = dealt_join(reached.select("key", "root"), scratch.save("roots", least_id), ["root"], F.col("key")).select("key", "component_id")
    named = classes.join(reached, "key", "left").select("key", F.coalesce("component_id", "first").alias("component_id"), F.col("copies").alias("n"))
    named = scratch.save("named", named)
    scratch.drop("links", "roots", "classes")
    own = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("key")).alias("key"))
    joined = dealt_join(own.where("key IS NOT NULL"), named, ["key"], F.monotonically_increasing_id()).select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(own.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
