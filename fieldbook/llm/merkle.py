"""A Merkle manifest: one tree of digests for each source, and one over the sources.

Leaves are digests of rows, made where the rows lie; only digests are moved.
They are numbered in order by a range sort and the counts of its parts. Aligned
blocks of WIDE ** LEVELS numbered nodes are small trees of their own: a
postorder traversal of a block returns the digest of each subtree and, while
it unwinds, appends each child's siblings to the proofs of the leaves below it.
The blocks' tops, numbered as their blocks are, feed the same traversal again
until one node is left of each tree. Then the proofs of each pass are put after
those of the pass below it, block by block.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from fieldbook.llm.common import Scratch

#: Children of a node, and levels of a block: a block has WIDE ** LEVELS nodes at most.
WIDE = 3
LEVELS = 6
#: Rows of a part of the range sort, on average.
PART_ROWS = 200_000
PROOF = "array<struct<before:binary,after:binary>>"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(value: Column) -> Column:
    """`-` for null, else the bytes of the value, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row of values; no two different rows have the same input."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to by its proof."""
    hexed = lambda c: F.lower(F.hex(c))
    return F.aggregate(proof, digest, lambda own, step: F.sha2(F.concat(hexed(step["before"]), own, hexed(step["after"])), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level."""
    siblings = F.transform(proof, lambda step: F.lower(F.concat(F.hex(step["before"]), F.hex(step["after"]))))
    return F.sha2(F.array_join(siblings, ""), 256)


def traverse(digests: list[str], levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top of a block's tree of so many levels, and each leaf's proof: of every level the siblings before and after."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in digests]

    def visit(start: int, level: int) -> str:
        if level == 0:
            return digests[start]
        step = WIDE ** (level - 1)
        starts = range(start, min(start + step * WIDE, len(digests)), step)
        children = [visit(s, level - 1) for s in starts]
        for k, s in enumerate(starts):
            siblings = "".join(children[:k]), "".join(children[k + 1 :])
            for own in proofs[s : s + step]:
                own.append(siblings)
        return sha256("".join(children).encode()).hexdigest()

    return visit(0, levels), proofs


def levels_of(size: int) -> int:
    """The levels over so many nodes until one is left."""
    levels, reach = 0, 1
    while reach < size:
        levels, reach = levels + 1, reach * WIDE
    return levels


def traversed(nodes: DataFrame) -> DataFrame:
    """nodes (tree, at, size, digest and what else there is) with block, proof (of this pass) and top (of the block)."""
    wide = nodes.withColumn("block", F.floor(F.col("at") / WIDE**LEVELS))
    schema = StructType([*wide.schema.fields, *StructType.fromDDL(f"proof {PROOF}, top string").fields])
    steps = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))

    def made(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        digests = block.column("digest").to_pylist()
        top, proofs = traverse(digests, min(LEVELS, levels_of(block.column("size")[0].as_py())))
        packed = pa.array([[{"before": bytes.fromhex(a), "after": bytes.fromhex(b)} for a, b in p] for p in proofs], steps)
        return block.append_column("proof", packed).append_column("top", pa.array([top] * len(digests)))

    return wide.groupBy("tree", "block").applyInArrow(made, schema)


def numbered(rows: DataFrame, order: list[Column], name: str, count: int, scratch: Scratch, parts: str) -> DataFrame:
    """rows with their place in an order, from 0, and the part of the sort that holds them; no row of the order may tie."""
    n = max(1, -(-count // PART_ROWS))
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    laid = scratch.save(name, laid.withColumn(parts, F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1)))
    sizes = laid.groupBy(parts).agg(F.count("*").alias("_n"))  # a row for each part
    before = F.sum("_n").over(Window.orderBy(parts).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(parts, F.coalesce(before, F.lit(0)).alias("_start"))
    return laid.join(starts, parts).withColumn("place", F.col("_place") + F.col("_start")).drop("_place", "_start")


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, proof, subroot, root and what is carried, for each row.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Of each
    source the leaves stand in the order of doc_id (null first); rows of one
    doc_id in that of their leaves. While several nodes remain, every WIDE
    consecutive ones become one; the last ones may be fewer, even one. The
    subroots of the sources, in the bytewise order of their names (null
    first), become the root in the same way. proof holds the siblings before
    and after a leaf's own node, up to the root; folded() and proof_digest()
    read it. carried: names and expressions over docs that are computed along
    with the leaves. Null columns count as such, repeated rows are leaves of
    their own, other columns are not read, and an empty table gives an empty
    one.
    """
    carried = carried or {}
    scratch = Scratch(docs.sparkSession, "merkle")
    rows = docs.select("doc_id", "source", leaf(*map(F.col, COLUMNS)).alias("digest"), *[c.alias(f"_{n}") for n, c in carried.items()])
    rows = scratch.save("leaves", rows.withColumn("row", F.monotonically_increasing_id()))
    # Numbers: equal rows differ by `row`, so that a source or an id of any weight is cut anywhere.
    first = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("row")]
    placed = numbered(rows, first, "laid", rows.count(), scratch, "part").drop("row").withColumn("name", encoded(F.col("source")))
    placed = scratch.save("placed", placed)
    runs = scratch.save("runs", placed.groupBy("part", "name", "source").agg(F.min("place").alias("start"), F.count("*").alias("n")))
    sources = scratch.save("sources", runs.groupBy("name", "source").agg(F.min("start").alias("start"), F.sum("n").alias("size")))
    many = sources.count()
    trees = scratch.save("trees", numbered(sources, [F.asc_nulls_first("source")], "names", many, scratch, "_part").select("name", F.col("place").alias("tree"), "start", "size"))
    runs = runs.select("part", "name").join(trees, "name")
    # A part's rows of a source are no more than the part: no key here is hot.
    nodes = placed.join(runs, ["part", "name"]).withColumn("at", F.col("place") - F.col("start")).drop("part", "name", "place", "start")
    below = climbed(nodes, scratch, "leaf")
    subroots = complete(below)
    over = climbed(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(many).cast("long").alias("size"), F.col("top").alias("digest")), scratch, "source")
    root = complete(over).select("tree", "top", F.array().cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"))
    above = descended(over, root, scratch, "source").select(F.col("at").alias("tree"), F.col("root").alias("top"), "proof", F.col("digest").alias("subroot"))
    out = descended(below, scratch.save("above", above), scratch, "leaf")
    return out.select("doc_id", "source", F.col("digest").alias("leaf"), "proof", "subroot", "root", *[F.col(f"_{n}").alias(n) for n in carried])


def climbed(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """The passes over nodes (tree, at, size, digest) until each tree has one top."""
    passes = []
    while True:
        passes.append(scratch.save(f"{name}-{len(passes)}", traversed(nodes)))
        # A block's first node speaks for it.
        tops = passes[-1].where(F.col("at") == F.col("block") * WIDE**LEVELS).where(F.col("size") > WIDE**LEVELS)
        nodes = tops.select("tree", F.col("block").alias("at"), F.ceil(F.col("size") / WIDE**LEVELS).alias("size"), F.col("top").alias("digest"))
        if not nodes.take(1):
            return passes


def complete(passes: list[DataFrame]) -> DataFrame:
    """(tree, top) of each tree; the pass that ends it has one block of it."""
    ended = [p.where((F.col("at") == 0) & (F.col("size") <= WIDE**LEVELS)).select("tree", "top") for p in passes]
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out


def descended(passes: list[DataFrame], roots: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The lowest pass's nodes with whole proofs, root and subroot; roots: (tree, top, proof, subroot), what stands above each tree."""
    out = None
    for k in reversed(range(len(passes))):
        ended = passes[k].where((F.col("at") == 0) & (F.col("size") <= WIDE**LEVELS)).select("tree")
        above = roots.join(ended, "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("block"), F.col("top").alias("root"), "subroot", F.col("proof").alias("_above"))
        if out is not None:
            above = above.unionByName(scratch.save(f"{name}-above-{k}", out.select("tree", F.col("at").alias("block"), "root", "subroot", F.col("proof").alias("_above"))))
        out = passes[k].drop("top").join(above, ["tree", "block"]).withColumn("proof", F.concat("proof", "_above")).drop("_above")
    return out
