"""Counting, get-or-create and order-dependent operators over entries and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldbook.functions.arrays import ITEMS, RUNS
from fieldbook.functions.text import tidy, title_key, trimmed


def queue_counts(changes: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, pending, failed) of the change queue."""
    return changes.groupBy(key).agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))


def queue_state(syncing: Column, failed: Column, pending: Column) -> Column:
    return F.when(syncing, "syncing").when(failed > 0, "failed").when(pending > 0, "pending").otherwise("synced")


def get_or_create(table: DataFrame, titles: DataFrame, by: list[str], prefix: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """table with a row for each title (title and the columns of by) that matches none.

    A new title is trimmed and has one space for each run of white space; a
    table's own titles are only trimmed before they are matched, without regard
    to case. defaults are values of new rows' other columns, such as empty tags
    or a start. Ids follow from the key, so that a retried task makes the same
    ones.
    """
    keyed = titles.withColumn("title", tidy(F.col("title"))).where("title <> ''").withColumn("_key", title_key(F.col("title")))
    one = keyed.groupBy(*by, "_key").agg(F.min("title").alias("title"))
    known = table.select(*by, F.lower(trimmed(F.col("title"))).alias("_key")).distinct()
    new = one.join(known, [*by, "_key"], "left_anti")
    new_id = F.concat(F.lit(prefix), F.sha2(F.concat_ws("/", *by, "_key"), 256).substr(1, 16))
    others = [value.alias(c) for c, value in (defaults or {}).items()]
    return table.unionByName(new.select(new_id.alias("id"), *by, "title", *others), allowMissingColumns=True)


def prepended(table: DataFrame, batch: DataFrame) -> DataFrame:
    """table (seq, ...) with a batch (pos, ...) before its first row, in the batch's own order; seq is the order of the list."""
    first = table.agg((F.coalesce(F.min("seq"), F.lit(0)) - 1).alias("_before"))  # one row each
    last = batch.agg(F.max("pos").alias("_last"))
    placed = batch.join(F.broadcast(first)).join(F.broadcast(last))
    new = placed.withColumn("seq", (F.col("_before") - (F.col("_last") - F.col("pos"))).cast("long")).drop("pos", "_before", "_last")
    return table.unionByName(new, allowMissingColumns=True)


def daily_entries(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(date_bucket, id, created): each wanted date's daily entry, the first there is, else a new one."""
    own = entries.where("is_daily").groupBy("date_bucket").agg(F.min_by("id", "seq").alias("id"))
    new_id = F.concat(F.lit("entry-"), F.col("date_bucket").cast("string"))
    return wanted.select("date_bucket").distinct().join(own, "date_bucket", "left").select("date_bucket", F.coalesce("id", new_id).alias("id"), F.isnull("id").alias("created"))


def sections(blocks: DataFrame, entry: str = "entry_id") -> DataFrame:
    """blocks with their section: a heading of level 2 begins one, and what stands before the first is 'intro'."""
    begins = (F.col("type") == "heading") & F.coalesce(F.col("level") == 2, F.lit(False))
    w = Window.partitionBy(entry).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = blocks.withColumn("section_no", F.sum(begins.cast("int")).over(w))
    head = F.last(F.when(begins, F.col("block_id")), ignorenulls=True).over(w)
    return numbered.withColumn("section_id", F.coalesce(head, F.lit("intro")))


def section_blocks(blocks: DataFrame, entry: str = "entry_id") -> DataFrame:
    """(entry, section_no, section_id, block_ids) of each section, in order."""
    own = sections(blocks, entry).groupBy(entry, "section_no", "section_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id"))).alias("b"))
    return own.select(entry, "section_no", "section_id", F.transform("b", lambda x: x["block_id"]).alias("block_ids"))


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring runs (keys, pos, text, bold, italic, underline) of equal marks as one; a null mark is false."""
    marks = ["bold", "italic", "underline"]
    clean = runs.withColumns({m: F.coalesce(m, F.lit(False)) for m in marks})
    w = Window.partitionBy(*keys).orderBy("pos")
    style = F.struct(*marks)
    islands = clean.withColumn("_new", (~style.eqNullSafe(F.lag(style).over(w))).cast("int"))
    islands = islands.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = islands.groupBy(*keys, "island", *marks).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return merged.select(*keys, F.col("island").alias("pos"), F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"), *marks)


def merged_runs(runs: Column) -> Column:
    """The same within one array of runs; null unless a run has a mark or there are several."""

    def clean(r: Column) -> Column:
        return F.struct(r["text"].alias("text"), *[F.coalesce(r[m], F.lit(False)).alias(m) for m in ("bold", "italic", "underline")])

    def same(a: Column, b: Column) -> Column:
        return (a["bold"] == b["bold"]) & (a["italic"] == b["italic"]) & (a["underline"] == b["underline"])

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(last.withField("text", F.concat(last["text"], r["text"]))))
        return F.when((F.size(acc) > 0) & F.coalesce(same(last, r), F.lit(False)), joined).otherwise(F.array_append(acc, r))

    empty = F.array().cast("array<struct<text:string,bold:boolean,italic:boolean,underline:boolean>>")
    out = F.aggregate(F.transform(runs, clean), empty, step)
    shown = (F.size(out) > 1) | F.exists(out, lambda r: r["bold"] | r["italic"] | r["underline"])
    return F.when(shown, out)


def toggle_item(blocks: DataFrame, block_id: str, item_id: str, done: bool, now: Column) -> DataFrame:
    """blocks with one checklist item's state set and the block stamped."""
    here = F.col("block_id") == block_id
    items = F.transform("items", lambda i: F.when(i["id"] == item_id, i.withField("done", F.lit(done))).otherwise(i))
    return blocks.withColumns({"items": F.when(here, items).otherwise(F.col("items")), "updated_ts": F.when(here, now).otherwise(F.col("updated_ts")), "updated_by": F.when(here, F.lit("me")).otherwise(F.col("updated_by"))})


def update_block(blocks: DataFrame, block_id: str, values: dict[str, Column], now: Column) -> DataFrame:
    """blocks with one block's columns set and the block stamped."""
    here = F.col("block_id") == block_id
    new = {**values, "updated_ts": now, "updated_by": F.lit("me")}
    return blocks.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()})


def stamped(blocks: DataFrame, now: Column) -> DataFrame:
    """All blocks with one time, as a save does."""
    return blocks.withColumns({"updated_ts": now, "updated_by": F.lit("me")})


def insert_blocks(blocks: DataFrame, new: DataFrame, after: DataFrame) -> DataFrame:
    """blocks of all entries with new ones (entry_id, pos among them) after a place (entry_id, after; null: at the end)."""
    count = new.groupBy("entry_id").agg(F.count("*").alias("_n"))
    size = blocks.groupBy("entry_id").agg(F.max("pos").alias("_last"))
    place = count.join(after, "entry_id", "left").join(size, "entry_id", "left").select("entry_id", "_n", F.coalesce("after", "_last", F.lit(-1)).alias("_after"))
    moved = blocks.join(place, "entry_id", "left").withColumn("pos", (F.col("pos") + F.when(F.col("pos") > F.col("_after"), F.col("_n")).otherwise(0)).cast("int"))
    put = new.join(place, "entry_id").withColumn("pos", (F.col("_after") + 1 + F.col("pos")).cast("int"))
    return moved.drop("_n", "_after").unionByName(put.drop("_n", "_after"), allowMissingColumns=True)


def attachment_block(attachments: DataFrame, label: Column | None = None) -> DataFrame:
    """A block for each attachment: an image with its name as caption, else a file with a label."""
    image = F.col("type") == "image"
    name = F.coalesce(label, F.col("filename")) if label is not None else F.col("filename")
    return attachments.select("entry_id", F.concat(F.lit("b-"), F.col("id")).alias("block_id"), F.when(image, "image").otherwise("file").alias("type"), F.col("id").alias("attachment_id"), F.when(image, F.col("filename")).alias("caption"), F.when(~image, name).alias("label"))


#: What a node keeps of a block that an editor does not look into.
META = ("id", "type", "data", "caption", "header_row", "attachment_id", "label", "locked", "align", "updated_ts", "updated_by")
ALIGNS = ("left", "center", "right", "justify")


def _leaves(runs: Column, text: Column) -> Column:
    """A node's texts with marks: the runs, or one plain run."""
    plain = F.array(F.struct(F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast("boolean").alias(m) for m in ("bold", "italic", "underline")]))
    return F.when(F.coalesce(F.size(runs), F.lit(0)) > 0, runs).otherwise(plain.cast(RUNS))


def to_nodes(blocks: DataFrame) -> DataFrame:
    """Blocks as editor nodes (entry_id, pos, id, type, locked, align, children, items, meta).

    children are texts with marks, items those of a checklist (id, done,
    children); tables, images, files and dividers keep themselves as meta. An
    unknown type is an empty paragraph with a new id.
    """
    kind = F.col("type")
    heading, text = kind == "heading", kind.isin("heading", "paragraph", "quote")
    known = text | kind.isin("checklist", "divider", "table", "image", "file")
    items = F.transform("items", lambda i: F.struct(i["id"].alias("id"), i["done"].alias("done"), _leaves(i["runs"], i["text"]).alias("children")))
    header = F.when(kind == "table", F.coalesce("header_row", F.lit(True))).otherwise(F.col("header_row"))
    meta = F.struct(F.col("block_id").alias("id"), *[header.alias(c) if c == "header_row" else F.col(c) for c in META[1:]])
    node = F.when(heading, F.when(F.col("level") == 3, "heading-three").otherwise("heading-two")).when(kind.isin("image", "file"), "attachment").when(known, kind).otherwise("paragraph")
    return blocks.select(
        "entry_id", "pos", F.when(known, F.col("block_id")).alias("id"), node.alias("type"), F.when(heading, F.coalesce("locked", F.lit(False))).alias("locked"), F.when(text, F.col("align")).alias("align"),
        F.when(text, _leaves(F.col("runs"), F.col("text"))).when(~known, _leaves(F.lit(None).cast(RUNS), F.lit(""))).alias("children"), F.when(kind == "checklist", items).alias("items"),
        F.when(kind.isin("divider", "table", "image", "file"), meta).alias("meta"),
    )


def _is(value: Column, kind: str) -> Column:
    """Whether an untyped value is of a kind (STRING, BOOLEAN, OBJECT, ARRAY)."""
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _at(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _text_at(value: Column, name: str) -> Column:
    """A field that is a string, else null."""
    return F.when(_is(_at(value, name), "STRING"), _at(value, name, "string"))


def _flag_at(value: Column, name: str) -> Column:
    """A field that is true or false, else null."""
    return F.when(_is(_at(value, name), "BOOLEAN"), _at(value, name, "boolean"))


def _children_at(value: Column) -> Column:
    """An element's children; null for what is no element."""
    return F.when(_is(value, "OBJECT") & _is(_at(value, "children"), "ARRAY"), _at(value, "children", "array<variant>"))


def _runs_of(children: Column) -> Column:
    """The texts among children, with those of their marks that are true."""
    mark = lambda c, m: F.when(_flag_at(c, m), True).alias(m)
    texts = F.filter(children, lambda c: _is(c, "OBJECT") & _text_at(c, "text").isNotNull())
    return F.transform(texts, lambda c: F.struct(_text_at(c, "text").alias("text"), *[mark(c, m) for m in ("bold", "italic", "underline")])).cast(RUNS)


def nodes_of_json(texts: DataFrame) -> DataFrame:
    """Editor nodes, as from_nodes takes them, of untyped JSON (entry_id, nodes string); no field is trusted to have its type.

    Text that is no JSON array gives no nodes. A value that is no element is a
    paragraph. A field of another type than it should have counts as missing;
    meta counts only if it is a block, with an id and a type that are strings,
    and falls away else, so that from_nodes makes a divider of its node.
    """
    each = texts.select("entry_id", F.posexplode(F.try_variant_get(F.try_parse_json("nodes"), "$", "array<variant>")).alias("pos", "v"))
    v = F.col("v")
    each = each.withColumn("own", _children_at(v)).withColumn("element", F.col("own").isNotNull())
    kind = F.when(F.col("element"), F.coalesce(_text_at(v, "type"), F.lit("paragraph"))).otherwise("paragraph")
    m = _at(v, "meta")
    names = {"header_row": "headerRow", "attachment_id": "attachmentId", "updated_ts": "updatedAt", "updated_by": "updatedBy"}
    flags, cells = ("header_row", "locked"), F.when(_is(_at(m, "data"), "ARRAY"), _at(m, "data", "array<array<string>>"))

    def field(c: str) -> Column:
        name = names.get(c, c)
        value = cells if c == "data" else _flag_at(m, name) if c in flags else _text_at(m, name)
        return (value.try_cast("timestamp") if c == "updated_ts" else value).alias(c)

    whole = _is(m, "OBJECT") & _text_at(m, "id").isNotNull() & _text_at(m, "type").isNotNull()
    items = F.transform(
        F.filter("own", lambda c: _children_at(c).isNotNull()),
        lambda c: F.struct(_text_at(c, "itemId").alias("id"), F.coalesce(_flag_at(c, "done"), F.lit(False)).alias("done"), _runs_of(_children_at(c)).alias("children")),
    )
    align = _text_at(v, "align")
    return each.select(
        "entry_id", "pos", F.when(F.col("element"), _text_at(v, "blockId")).alias("id"), kind.alias("type"), F.coalesce(_flag_at(v, "locked"), F.lit(False)).alias("locked"), F.when(align.isin(*ALIGNS), align).alias("align"),
        F.coalesce(_runs_of(F.col("own")), F.array().cast(RUNS)).alias("children"), F.when(kind == "checklist", items).alias("items"), F.when(whole, F.struct(*[field(c) for c in META])).alias("meta"),
    )


def from_nodes(nodes: DataFrame) -> DataFrame:
    """Blocks of editor nodes. As in an editor, a table's caption and an item's timer are lost; ids that are missing follow from the place."""
    kind, meta = F.col("type"), F.col("meta")
    heading = kind.isin("heading-two", "heading-three")
    held = kind.isin("divider", "attachment", "readonly")
    whole = F.coalesce(meta["id"].isNotNull() & meta["type"].isNotNull(), F.lit(False))  # a block that the node keeps as it was
    text = heading | ~(held | kind.isin("checklist", "table"))
    own_id = F.coalesce("id", F.concat_ws("-", F.lit("b"), F.col("entry_id").cast("string"), F.col("pos").cast("string")))
    words = lambda c: F.array_join(F.transform(c, lambda r: r["text"]), "")
    items = F.transform("items", lambda i, n: F.struct(F.coalesce(i["id"], F.concat(F.lit("ci-"), own_id, F.lit("-"), n.cast("string"))).alias("id"), words(i["children"]).alias("text"), F.coalesce(i["done"], F.lit(False)).alias("done"), F.lit(None).cast("int").alias("timer_minutes"), merged_runs(i["children"]).alias("runs")))
    kept = lambda c: F.when(held & whole, meta[c])
    table = kind == "table"
    align = F.when(F.col("align").isin(*ALIGNS), F.col("align"))
    return nodes.select(
        "entry_id", "pos", F.when(held & whole, meta["id"]).when(table, F.coalesce("id", meta["id"], own_id)).otherwise(own_id).alias("block_id"),
        F.when(heading, "heading").when(held, F.when(whole, meta["type"]).otherwise("divider")).when(kind.isin("quote", "checklist", "table"), kind).otherwise("paragraph").alias("type"),
        F.when(text, F.coalesce(words(F.col("children")), F.lit(""))).alias("text"), F.when(kind == "heading-two", 2).when(kind == "heading-three", 3).alias("level"), F.when(text, merged_runs(F.col("children"))).alias("runs"),
        F.when(table, F.when(meta["type"] == "table", F.coalesce(meta["data"], F.array().cast("array<array<string>>"))).otherwise(F.array().cast("array<array<string>>"))).otherwise(kept("data")).alias("data"), kept("caption").alias("caption"),
        F.when(table, F.coalesce(F.when(meta["type"] == "table", meta["header_row"]), F.lit(True))).otherwise(kept("header_row")).alias("header_row"), kept("attachment_id").alias("attachment_id"), kept("label").alias("label"),
        F.when(kind == "checklist", F.coalesce(items, F.array().cast(ITEMS))).alias("items"), F.when(heading, F.coalesce("locked", F.lit(False))).otherwise(kept("locked")).alias("locked"),
        F.when(text | (kind == "checklist"), align).otherwise(kept("align")).alias("align"), kept("updated_ts").alias("updated_ts"), kept("updated_by").alias("updated_by"),
    )


def calendar(month_days: DataFrame, entries: DataFrame, today: Column, chosen: Column) -> DataFrame:
    """(day, entries, is_today, is_selected, is_outside) of calendar days (month, day)."""
    per_day = entries.groupBy(F.col("date_bucket").alias("day")).agg(F.count("*").alias("entries"))
    out = F.trunc("day", "MM") != F.trunc("month", "MM")
    return month_days.join(per_day, "day", "left").select("day", F.coalesce("entries", F.lit(0)).alias("entries"), (F.col("day") == today).alias("is_today"), F.coalesce(F.col("day") == chosen, F.lit(False)).alias("is_selected"), out.alias("is_outside"))


def timers(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, started, stopped) of checklist timers (keys, ts, action), an extension: each start with the stop that follows it."""
    w = Window.partitionBy(*keys).orderBy("ts")
    paired = events.withColumn("_next", F.lead("action").over(w)).withColumn("_stop", F.lead("ts").over(w))
    return paired.where("action = 'start'").select(*keys, F.col("ts").alias("started"), F.when(F.col("_next") == "stop", F.col("_stop")).alias("stopped"))
