"""List, tag and table functions, as column expressions over arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Types of marked text and of a checklist's items.
RUNS = "array<struct<text:string,bold:boolean,italic:boolean,underline:boolean>>"
ITEMS = f"array<struct<id:string,text:string,done:boolean,timer_minutes:int,runs:{RUNS}>>"


def listed(values: Column, kind: str = "array<string>") -> Column:
    """values, or an empty array for null."""
    return F.coalesce(values, F.array().cast(kind))


def has_all(values: Column, wanted: list[str]) -> Column:
    """Whether all wanted values are there; nothing wanted always fits, a null array fits nothing else."""
    if not wanted:
        return F.lit(True)
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), listed(values))) == 0


def toggled(values: Column, value: Column) -> Column:
    """Without value if it is there, else with it at the end."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, value))


def added_once(values: Column, value: Column) -> Column:
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def united(values: Column, more: Column) -> Column:
    """Distinct values of both, in the order first seen."""
    return F.array_union(listed(values), listed(more))


def opened(tabs: Column, tab: Column, most: int = 5) -> Column:
    """Recent tabs with this one in front, at most so many; an open tab does not move."""
    return F.when(F.array_contains(tabs, tab), tabs).otherwise(F.slice(F.array_prepend(tabs, tab), 1, most))


def closed(tabs: Column, tab: Column) -> Column:
    """Tabs without this one; the last one stays."""
    return F.when(F.size(tabs) > 1, F.array_remove(tabs, tab)).otherwise(tabs)


def display_tag(experiment_tags: Column, project_tags: Column, tags: Column) -> Column:
    """The first of three lists' first tags, else 'Draft'."""
    first = [F.nullif(F.get(listed(x), F.lit(0)), F.lit("")) for x in (experiment_tags, project_tags, tags)]
    return F.coalesce(*first, F.lit("Draft"))


def last_wins(entries: Column) -> Column:
    """A map from an array of (key, value) structs; the last of equal keys stays, at the first one's place."""
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))
    last = F.filter(placed, lambda e, i: ~e["key"].eqNullSafe(F.get(placed, i + 1)["key"]))
    first = F.filter(placed, lambda e, i: (i == 0) | ~e["key"].eqNullSafe(F.get(placed, i - 1)["key"]))
    both = F.array_sort(F.zip_with(first, last, lambda a, b: F.struct(a["i"].alias("i"), b["key"].alias("key"), b["value"].alias("value"))))
    return F.map_from_entries(F.transform(both, lambda e: F.struct(e["key"], e["value"])))


def widest(data: Column) -> Column:
    """The most cells of a row, one at least."""
    return F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(data, lambda r: F.size(r))), F.lit(1)))


def with_row(data: Column) -> Column:
    return F.array_append(data, F.array_repeat(F.lit(""), widest(data)))


def with_column(data: Column) -> Column:
    return F.transform(data, lambda r: F.array_append(r, F.lit("")))


def toggled_header(header_row: Column) -> Column:
    """The other state of a table's header row; one that was never set is on."""
    return ~F.coalesce(header_row, F.lit(True))


def with_cell(data: Column, row: int, column: int, value: Column) -> Column:
    return F.transform(data, lambda r, i: F.when(i == row, F.transform(r, lambda v, j: F.when(j == column, value).otherwise(v))).otherwise(r))


def inserted(values: Column, after: Column, new: Column) -> Column:
    """new after the first `after` values; a null place means at the end."""
    at = F.coalesce(after, F.size(values))
    return F.concat(F.slice(values, F.lit(1), at), new, F.slice(values, at + 1, F.greatest(F.lit(0), F.size(values) - at)))


def done_set(items: Column, item_id: Column, done: Column) -> Column:
    """Checklist items, with one item's state set."""
    return F.transform(items, lambda i: F.when(i["id"] == item_id, i.withField("done", done)).otherwise(i))


def checked_items(items: Column) -> Column:
    """A checklist (ITEMS) that is never empty, whose items have ids by place and a state."""
    rest = (F.lit(None).cast("int").alias("timer_minutes"), F.lit(None).cast(RUNS).alias("runs"))
    blank = F.array(F.struct(F.lit("item-1").alias("id"), F.lit("").alias("text"), F.lit(False).alias("done"), *rest))
    own = F.transform(items, lambda i, n: F.struct(F.coalesce(i["id"], F.concat(F.lit("item-"), (n + 1).cast("string"))).alias("id"), F.coalesce(i["text"], F.lit("")).alias("text"), F.coalesce(i["done"], F.lit(False)).alias("done"), i["timer_minutes"].alias("timer_minutes"), i["runs"].alias("runs")))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, own).otherwise(blank)


def split_item(items: Column, item_id: Column, at: Column, new_id: Column) -> Column:
    """One item cut in two at a place of its text; the new item is not done."""

    def cut(i: Column) -> Column:
        head = i.withField("text", F.substr(i["text"], F.lit(1), at))
        tail = i.withField("id", new_id).withField("text", F.substr(i["text"], at + 1)).withField("done", F.lit(False))
        return F.when(i["id"] == item_id, F.array(head, tail)).otherwise(F.array(i))

    return F.flatten(F.transform(items, cut))


def without_blank_item(items: Column, item_id: Column) -> Column:
    """Items without a blank one; null if it was the only one, when the checklist turns into a paragraph."""
    left = F.filter(items, lambda i: ~((i["id"] == item_id) & (F.trim(i["text"]) == "")))
    return F.when(F.size(left) > 0, left)
