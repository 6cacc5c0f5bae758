"""What a block of an entry shows: search text, Markdown and HTML, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldbook.functions.text import escape_html, escape_markdown, heading_marks, heading_tag, quoted


def search_text(b: Column) -> Column:
    """The words of a block that search finds."""
    return (
        F.when(b["type"].isin("heading", "paragraph", "quote"), b["text"])
        .when(b["type"] == "table", F.array_join(F.flatten(b["data"]), " "))
        .when(b["type"] == "checklist", F.array_join(F.transform(b["items"], lambda i: i["text"]), " "))
        .when(b["type"] == "image", F.coalesce(b["caption"], F.lit("")))
        .when(b["type"] == "file", F.coalesce(b["label"], F.lit("")))
        .otherwise("")
    )


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_table(data: Column, header_row: Column) -> Column:
    """A table with a header: its first row, or Col 1, Col 2... as wide as that; rows may be ragged."""
    own = F.coalesce(header_row, F.lit(True))
    first = F.get(data, F.lit(0))
    head = F.when(own, F.transform(first, escape_markdown)).otherwise(F.transform(first, lambda c, i: F.concat(F.lit("Col "), (i + 1).cast("string"))))
    body = F.when(own, F.slice(data, F.lit(2), F.greatest(F.lit(0), F.size(data) - 1))).otherwise(data)
    lines = F.concat(F.array(_row(head), _row(F.transform(first, lambda c: F.lit("---")))), F.transform(body, lambda r: _row(F.transform(r, escape_markdown))))
    return F.when(F.coalesce(F.size(data), F.lit(0)) == 0, "").otherwise(F.array_join(lines, "\n"))


def html_table(data: Column, header_row: Column) -> Column:
    own = F.coalesce(header_row, F.lit(True))

    def cells(row: Column, tag: str) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    head = F.when(own, F.concat(F.lit("<thead>"), cells(F.get(data, F.lit(0)), "th"), F.lit("</thead>"))).otherwise("")
    body = F.when(own, F.slice(data, F.lit(2), F.greatest(F.lit(0), F.size(data) - 1))).otherwise(data)
    rows = F.array_join(F.transform(body, lambda r: cells(r, "td")), "")
    return F.when(F.coalesce(F.size(data), F.lit(0)) == 0, "").otherwise(F.concat(F.lit("<table>"), head, F.lit("<tbody>"), rows, F.lit("</tbody></table>")))


def markdown(b: Column, filename: Column, path: Column) -> Column:
    """A block's Markdown; filename and path are its attachment's, null where it is missing."""
    items = F.transform(b["items"], lambda i: F.concat(F.lit("- ["), F.when(F.coalesce(i["done"], F.lit(False)), "x").otherwise(" "), F.lit("] "), escape_markdown(i["text"])))
    image = escape_markdown(F.coalesce(b["caption"], filename, F.lit("image")))
    label = escape_markdown(F.coalesce(b["label"], filename, F.lit("file")))
    there = F.nullif(path, F.lit(""))
    caption = F.when(F.coalesce(b["caption"], F.lit("")) != "", F.concat(F.lit("\n*"), escape_markdown(b["caption"]), F.lit("*"))).otherwise("")
    return (
        F.when(b["type"] == "heading", F.concat(heading_marks(b["level"]), F.lit(" "), escape_markdown(b["text"])))
        .when(b["type"] == "paragraph", b["text"])
        .when(b["type"] == "quote", quoted(b["text"]))
        .when(b["type"] == "divider", "---")
        .when(b["type"] == "checklist", F.array_join(items, "\n"))
        .when(b["type"] == "table", F.concat(markdown_table(b["data"], b["header_row"]), caption))
        .when(b["type"] == "image", F.concat(F.lit("!["), image, F.lit("]("), F.coalesce(there, F.lit("missing")), F.lit(")")))
        .when(b["type"] == "file", F.when(there.isNotNull(), F.concat(F.lit("["), label, F.lit("]("), there, F.lit(")"))).otherwise(F.concat(label, F.lit(" (missing)"))))
    )


def html(b: Column, filename: Column, path: Column, source: Column) -> Column:
    """A block's HTML; source is what an image is shown from."""
    items = F.transform(b["items"], lambda i: F.concat(F.lit('<li><span class="cb">'), F.when(F.coalesce(i["done"], F.lit(False)), "☑").otherwise("☐"), F.lit("</span> "), escape_html(i["text"]), F.lit("</li>")))
    tag = heading_tag(F.coalesce(b["level"], F.lit(2)))
    caption = escape_html(F.coalesce(b["caption"], filename, F.lit("Image")))
    picture = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit('<img src="'), escape_html(source), F.lit('" alt="'), caption, F.lit('" />'))).otherwise('<div class="placeholder">Image</div>')
    under = F.when(F.coalesce(b["caption"], F.lit("")) != "", F.concat(F.lit('<div class="caption">'), escape_html(b["caption"]), F.lit("</div>"))).otherwise("")
    where = F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit('<div class="muted">'), escape_html(path), F.lit("</div>"))).otherwise("")
    return (
        F.when(b["type"] == "heading", F.concat(F.lit("<"), tag, F.lit(">"), escape_html(b["text"]), F.lit("</"), tag, F.lit(">")))
        .when(b["type"] == "paragraph", F.concat(F.lit("<p>"), escape_html(b["text"]), F.lit("</p>")))
        .when(b["type"] == "quote", F.concat(F.lit("<blockquote>"), escape_html(b["text"]), F.lit("</blockquote>")))
        .when(b["type"] == "divider", "<hr />")
        .when(b["type"] == "checklist", F.concat(F.lit('<ul class="checklist">'), F.array_join(items, ""), F.lit("</ul>")))
        .when(b["type"] == "table", F.concat(F.lit('<div class="table-wrap">'), html_table(b["data"], b["header_row"]), under, F.lit("</div>")))
        .when(b["type"] == "image", F.concat(F.lit("<figure>"), picture, F.lit("<figcaption>"), caption, F.lit("</figcaption></figure>")))
        .when(b["type"] == "file", F.concat(F.lit('<div class="file"><strong>'), escape_html(F.coalesce(b["label"], filename, F.lit("File"))), F.lit("</strong>"), where, F.lit("</div>")))
        .otherwise("")
    )
