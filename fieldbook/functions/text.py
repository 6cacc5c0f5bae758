"""Text, number and date functions of the notebook, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space and the byte order mark, as scripts in browsers trim it.
_SPACE = r"[\s\x{FEFF}]"


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def tidy(text: Column) -> Column:
    """A tag or title: trimmed, with one space for each run of white space."""
    return F.regexp_replace(trimmed(text), f"(?U){_SPACE}+", " ")


def title_key(title: Column) -> Column:
    """What titles are matched by."""
    return F.lower(tidy(title))


def filled(text: Column, *others: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (text, *others)])


def safe_file_name(name: Column) -> Column:
    """A name of letters, digits and ._()- alone, or 'export'."""
    marks = F.regexp_replace(trimmed(name), r'[\\/:*?"<>|]+', "_")
    spaces = F.regexp_replace(F.regexp_replace(tidy(marks), r"[^a-zA-Z0-9 ._()-]+", "_"), " +", "_")
    return filled(F.regexp_replace(spaces, "^_+|_+$", ""), F.lit("export"))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


#: Fixed values, in the order in which they are replaced.
MARKDOWN = [("\\", "\\\\"), ("`", "\\`"), ("*", "\\*"), ("_", "\\_")]
HTML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def escape_markdown(text: Column) -> Column:
    return _replaced(text, MARKDOWN)


def escape_html(text: Column) -> Column:
    return _replaced(text, HTML)


def heading_marks(level: Column) -> Column:
    """One to six #, two without a level."""
    return F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(2)))))


def heading_tag(level: Column) -> Column:
    return F.when(level <= 1, "h1").when(level == 3, "h3").otherwise("h2")


def quoted(text: Column) -> Column:
    """Each line with the mark of a quotation."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n")


def basename(path: Column, label: Column | None = None) -> Column:
    """The last part of a path with / or \\, else the label, else 'file'."""
    parts = F.filter(F.split(trimmed(path), r"[\\/]"), lambda x: x != "")
    found = F.try_element_at(parts, F.lit(-1))
    named = F.coalesce(found, label, F.lit("file")) if label is not None else F.coalesce(found, F.lit("file"))
    return filled(trimmed(named), F.lit("file"))


def has_scheme(path: Column, scheme: str) -> Column:
    return F.coalesce(F.startswith(path, F.lit(f"{scheme}://")), F.lit(False))


def without_scheme(path: Column, scheme: str) -> Column:
    return F.when(has_scheme(path, scheme), F.substring(path, len(scheme) + 4, 1 << 30)).otherwise(path)


def plural(noun: str, n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def attachment_type(mime: Column) -> Column:
    """image, pdf or file."""
    return F.when(F.startswith(mime, F.lit("image")), "image").when(mime == "application/pdf", "pdf").otherwise("file")


def size_label(n_bytes: Column) -> Column:
    """Whole kilobytes, one at least."""
    return F.concat(F.greatest(F.lit(1).cast("long"), F.round(n_bytes / 1024).cast("long")).cast("string"), F.lit(" KB"))


def new_id(prefix: str) -> Column:
    """A random id; write it before it is used twice."""
    return F.concat(F.lit(prefix), F.uuid())


def table_from_clipboard(text: Column) -> Column:
    """Cells of text with tabs, as an array of rows; null unless a row has two cells."""
    rows = F.transform(F.split(trimmed(text), "\r?\n"), lambda r: F.split(r, "\t"))
    return F.when(F.exists(rows, lambda r: F.size(r) > 1), rows)


#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over UTF-16 code units, as an unsigned number."""
    code = F.hex(F.encode(text, "UTF-16BE"))
    places = F.when(F.length(code) > 0, F.sequence(F.lit(0), F.length(code) - 1, F.lit(4))).otherwise(F.array().cast("array<int>"))
    units = F.transform(places, lambda p: F.conv(F.substr(code, p + 1, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(units, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(0xFFFFFFFF))


def local_bucket(ts: Column) -> Column:
    """The date in the session's time zone."""
    return F.to_date(ts)


def utc_bucket(iso: Column) -> Column:
    """The date that an ISO text shows."""
    return F.substring(iso, 1, 10)


def iso_text(ts: Column) -> Column:
    """ISO text with milliseconds and Z, for a session in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def month_start(iso_month: Column) -> Column:
    """The first day of 'Y-M' or 'Y-M-D'; a month under 1 counts as January."""
    parts = F.split(iso_month, "-")
    month = F.greatest(F.lit(1), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(1)))
    return F.make_date(F.try_element_at(parts, F.lit(1)).try_cast("int"), month, F.lit(1))


def month_shift(month: Column, n: int) -> Column:
    return F.add_months(month, n)


def calendar_days(month: Column) -> Column:
    """The 42 days from the Monday on or before the month's start."""
    first = F.to_date(F.date_trunc("week", F.trunc(month, "MM")))
    return F.sequence(first, F.date_add(first, 41))


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def long_datetime(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy, hh:mm a")


def month_title(day: Column) -> Column:
    return F.date_format(day, "MMMM yyyy")
