"""Fill-in-the-middle rearrangement of documents, and its inverse.

A text is an array of code points. Four numbers from a hash of its id say
where it is cut in prefix, middle and suffix, whether it stays plain, and which
of two arrangements it gets. Sentinels tell the parts apart, so the text can
be read back from the output alone. Only DataFrame expressions are used, in
the scan's own tasks; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 texts so many are rearranged, and of 100 rearranged ones so many get the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20


def draws(key: Column, seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers: the first groups of 8 digits of the sha256 of `seed:key`; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*map(F.lit, (1, 9, 17, 25))), lambda at: F.conv(F.substring(digest, at, F.lit(8)), 16, 10).cast("long"))


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if no part that is free of them can form one where it meets another."""
    for a in sentinels:
        for k, b in enumerate(sentinels):
            if not a or (a != b and b in a) or sentinels.index(b) != k or any(b.startswith(a[n:]) for n in range(1, len(a))):
                raise ValueError(f"sentinels must be different and must not overlap: {sentinels}")
    return sentinels


def rearrange(docs: DataFrame, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output.

    n is the text's code points. A text is plain, and its output the text
    itself, if it is empty or holds a sentinel, or if it is drawn so; else
    form is psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each
    part after its sentinel. Lengths are null where the form is plain. A null
    text counts as empty, a null doc_id as an empty one; rows of one doc_id
    and n are cut alike. Long texts are cut whole. Columns of docs that are
    named like the added ones are replaced; others stay. An empty table gives
    an empty one.
    """
    before_p, before_s, before_m = (F.lit(s) for s in checked(sentinels))
    rows = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    # Whole rows in one column keep clear of names that docs may have.
    units = rows.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("whole"), draws(F.col("doc_id"), seed).alias("h"))
    units = units.withColumn("units", F.regexp_extract_all("whole", F.lit("(?s)."), F.lit(0)))
    cut = [F.pmod(F.get("h", F.lit(k)), F.size("units") + 1).cast("int") for k in (0, 1)]
    holds = F.contains("whole", before_p) | F.contains("whole", before_s) | F.contains("whole", before_m)
    plain = (F.size("units") == 0) | holds | (F.get("h", F.lit(2)) % 100 >= rearranged)
    form = F.when(plain, PLAIN).when(F.get("h", F.lit(3)) % 100 < suffix_first, SPM).otherwise(PSM)
    placed = units.withColumns({"a": F.least(*cut), "b": F.greatest(*cut), "form": form})

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("units", start + 1, length), "")

    prefix, middle = part(F.lit(0), F.col("a")), part(F.col("a"), F.col("b") - F.col("a"))
    suffix = part(F.col("b"), F.size("units") - F.col("b"))
    psm, spm = F.concat(before_p, prefix, before_s, suffix, before_m, middle), F.concat(before_s, suffix, before_p, prefix, before_m, middle)
    output = F.when(F.col("form") == PLAIN, F.col("whole")).when(F.col("form") == PSM, psm).otherwise(spm)
    changed = F.col("form") != PLAIN
    lengths = [F.when(changed, F.col("a").cast("long")).alias("prefix_chars"), F.when(changed, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars")]
    return placed.select("row.*", F.size("units").cast("long").alias("n"), "form", *lengths, output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, "|".join(re.escape(s) for s in checked(sentinels)), -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == PSM, F.concat(first, middle, second)).when(form == SPM, F.concat(second, middle, first)).otherwise(output)
