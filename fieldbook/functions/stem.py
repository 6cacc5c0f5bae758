"""Porter's stemmer for English words: five steps of suffix rules that look at a stem's measure.

M. F. Porter, An algorithm for suffix stripping, 1980, with the author's later
rules for -bli and -logi. A final y becomes i after a consonant that is not
the first letter, so that say and by stay. Before -ed and -ing only pairs of
DOUBLES lose a letter: pairs of digits or marks, as in a155ed, stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The published rules, suffix and what stands for it.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Letters of which a pair loses one: the consonants but l, s and z; y is none of them.
DOUBLES = frozenset("bcdfghjkmnpqrtvwx")


def kinds(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return kinds(word).count("vc")


def _ends_cvc(word: str) -> bool:
    return kinds(word).endswith("cvc") and word[-1] not in "wxy"


def _ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and word[-1] in DOUBLES


def _by_table(word: str, rules: dict[str, str], least: int) -> str:
    """The rule of the longest suffix, if what stands before has at least this measure."""
    ends = [end for end in rules if word.endswith(end)]
    if ends:
        end = max(ends, key=len)
        stem = word[: len(word) - len(end)]
        if measure(stem) >= least and (end != "ion" or stem.endswith(("s", "t"))):
            return stem + rules[end]
    return word


def _plurals(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _participles(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    for end in ("ed", "ing"):
        stem = word[: len(word) - len(end)]
        if word.endswith(end) and "v" in kinds(stem):
            if stem.endswith(("at", "bl", "iz")) or (measure(stem) == 1 and _ends_cvc(stem)):
                return stem + "e"
            return stem[:-1] if _ends_double(stem) else stem
    return word


def _final_e(word: str) -> str:
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stem_word(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = _participles(_plurals(word))
    if word.endswith("y") and len(word) > 2 and word[-2] not in "aeiou":
        word = word[:-1] + "i"
    word = _by_table(word, STEP_2, 1)
    word = _by_table(word, STEP_3, 1)
    return _final_e(_by_table(word, dict.fromkeys(STEP_4, ""), 2))


@F.pandas_udf(StringType())
def stemmed(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of words; run it over distinct terms."""
    for batch in words:
        yield batch.map(stem_word)


def stem_sql(word: str) -> str:
    """The same as an SQL expression of regular expressions and nested subqueries over a column, for comparison."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    some, one, more = f"^({c})?{v}{c}", f"^({c})?{v}{c}({v})?$", f"^({c})?{v}{c}{v}{c}"
    vowel, cvc = f"^({c})?[aeiouy]", "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"

    def cut(n: int) -> str:
        return f"left(w, length(w) - {n})"

    def table(rules: dict[str, str], pattern: str) -> str:
        cases = ""
        for end in sorted(rules, key=len, reverse=True):
            ok = f"regexp_matches({cut(len(end))}, '{pattern}')" + (f" AND regexp_matches({cut(3)}, '[st]$')" if end == "ion" else "")
            cases += f" WHEN ends_with(w, '{end}') THEN CASE WHEN {ok} THEN {cut(len(end))} || '{rules[end]}' ELSE w END"
        return f"CASE{cases} ELSE w END"

    def after(n: int) -> str:
        s = cut(n)
        double = f"regexp_matches({s}, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$')"
        return f"CASE WHEN regexp_matches({s}, '(at|bl|iz)$') OR (regexp_matches({s}, '{one}') AND regexp_matches({s}, '{cvc}')) THEN {s} || 'e' WHEN {double} THEN {cut(n + 1)} ELSE {s} END"

    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches({cut(3)}, '{some}') THEN {cut(1)} ELSE w END WHEN ends_with(w, 'ed') AND regexp_matches({cut(2)}, '{vowel}') THEN {after(2)} WHEN ends_with(w, 'ing') AND regexp_matches({cut(3)}, '{vowel}') THEN {after(3)} ELSE w END",
        f"CASE WHEN regexp_matches(w, '.[^aeiou]y$') THEN {cut(1)} || 'i' ELSE w END",
        table(STEP_2, some),
        table(STEP_3, some),
        table(dict.fromkeys(STEP_4, ""), more),
        f"CASE WHEN ends_with(w, 'e') AND (regexp_matches({cut(1)}, '{more}') OR (regexp_matches({cut(1)}, '{one}') AND NOT regexp_matches({cut(1)}, '{cvc}'))) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{more}') THEN {cut(1)} ELSE w END",
    ]
    inner = f"SELECT {word} AS t, regexp_replace({word}, '^y', 'Y') AS w"
    for s in steps:
        inner = f"SELECT t, {s} AS w FROM ({inner})"
    return f"(SELECT CASE WHEN length(t) < 3 THEN t ELSE regexp_replace(w, '^Y', 'y') END FROM ({inner}))"
