"""URL filters: written rules, and association rules mined from labelled pages.

A URL is a set of tokens: its host's labels and the words of its path and
query. FP-growth finds the token sets that occur often among labelled pages;
those that are followed by a bad label with enough support and confidence are
rules, and rules that contain a shorter one are pruned. Tokens that stand on
the same labelled pages are one item, for a set that holds two of them says
no more than with one: a URL that is crawled again and again adds one item and
not each subset of its words. Items are counted first, and those that are
rules alone stay out of the longer sets. Each rule is indexed under its rarest
item, where a page's items look it up. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldbook.llm.common import Scratch, dealt_join

#: Bad labelled pages that a rule must hold for at least, however many pages there are.
MIN_PAGES = 5
MIN_CONFIDENCE = 0.5
BAD = "label:bad"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """h: the host's labels, p: the words of the path, q: those of what follows."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1), F.lit(""))

    def words(text: Column, mark: str) -> Column:
        found = F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda x: x != "")
        return F.transform(found, lambda x: F.concat(F.lit(mark), x))

    labels = F.transform(F.filter(F.split(host_of(url), "\\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    return F.array_distinct(F.concat(labels, words(path_of(url), "p:"), words(rest, "q:")))


def written_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest written rule that fits, else null.

    rules: ('host/path', verdict). A rule fits its host and all subdomains if
    the path starts with the rule's; of rules as long, the greatest string.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    parts = [(r, *r.partition("/")[::2], v) for r, v in rules]
    listed = F.array(*[F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(f"/{p}").alias("path")) for r, h, p, v in parts])
    fits = F.filter(listed, lambda r: ((host == r.host) | F.endswith(host, F.concat(F.lit("."), r.host))) & F.startswith(path, r.path))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best.rule.alias("rule"), best.verdict.alias("verdict")))


def mine(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, items), the item sets that block, each under its rarest item; and (token, item), the tokens of these items.

    pages: (page_id, url), labels: (doc_id, quality, toxic) for page ids. Bad
    is a page with quality 0 or toxic 1 in any of its label rows. An item is
    named by the least of its tokens; a URL has it if it has any of them, which
    is the same on labelled pages. Rules have any number of items and need
    MIN_PAGES bad pages (all pages, if fewer are labelled).
    """
    scratch = Scratch(pages.sparkSession, "url-rules")
    bad = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    known = pages.where("url IS NOT NULL").select("page_id", "url").distinct().join(bad, F.col("page_id") == F.col("doc_id"))
    tokens = tokens_of(F.col("url"))
    baskets = known.select(F.monotonically_increasing_id().alias("row"), tokens.alias("tokens"), "bad").where((F.size("tokens") > 0) | F.col("bad"))
    baskets = scratch.save("baskets", baskets)
    least = min(baskets.count(), MIN_PAGES)
    if not least:
        spark = pages.sparkSession
        return spark.createDataFrame([], "key string, items array<string>"), spark.createDataFrame([], "token string, item string")
    # No rule has a token of fewer bad pages. Equal sums of two hashes of the pages tell equal pages.
    each = baskets.select("row", "bad", F.explode("tokens").alias("token"))
    where = [F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(f"at_{k}") for k in (0, 1)]
    single = each.groupBy("token").agg(F.count("*").alias("freq"), F.count_if("bad").alias("both"), *where).where(F.col("both") >= least)
    same = Window.partitionBy("freq", "both", "at_0", "at_1")
    single = scratch.save("single", single.withColumn("item", F.min("token").over(same)).select("token", "item", "freq", "both"))
    # And no rule but itself has an item that is one alone.
    sure = F.col("both") >= MIN_CONFIDENCE * F.col("freq")
    alone = single.where(F.col("token") == F.col("item"))
    index = alone.where(sure).select(F.col("item").alias("key"), F.array("item").alias("items"))
    unsure = scratch.save("unsure", alone.where(~sure).select("token"))
    rest = each.join(unsure, "token").groupBy("row").agg(F.first("bad").alias("bad"), F.collect_list("token").alias("own")).where(F.size("own") > 1)
    rest = scratch.save("rest", rest.select("bad", F.when(F.col("bad"), F.array_append("own", F.lit(BAD))).otherwise(F.col("own")).alias("items")))
    n, n_bad = rest.agg(F.count("*"), F.count_if("bad")).first()
    if n_bad >= least:
        # Half a page less, so that rounding up the product gives `least` whatever the quotient's last bit.
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=MIN_CONFIDENCE).fit(rest)
        sets = scratch.save("sets", model.freqItemsets.where(F.size("items") > 1))
        with_bad = sets.where(F.array_contains("items", BAD)).select(F.array_sort(F.array_remove("items", BAD)).alias("items"), F.col("freq").alias("both"))
        plain = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("items"), "freq")
        rules = with_bad.join(plain, "items").where(sure).select("items")
        keyed = rules.select("items", F.explode("items").alias("item")).join(alone, "item").groupBy("items").agg(F.min(F.struct("freq", "item")).alias("rarest"))
        keyed = scratch.save("keyed", keyed.select(F.col("rarest.item").alias("key"), "items"))
        # A rule that holds a shorter rule, of any length, says nothing new.
        parts = keyed.select("key", F.col("items").alias("part"))
        holds = (F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0)
        pruned = keyed.select("items", F.explode("items").alias("key")).join(parts, "key").where(holds).select("items").distinct()
        index = index.unionByName(keyed.join(pruned, "items", "left_anti").select("key", "items"))
    index = scratch.save("index", index)
    used = index.select(F.explode("items").alias("item")).distinct()
    return index, scratch.save("names", single.join(used, "item", "left_semi").select("token", "item"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule and verdict ('allow' or 'block') of each page.

    A written rule decides where one fits; else a page is blocked if a mined
    rule's items are all among its own, and allowed if not. A null URL, or one
    without ://, has an empty host and path and no tokens. Repeated rows stay.
    Other columns are not read. Without labels nothing is mined.
    """
    pages = pages.select("page_id", "url")
    index, names = mine(pages, labels)
    scratch = Scratch(pages.sparkSession, "url-blocked")
    urls = pages.where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n"))
    held = urls.select("url", "n", F.explode(tokens_of(F.col("url"))).alias("token")).join(names, "token")
    own = held.groupBy("url").agg(F.max("n").alias("n"), F.collect_set("item").alias("own"))
    met = own.select("url", "n", "own", F.explode("own").alias("key")).join(index, "key").where(F.size(F.array_except("items", "own")) == 0)
    blocked = scratch.save("urls", met.select("url", "n").distinct().withColumn("mined", F.lit("block")))
    joined = dealt_join(pages, blocked, ["url"], F.xxhash64("page_id"), "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = joined.select("page_id", "url", host.alias("host"), path.alias("path"), "mined").withColumn("found", written_rule(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "mined", F.lit("allow")).alias("verdict"))
