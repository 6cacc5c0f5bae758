"""Mixing sources to target weights: iterative proportional fitting, then sampling.

The tokens of all documents are counted for each cell (a source, a language
and a topic). The cells' weights are raked until the sums by source, by
language and by topic all have their target shares. No weight passes what its
cell holds, or its documents' chances would be cut at 1 and the shares missed:
a full cell stays full while the others make up for it, and where a whole
source, language or topic holds too little, all weights are smaller. A
document's chance is its cell's weight over its cell's tokens, and a hash of
its id draws it. Only DataFrame expressions are used.
"""

from __future__ import annotations

import warnings
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import Scratch, dealt_join, let

#: Stands for a null source, language or topic.
NONE = "(none)"
#: Raking ends when no factor moves by a larger share of itself in a round.
TOLERANCE = 1e-10
#: Rounds in one expression, after which a check tells whether more are needed.
ROUNDS = 50
#: Rounds after which targets count as impossible: cells without tokens keep some sums apart.
GIVE_UP = 2000
#: Of the largest share of all tokens that a mix could have for its scarcest value, so much is asked for; and again so much of that while the targets are missed.
SLACK, LESS = 0.95, 0.8
#: Targets are reached if no value's share is off by more than this part of it.
REACHED = 1e-3
#: Cells that are raked in one row.
FEW_CELLS = 20_000
SEED = 23


def tokens_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def unit_hash(key: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) from the md5 of a seed and a key; a null key counts as empty."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def tempered(cells: DataFrame, name: str, power: float) -> DataFrame:
    """(value, share): shares in proportion to a power of each value's tokens, not scaled."""
    return cells.groupBy(F.col(name).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share")).where("share > 0")


def goals_of(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch) -> DataFrame:
    """(dimension, value, goal): the tokens that each value with tokens should have, of all tokens."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    parts = []
    for name, target in targets.items():
        live = cells.where("tokens > 0").select(F.col(name).alias("value")).distinct()
        parts.append(target.join(live, "value", "left_semi").select(F.lit(name).alias("dimension"), "value", "share"))
    shares = scratch.save("shares", reduce(DataFrame.unionByName, parts))
    whole = {r[0]: r[1] for r in shares.groupBy("dimension").agg(F.sum("share")).collect()}  # a number for each dimension
    scale = reduce(lambda c, n: c.when(F.col("dimension") == n, total / whole[n]), [n for n in whole if whole[n]], F.when(F.lit(False), 0.0))
    return scratch.save("goals", shares.select("dimension", "value", (F.col("share") * F.coalesce(scale, F.lit(0.0))).alias("goal")))


def stepped(goal: Column, full: Column, free: Column, whole: Column) -> Column:
    """What a value's factor is multiplied by, from its cells' weights: of the full ones (cut), of the others, and of all uncut.

    The others are to make up what the full ones leave, a Newton step of an
    increasing concave function, which goes on from below. If all cells are
    full, nothing more can be had.
    """
    return F.when((goal > full) & (free > 0), (goal - full) / free).when((goal >= full) | (whole <= 0), 1.0).otherwise(goal / whole)


def factors_in_one_row(cells: DataFrame, names: list[str], goals: DataFrame, budget: float, scratch: Scratch) -> DataFrame:
    """(dimension, value, factor) for few cells: they fit in one row, and ROUNDS rounds in one expression, which goes on from where the last one stopped."""
    listed = goals.agg(F.array_sort(F.collect_list(F.struct("dimension", "value", "goal"))).alias("all"))
    values = scratch.save("values", listed.select(F.posexplode("all").alias("at", "v")).select("at", "v.*"))
    placed = cells.where("tokens > 0")
    for k, name in enumerate(names):
        placed = placed.join(values.where(F.col("dimension") == name).select(F.col("value").alias(name), F.col("at").alias(f"at_{k}")), name)
    placed = scratch.save("placed", placed.select(F.col("tokens").cast("double").alias("tokens"), F.array(*[f"at_{k}" for k in range(len(names))]).alias("places")))
    own = placed.select(F.explode("places").alias("at"), F.struct("tokens", "places").alias("cell")).groupBy("at").agg(F.collect_list("cell").alias("cells"))
    row = values.join(own, "at").agg(F.array_sort(F.collect_list(F.struct("at", "dimension", "goal", "cells"))).alias("groups"))

    def raked(k: int, factors: Column) -> Column:
        """The factors after one dimension's sums are made right."""

        def new(g: Column) -> Column:
            grown = lambda c: reduce(Column.__mul__, [F.get(factors, F.get(c["places"], F.lit(e))) for e in range(len(names))])

            def add(a: Column, c: Column) -> Column:
                def with_factor(f: Column) -> Column:
                    full = f * budget >= 1
                    return F.struct(
                        (a["full"] + F.when(full, c["tokens"] / budget).otherwise(0.0)).alias("full"), (a["free"] + F.when(full, 0.0).otherwise(c["tokens"] * f)).alias("free"), (a["whole"] + c["tokens"] * f).alias("whole")
                    )

                return let(grown(c), with_factor)

            have = F.aggregate(g["cells"], F.struct(*[F.lit(0.0).alias(n) for n in ("full", "free", "whole")]), add)
            return let(have, lambda h: F.get(factors, g["at"]) * stepped(g["goal"], h["full"], h["free"], h["whole"]))

        return F.transform("groups", lambda g: F.when(g["dimension"] == names[k], new(g)).otherwise(F.get(factors, g["at"])))

    def one_round(factors: Column) -> Column:
        for k in range(len(names)):
            factors = let(factors, partial(raked, k))
        return factors

    def further(state: Column, _: Column) -> Column:
        """The state after one more round, if the last one still moved."""

        def moved(new: Column) -> Column:
            shares = F.zip_with(state["factors"], new, lambda old, now: F.abs(now - old) / F.greatest(now, F.lit(1e-300)))
            return F.struct(new.alias("factors"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("moved"), (state["rounds"] + 1).alias("rounds"))

        return F.when(state["moved"] <= TOLERANCE, state).otherwise(let(one_round(state["factors"]), moved))

    start = F.struct(F.transform("groups", lambda g: F.lit(1.0)).alias("factors"), F.lit(1.0).cast("double").alias("moved"), F.lit(0).alias("rounds"))
    row = scratch.save("state-0", row.withColumn("state", start))
    k = 0
    while True:
        k += 1
        row = scratch.save(f"state-{k}", row.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col("state"), further)))
        scratch.drop(f"state-{k - 1}")
        if done(*row.select("state.moved", "state.rounds").first()):
            break
    found = row.select(F.posexplode("state.factors").alias("at", "factor"))
    return found.join(values, "at").select("dimension", "value", "factor")


def done(moved: float | None, rounds: int) -> bool:
    """Whether raking ends here; a warning tells if the targets were not reached."""
    if moved is None or moved <= TOLERANCE:
        return True
    if rounds >= GIVE_UP:
        warnings.warn(f"no weights have all target shares: after {rounds} rounds a factor still moves by {moved:.1e} of itself", stacklevel=2)
        return True
    return False


def factors_by_rounds(cells: DataFrame, names: list[str], goals: DataFrame, budget: float, scratch: Scratch) -> DataFrame:
    """The same for any number of cells: a round is a few aggregations."""
    at = scratch.save("factors-0", goals.select("dimension", "value", F.lit(1.0).alias("factor")))
    k = 0
    while True:
        before = at
        for d, name in enumerate(names):
            weights = weighted(cells.where("tokens > 0"), names, at)
            full = F.col("weight") * budget >= F.col("tokens")
            sums = weights.groupBy(F.col(name).alias("value")).agg(F.sum(F.when(full, F.col("tokens") / budget).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum("weight").alias("whole"))
            old = at.where(F.col("dimension") == name).select("value", "factor")
            new = goals.where(F.col("dimension") == name).join(sums, "value").join(old, "value")
            new = new.select("dimension", "value", (F.col("factor") * stepped(*map(F.col, ("goal", "full", "free", "whole")))).alias("factor"))
            at = scratch.save(f"factors-{k + 1}-{d}", at.where(F.col("dimension") != name).unionByName(new))
        old = before.withColumnRenamed("factor", "old")
        moved = at.join(old, ["dimension", "value"]).agg(F.max(F.abs(F.col("factor") - F.col("old")) / F.greatest(F.col("factor"), F.lit(1e-300)))).first()[0]
        scratch.drop(*[f"factors-{k}" if k == 0 else f"factors-{k}-{d}" for d in range(len(names))])
        k += 1
        if done(moved, k):
            return at


def weighted(cells: DataFrame, names: list[str], factors: DataFrame) -> DataFrame:
    """cells with the product of their tokens and factors as weight."""
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for name in names:
        own = factors.where(F.col("dimension") == name).select(F.col("value").alias(name), "factor")
        out = out.join(own, name, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
    return out


def shares(cells: DataFrame, goals: DataFrame, names: list[str]) -> DataFrame:
    """(dimension, value, goal, got): what weights each value should have, and has."""
    sums = [cells.groupBy(F.col(n).alias("value")).agg(F.sum("weight").alias("got")).select(F.lit(n).alias("dimension"), "value", "got") for n in names]
    return goals.join(reduce(DataFrame.unionByName, sums), ["dimension", "value"], "left").withColumn("got", F.coalesce("got", F.lit(0.0)))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, budget: float = 1.0) -> DataFrame:
    """cells (values, tokens) with a weight and the budget; the weights' sums by each value have its target share of all tokens.

    No weight times the budget is more than its cell's tokens. The budget is
    the one asked for, or less where a value has too few tokens for its share
    of that, and again less while shares are missed. Shares of values without
    tokens are spread over the others in proportion. A value without a target
    gets weight 0. Rounds go on until no factor moves by more than TOLERANCE;
    where cells without tokens make the targets impossible, they end after
    GIVE_UP rounds with a warning, and the last dimension alone has its
    shares.
    """
    names = list(targets)
    goals = goals_of(cells, targets, scratch)
    rounds = factors_in_one_row if cells.count() <= FEW_CELLS else factors_by_rounds
    held = shares(cells.withColumn("weight", F.col("tokens")), goals, names)
    scarcest = held.where("goal > 0").agg(F.min(F.col("got") / F.col("goal"))).first()[0]
    budget = min(budget, 1.0)
    if scarcest is not None and scarcest < 1 - 1e-9:  # else the shares are those there are
        budget = min(budget, scarcest * SLACK)
    k = 0
    while True:
        factors = scratch.save(f"factors-of-{k}", rounds(cells, names, goals, budget, scratch))
        cut = F.least(F.col("weight"), F.col("tokens") / budget)
        out = scratch.save(f"weights-{k}", weighted(cells, names, factors).withColumn("full", F.col("weight") > cut).withColumn("weight", cut))
        off, full = shares(out, goals, names).agg(F.max(F.abs(F.col("got") / F.col("goal") - 1))).first()[0], out.where("full").take(1)
        if not full or off is None or off <= REACHED:
            return out.drop("full").withColumn("budget", F.lit(budget))
        budget, k = budget * LESS, k + 1


def mix(docs: DataFrame, dimensions: dict[str, Column], targets: dict[str, DataFrame] | None = None, power: float = 0.7, budget: float = 1.0, tokens: Column | None = None) -> DataFrame:
    """docs with tokens, cell_weight, probability and sampled.

    dimensions: name -> expression over docs; targets: name -> (value, share),
    or shares in proportion to a power of the tokens there are; tokens: an
    expression over docs, by default the words of text. probability is
    budget * cell_weight / the cell's tokens, never over 1. budget is the part
    of all tokens that is asked for; it becomes less where targets ask for
    more of a value than there is. Documents of cells without tokens have
    probability 1. A null is a value of its own, '(none)'. Rows of equal
    doc_id are drawn alike. Columns of docs that are named like the added ones
    are replaced; others stay. An empty table gives an empty one.
    """
    added = ("tokens", "cell_weight", "probability", "sampled")
    docs = docs.drop(*added)
    scratch = Scratch(docs.sparkSession, "mixing")
    names = list(dimensions)
    keys = [F.coalesce(dimensions[n].cast("string"), F.lit(NONE)).alias(f"_{n}") for n in names]
    held = [f"_{n}" for n in names]
    # Whole rows in one column keep clear of names that docs may have.
    counted = docs.select(F.struct("*").alias("row"), *keys, (tokens_of(F.col("text")) if tokens is None else tokens).alias("tokens"))
    cells = scratch.save("cells", counted.groupBy(*held).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("_rows")))
    goals = {f"_{n}": (targets or {}).get(n) or tempered(cells, f"_{n}", power) for n in names}
    raked = scratch.save("raked", rake(cells, goals, scratch, budget).withColumnsRenamed({"tokens": "_all", "weight": "cell_weight", "budget": "_budget"}))
    joined = dealt_join(counted, raked, held, F.xxhash64("row.doc_id"), n="_rows")
    chance = F.when(F.col("_all") > 0, F.least(F.lit(1.0), F.col("_budget") * F.col("cell_weight") / F.col("_all"))).otherwise(1.0)
    out = joined.withColumn("probability", chance).withColumn("sampled", unit_hash("row.doc_id") < F.col("probability"))
    return out.select("row.*", *added)


def with_topic(docs: DataFrame, embeddings: DataFrame, name: str = "topic") -> DataFrame:
    """docs with a topic: the label of the vector whose vec_id is the doc_id (of several, the least), null without one."""
    topics = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("vec_id").alias("_vec")).agg(F.min("label").cast("string").alias(name))
    rows = docs.drop(name).select(F.struct("*").alias("row"))
    topics = Scratch(docs.sparkSession, "topics").save("topics", topics)
    return rows.join(topics, F.col("row.doc_id") == F.col("_vec"), "left").select("row.*", name)


def raking_sql(names: list[str], power: float, rounds: int, budget: float) -> str:
    """The raking as SQL: common table expressions from cells (values, tokens) to raked (values, tokens, weight, budget), for targets that are reached at the first budget."""
    ctes = ["total AS (SELECT sum(tokens) AS t FROM cells)"]
    ctes += [f"goal_{n} AS (SELECT {n}, t * pow(sum(tokens)::DOUBLE, {power}) / sum(pow(sum(tokens)::DOUBLE, {power})) OVER () AS goal, sum(tokens) AS have FROM cells, total GROUP BY {n}, t HAVING sum(tokens) > 0)" for n in names]
    scarcest = " UNION ALL ".join(f"SELECT have / goal AS x FROM goal_{n}" for n in names)
    ctes.append(f"asked AS (SELECT least({budget}, CASE WHEN min(x) < 1 - 1e-9 THEN {SLACK} * min(x) ELSE 1 END) AS budget FROM ({scarcest}))")
    before = "(SELECT *, tokens::DOUBLE AS u FROM cells)"
    for k in range(rounds):
        for n in names:
            step = f"r{k}_{n}"
            over = f"OVER (PARTITION BY c.{n})"
            sums = f"sum(CASE WHEN u * budget >= tokens THEN tokens / budget ELSE 0 END) {over} AS lim, sum(CASE WHEN u * budget >= tokens THEN 0 ELSE u END) {over} AS free, sum(u) {over} AS whole"
            factor = "CASE WHEN goal > lim AND free > 0 THEN (goal - lim) / free WHEN goal >= lim OR whole <= 0 THEN 1 ELSE goal / whole END"
            ctes.append(f"{step} AS MATERIALIZED (SELECT * EXCLUDE (goal, lim, free, whole, u), coalesce(u * {factor}, 0) AS u FROM (SELECT c.* EXCLUDE (budget), budget, goal, {sums} FROM (SELECT * FROM {before}, asked) c LEFT JOIN goal_{n} g ON c.{n} = g.{n}))")
            before = f"(SELECT * EXCLUDE (budget) FROM {step})"
    ctes.append(f"raked AS (SELECT * EXCLUDE (u), least(u, tokens / budget) AS weight FROM {before}, asked)")
    return reduce(lambda a, b: f"{a},\n    {b}", ctes)
