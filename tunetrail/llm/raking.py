"""Mix sources to target weights: iterative proportional fitting, then sampling by the fitted rates.

One aggregate gives the tokens of every cell of source, language and topic. The cells are raked
until each margin has its target share, every category by itself: on the driver where they are few,
else as a table, with a sum and a join per dimension and round. Documents get the weight of their cell.

Where weights ask for more than all documents of a cell, sampling rates are raked again with the
bound 1 inside the loop: cells at 1 stay there and the free ones take up what is missing.
"""

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetrail.llm.shared import free_name, other_columns, quoted, stored

#: Categories of a dimension, and cells, up to which the driver rakes; tables with more are raked by Spark.
MOST = {"source": 256, "lang": 64, "topic": 64}
MOST_CELLS = 1 << 16
NONE = "(none)"
#: Factors grow no further: targets that contradict each other drive them apart.
MOST_FACTOR = 1e100
#: Longest texts by words, and the share of marks, that name the form of a text.
LONG, SHORT, MARKS = 1500, 120, 0.06


def words(text):
    """Number of words: runs without space bytes."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_form(text, n_words):
    """Topic of last resort, from the form of a text: tabular, long, short or article."""
    marks = F.coalesce(F.length(text) - F.length(F.translate(text, "|<>{}=;*#&%$", "")), F.lit(0))
    return (F.when(marks > MARKS * F.length(text), "tabular").when(n_words >= LONG, "long")
            .when(n_words < SHORT, "short").otherwise("article"))


def tempered(shares: dict[str, float], power: float) -> dict[str, float]:
    """Shares raised to a power and normalised: below 1 it lifts small categories."""
    raised = {k: v ** power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200,
         tolerance: float = 1e-9, start: np.ndarray | float = 1.0, bound: float = np.inf) -> list[np.ndarray]:
    """Factors of each dimension so that tokens weighted by min(bound, start * factors) meet every target share.

    A margin that is too large shrinks in proportion; one that is too small grows by what its cells
    below the bound must add. Stops when no margin is off by more than `tolerance`, when the largest
    miss stays as it is (targets that contradict each other), or after `rounds` rounds.
    """
    total = tokens.sum()
    factors, before = [np.ones(len(t)) for t in targets], np.inf
    for _ in range(rounds):
        off = 0.0
        for d, target in enumerate(targets):
            weight = start * np.prod([f[c] for f, c in zip(factors, codes)], axis=0)
            margin = np.bincount(codes[d], tokens * np.minimum(weight, bound), len(target)) / total
            free = np.bincount(codes[d], np.where(weight < bound, tokens * weight, 0), len(target)) / total
            miss = target - margin
            off = max(off, float(np.abs(miss).max()))
            by = 1 + np.divide(miss, np.where(miss > 0, free, margin), out=np.zeros_like(margin),
                               where=np.where(miss > 0, free, margin) > 0)
            factors[d] = np.minimum(factors[d] * np.where(margin > 0, by, 0), MOST_FACTOR)
        if off <= tolerance or abs(before - off) <= tolerance * 1e-3:
            break
        before = off
    return factors


def rate_scale(tokens: np.ndarray, weights: np.ndarray, rate: float) -> float:
    """Scale s with sum(tokens * min(1, s * weights)) = rate * sum(tokens), by bisection."""
    goal, low, high = rate * tokens.sum(), 0.0, 1.0
    if not goal or not (weights > 0).any():
        return 0.0
    while (tokens * np.minimum(1, high * weights)).sum() < min(goal, tokens[weights > 0].sum()) * (1 - 1e-12):
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        below = (tokens * np.minimum(1, middle * weights)).sum() < goal
        low, high = (middle, high) if below else (low, middle)
    return high


def rake_on_driver(cells: DataFrame, targets: dict | None, power: float, rate: float) -> DataFrame:
    """Cells with their weight and probability, from collected cells."""
    rows = cells.orderBy(*MOST).collect()
    tokens = np.array([r.tokens or 0 for r in rows], float)
    categories = {d: sorted({r[d] for r in rows}) for d in MOST}
    goals, codes = [], []
    for d in MOST:
        place = {c: k for k, c in enumerate(categories[d])}
        codes.append(np.array([place[r[d]] for r in rows], np.int64))
        margin = dict(zip(categories[d], np.bincount(codes[-1], tokens, len(place)).tolist()))
        goal = (targets or {}).get(d) or tempered(margin, power)
        present = {c: goal.get(c, 0.0) if margin[c] else 0.0 for c in categories[d]}
        total = sum(present.values()) or 1.0
        goals.append(np.array([present[c] / total for c in categories[d]]))
    factors = rake(tokens, codes, goals) if tokens.sum() else [np.zeros(len(g)) for g in goals]
    weights = np.prod([f[c] for f, c in zip(factors, codes)], axis=0) if rows else np.zeros(0)
    rates = weights * (rate_scale(tokens, weights, rate) if rows else 0.0)
    if (rates > 1).any():
        amounts = [reachable(np.bincount(c, tokens * (weights > 0), len(g)), g, rate * tokens.sum())
                   for c, g in zip(codes, goals)]
        factors = rake(tokens, codes, [a / tokens.sum() for a in amounts], start=rates, bound=1.0)
        rates = rates * np.prod([f[c] for f, c in zip(factors, codes)], axis=0)
    return cells.sparkSession.createDataFrame(
        [(*(r[d] for d in MOST), float(w), min(1.0, float(p))) for r, w, p in zip(rows, weights, rates)],
        ", ".join(f"{d} string" for d in MOST) + ", weight double, probability double")


def reachable(available: np.ndarray, goal: np.ndarray, amount: float) -> np.ndarray:
    """Tokens of each category, `amount` in all: by its goal, or all it has, and the others share the rest."""
    amount = min(amount, available.sum())
    asked = np.divide(goal, available, out=np.zeros_like(goal), where=available > 0)
    return available * np.minimum(1, asked * rate_scale(available, asked, amount / (available.sum() or 1.0)))


def goal_table(cells: DataFrame, d: str, goal: dict[str, float] | None, power: float) -> DataFrame:
    """(category, goal): target shares of the categories of `d` that have tokens; without any, tempered ones."""
    margin = cells.groupBy(d).agg(F.sum("tokens").alias("m")).where("m > 0")
    if goal:
        given = cells.sparkSession.createDataFrame([(c, float(v)) for c, v in goal.items()], f"{d} string, goal double")
        shares = margin.join(given, d, "left").select(d, F.coalesce("goal", F.lit(0.0)).alias("goal"))
    else:
        shares = margin.select(d, F.pow("m", F.lit(power)).alias("goal"))
    shares = stored(shares, f"goal_{d}")
    total = shares.agg(F.sum("goal")).first()[0] or 1.0
    return shares.select(d, (F.col("goal") / total).alias("goal"))


def rake_table(raked: DataFrame, goals: dict[str, DataFrame], total: float, bound: float = float("inf"),
               rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """`rake` of a table of cells (dimensions, tokens, weight): its weights times the factors. Stored once a round."""
    before = float("inf")
    for _ in range(rounds):
        raked = raked.withColumn("off", F.lit(0.0))
        for d, goal in goals.items():
            held = F.col("tokens") * F.least(F.col("weight"), F.lit(bound))
            free = F.when(F.col("weight") < bound, F.col("tokens") * F.col("weight")).otherwise(0.0)
            margin = raked.groupBy(d).agg((F.sum(held) / total).alias("m"), (F.sum(free) / total).alias("free"))
            miss = F.coalesce("goal", F.lit(0.0)) - F.col("m")
            part = F.when(miss > 0, F.col("free")).otherwise(F.col("m"))
            step = margin.join(goal, d, "left").select(
                d, F.when(F.col("m") > 0, F.when(part > 0, 1 + miss / part).otherwise(1.0)).otherwise(0.0).alias("by"),
                F.abs(miss).alias("miss"))
            raked = raked.join(step, d).select(
                *MOST, "tokens", F.least(F.lit(MOST_FACTOR), F.col("weight") * F.col("by")).alias("weight"),
                F.greatest("off", "miss").alias("off"))
        raked = stored(raked, "raked")
        off = raked.agg(F.max("off")).first()[0]
        raked = raked.drop("off")
        if off <= tolerance or abs(before - off) <= tolerance * 1e-3:
            break
        before = off
    return raked


def rake_on_spark(cells: DataFrame, targets: dict | None, power: float, rate: float) -> DataFrame:
    """`rake_on_driver` for any number of categories."""
    cells = cells.select(*MOST, F.coalesce("tokens", F.lit(0)).alias("tokens"))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.select(*MOST, F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"))
    goals = {d: goal_table(cells, d, (targets or {}).get(d), power) for d in MOST}
    raked = rake_table(cells.withColumn("weight", F.lit(1.0)), goals, total)
    scale = table_rate_scale(raked, rate * total)
    weighted = raked.select(*MOST, "weight", F.least(F.lit(1.0), F.col("weight") * scale).alias("probability"))
    if (raked.agg(F.max("weight")).first()[0] or 0.0) * scale <= 1:
        return weighted
    reached = {}
    for d, goal in goals.items():
        available = raked.where("weight > 0").groupBy(d).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        asked = stored(available.join(goal, d).select(d, "tokens", (F.col("goal") / F.col("tokens")).alias("weight")), f"asked_{d}")
        level = table_rate_scale(asked, rate * total)
        reached[d] = asked.select(d, (F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * level) / total).alias("goal"))
    rates = rake_table(raked.withColumn("weight", F.col("weight") * scale), reached, total, bound=1.0)
    rates = rates.select(*MOST, F.least(F.lit(1.0), "weight").alias("probability"))
    return weighted.drop("probability").join(rates, list(MOST))


def table_rate_scale(raked: DataFrame, goal: float) -> float:
    """`rate_scale` of a table of cells: tangents of a concave function of the scale, from the left."""
    goal = min(goal, float(raked.where("weight > 0").agg(F.sum("tokens")).first()[0] or 0))
    scale = 0.0
    while goal:
        full = F.col("weight") * scale >= 1
        sums = raked.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("free")).first()
        following = (goal - sums.full) / sums.free if sums.free else scale
        if following <= scale * (1 + 1e-12):
            break
        scale = following
    return scale


def category(d: str):
    """Category of a row in a dimension; NULL is one."""
    return F.coalesce(F.col(d).cast("string"), F.lit(NONE))


def mix_to_targets(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.5,
                   rate: float = 0.5, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs`, its topic, n_tokens, weight, probability and sampled.

    targets: shares of tokens by dimension (source, lang, topic) and category; a dimension without
    any gets its corpus shares raised to `power`. Categories without a target share get weight 0
    only where targets are given. A document is sampled if a hash of its id and text falls below
    its probability. Probabilities make the expected tokens `rate` of all: the weights times one
    scale where none gets over 1, else raked again with the bound 1. A category that would need more
    than all its documents then gives all of them, and the others of its dimension share the rest by
    their targets; `mix_shares` tells target and reached share. Weights keep the targets as given.
    NULL categories are a category, NULL text has no tokens, rows with equal id and text are
    sampled alike. `topic` is an input column of that name or the form of the text. Other input
    columns with the name of an added one are replaced. Runs jobs.
    """
    added = ("n_tokens", "weight", "probability", "sampled")
    names = other_columns(docs, *added, "topic")
    own_topic = next((c for c in docs.columns if c.lower() == "topic"), None)
    counted = docs.select(*quoted(names), *([F.col(own_topic).alias("topic")] if own_topic else []),
                          words(F.col(text)).alias("n_tokens"))
    if not own_topic:
        counted = counted.withColumn("topic", text_form(F.col(text), F.col("n_tokens")))
    cells = stored(counted.groupBy(*(category(d).alias(d) for d in MOST)).agg(F.sum("n_tokens").alias("tokens")), "cells")
    few = all(cells.select(d).distinct().limit(most + 1).count() <= most for d, most in MOST.items())
    few = few and cells.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    table = (rake_on_driver if few else rake_on_spark)(cells, targets, power, rate)
    keys = {d: free_name(counted, f"_key_{d}") for d in MOST}
    values = {v: free_name(counted, f"_{v}") for v in ("weight", "probability")}
    table = table.select(*(F.col(d).alias(k) for d, k in [*keys.items(), *values.items()]))
    match = [category(d) == F.col(k) for d, k in keys.items()]
    out = counted.join(F.broadcast(table) if few else table, match, "left")
    draw = F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(seed)), 11) / F.lit(float(1 << 53))
    out = out.withColumns({v: F.coalesce(F.col(name), F.lit(0.0)) for v, name in values.items()})
    return out.withColumn("sampled", draw < F.col("probability")).select(*quoted(names), "topic", *added)


def mix_shares(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.5) -> DataFrame:
    """(dimension, category, tokens, target, reached) of the output of `mix_to_targets` with the same targets.

    `reached` is the share of the expected sampled tokens; it is below `target` where a category
    has too few tokens. Categories without tokens have target 0 and are missing if no row has them.
    Runs jobs.
    """
    cells = stored(mixed.groupBy(*(category(d).alias(d) for d in MOST)).agg(
        F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("kept")), "mixed")
    kept = cells.agg(F.sum("kept")).first()[0] or 1.0
    tables = []
    for d in MOST:
        margin = cells.groupBy(d).agg(F.sum("tokens").alias("tokens"), (F.sum("kept") / kept).alias("reached"))
        goal = goal_table(cells, d, (targets or {}).get(d), power)
        tables.append(margin.join(goal, d, "left").select(
            F.lit(d).alias("dimension"), F.col(d).alias("category"), "tokens",
            F.coalesce("goal", F.lit(0.0)).alias("target"), "reached"))
    return reduce(DataFrame.unionByName, tables)
