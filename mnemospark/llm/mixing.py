"""Mixing sources to target weights: entropy balancing.

Documents get rates w = min(cap, q exp(l_s x)), x the document's tokens over the mean, one multiplier l_s for each source;
distributed Newton iterations solve the convex dual so that every source's expected tokens meet its target. The total is
the largest at which every source can reach its share within its cap. Rates are rounded into copies systematically along
the token size, which keeps a source's tokens within one document of the target.

Rates depend on source and size alone, so the iterations run over the histogram of (source, size), and the running sums of
the rounding over its bins; bins of very many documents are salted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import cut

BIN, ROUNDS, TOLERANCE = 50_000, 80, 1e-9


def _rate() -> F.Column:
    return F.least(F.col("cap"), F.exp(F.least(F.col("base") + F.col("l") * F.col("x"), F.lit(50.0))))


def solve(hist: DataFrame, targets: list[tuple[str, float, int]]) -> tuple[dict[str, tuple[float, float]], float]:
    """hist: source, n_tokens, c. -> ({source: (log of the base rate, multiplier)}, total tokens)."""
    spark = hist.sparkSession
    hist = hist.where(F.col("source").isin([s for s, _, _ in targets]))  # only what has a target comes to the driver
    have = {r["source"]: (r["t"], r["c"]) for r in hist.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("c")).alias("t"), F.sum("c").alias("c")).collect()}
    live = [(s, w, m) for s, w, m in targets if w and w > 0 and m and m > 0 and have.get(s, (0, 0))[0] > 0]
    if not live:
        return {}, 0.0
    whole = sum(w for _, w, _ in live)
    live = [(s, w / whole, m) for s, w, m in live]  # sources without documents leave their share to the others
    total = min(m * have[s][0] / w for s, w, m in live)
    corpus = sum(have[s][0] for s, _, _ in live)
    mean = corpus / sum(have[s][1] for s, _, _ in live)
    q = math.log(total / corpus)
    l = {s: 0.0 for s, _, _ in live}
    low, high = {s: -60.0 for s in l}, {s: None for s in l}
    goal = {s: w * total for s, w, _ in live}
    cap = {s: float(m) for s, _, m in live}
    open_ = set(l)
    for s in list(open_):  # a source that needs all its repeats is at its caps
        if goal[s] >= cap[s] * have[s][0] * (1 - 1e-12):
            open_.discard(s)
    saturated = set(l) - open_
    for _ in range(ROUNDS):
        if not open_:
            break
        now = spark.createDataFrame([(s, l[s], q, cap[s]) for s in open_], "source string, l double, base double, cap double")
        d = hist.join(F.broadcast(now), "source").withColumn("x", F.col("n_tokens") / mean).withColumn("w", _rate())
        free = F.col("w") < F.col("cap")
        g = {r["source"]: (r["t"], r["h"]) for r in d.groupBy("source").agg(F.sum(F.col("w") * F.col("n_tokens") * F.col("c")).alias("t"), F.sum(F.when(free, F.col("w") * F.col("x") * F.col("n_tokens") * F.col("c")).otherwise(0.0)).alias("h")).collect()}
        for s in list(open_):
            t, h = g[s]
            if abs(t - goal[s]) <= TOLERANCE * goal[s]:
                open_.discard(s)
                continue
            if t < goal[s]:
                low[s] = l[s]
            else:
                high[s] = l[s]
            step = l[s] + (goal[s] - t) / h if h > 0 else None
            top = high[s]
            if step is None or step <= low[s] or (top is not None and step >= top) or step > l[s] + 20:
                step = l[s] * 2 + 1 if top is None else (low[s] + top) / 2
            if top is not None and top - low[s] < 1e-13 * max(1, abs(top)):
                open_.discard(s)
            l[s] = step
    return {s: (50.0, 0.0) if s in saturated else (q, l[s]) for s in l}, total


def mix(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes (id, source, n_tokens), targets (source, target_share, max_repeats) -> (id, source, n_tokens, rate, copies).

    Every document with an id comes out once; documents of sources without a target, of null sources and of targets without
    a positive share have rate and copies 0. Shares are taken relative to their sum over the sources that have tokens.
    """
    spark = sizes.sparkSession
    d = cut(sizes.where("id is not null").select("id", "source", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    hist = cut(d.where("source is not null").groupBy("source", "n_tokens").agg(F.count("*").alias("c")))
    goals = [(r["source"], r["s"], r["m"]) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).collect()]
    rates, _ = solve(hist, goals)
    caps = {s: float(m or 0) for s, _, m in goals}
    n = hist.agg(F.sum("c").alias("c"), F.sum(F.when(F.col("source").isin([*rates]), F.col("c") * F.col("n_tokens"))).alias("t"), F.sum(F.when(F.col("source").isin([*rates]), F.col("c"))).alias("n")).first()
    mean = (n["t"] or 1) / (n["n"] or 1)
    table = spark.createDataFrame([(s, b, l, caps[s]) for s, (b, l) in rates.items()] or [("", 0.0, 0.0, 0.0)], "source string, base double, l double, cap double")
    w = hist.join(F.broadcast(table), "source").withColumn("x", F.col("n_tokens") / F.lit(mean)).withColumn("w", _rate())
    # salted bins, in the order of size; their running sums of rates
    salts = F.ceil(F.col("c") / BIN).cast("int")
    keyed = d.join(F.broadcast(hist.where(F.col("c") > BIN).select("source", "n_tokens", salts.alias("salts"))), ["source", "n_tokens"], "left") if not hist.where(F.col("c") > BIN).isEmpty() else d.withColumn("salts", F.lit(1))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    bins = keyed.where("source is not null").groupBy("source", "n_tokens", "salt").agg(F.count("*").alias("c")).join(w.select("source", "n_tokens", "w"), ["source", "n_tokens"])
    run = Window.partitionBy("source").orderBy("n_tokens", "salt").rowsBetween(Window.unboundedPreceding, -1)
    bins = cut(bins.withColumn("before", F.coalesce(F.sum(F.col("w") * F.col("c")).over(run), F.lit(0.0))).drop("c"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "salt").orderBy(F.xxhash64("id"), "id"))
    e = keyed.join(bins, ["source", "n_tokens", "salt"], "left").withColumn("rk", rank)
    up = lambda k: F.floor(F.col("before") + k * F.col("w") + 0.5 + 1e-9)
    copies = F.coalesce((up(F.col("rk")) - up(F.col("rk") - 1)).cast("int"), F.lit(0))
    return e.select("id", "source", "n_tokens", F.coalesce("w", F.lit(0.0)).alias("rate"), copies.alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What was reached, one row per target source and per other source of the documents."""
    per = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("copies").cast("long").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).cast("long").alias("mixed_tokens"))
    whole = per.agg(F.sum("mixed_tokens").alias("whole"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = t.join(per, t["source"].eqNullSafe(per["source"]), "full").join(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select(F.coalesce(t["source"], per["source"]).alias("source"), "target_share", "max_repeats", zero("documents"), zero("tokens"), zero("copies"), zero("most_copies"), zero("mixed_tokens"), F.when(F.col("whole") > 0, F.coalesce("mixed_tokens", F.lit(0)) / F.col("whole")).otherwise(0.0).alias("actual_share"))
