"""Change points of window series and the regimes between them.

A series is dealt out in blocks of windows, so that one of any length is many tasks. What a block needs of those before
it, a running sum, is one number a block, carried on between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telescribe.operators.scratch import checkpointed, discard

#: Windows of a block.
BLOCK = 4096


def change_points(series: DataFrame, keys: Sequence[str], by: str, value: str, sigmas: float = 3.0, drift: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Windows at which the sum of excesses over the mean passes mean + sigmas deviations; it then starts again from 0.

    Series of fewer than three windows have none; a constant series counts as of deviation 1. Every block runs by itself,
    at first as if the sum were 0 before it; a block that another sum reaches runs again, until none does. Sums fall to 0
    time and again, so that few blocks run twice.
    """
    own = series.select(*keys, F.col(by).alias("_at"), F.col(value).alias("_x")).withColumn("_block", F.floor(F.col("_at") / block))
    whole = own.groupBy(*keys).agg(F.round(F.avg("_x"), 9).alias("_mean"), F.round(F.stddev_pop("_x"), 9).alias("_std"), F.count("*").alias("_n")).where("_n >= 3").drop("_n")
    points = own.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_x").alias("x")))).alias("_points"))
    # a key without columns is one key; a row a key
    points = points.join(F.broadcast(whole), [*keys]) if keys else points.join(F.broadcast(whole))
    points = checkpointed(points.withColumn("_limit", F.col("_mean") + sigmas * F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)))

    def step(held, point):
        total = F.greatest(F.lit(0.0), held["total"] + point["x"] - F.col("_mean") - drift)
        over = total > F.col("_limit")
        return F.struct(F.when(over, 0.0).otherwise(total).alias("total"), F.when(over, F.array_append(held["found"], point["at"])).otherwise(held["found"]).alias("found"))

    def run(blocks: DataFrame) -> DataFrame:
        """blocks: points with _came, the sum that reaches them."""
        start = F.struct(F.col("_came").alias("total"), F.array().cast("array<bigint>").alias("found"))
        return blocks.withColumn("_end", F.aggregate("_points", start, step)).select(*keys, "_block", "_came", F.col("_end.total").alias("_left"), F.col("_end.found").alias("_found"))

    turn = Window.partitionBy(*keys).orderBy("_block")  # a row a block
    done = checkpointed(run(points.withColumn("_came", F.lit(0.0))))
    while True:
        due = done.withColumn("_due", F.coalesce(F.lag("_left").over(turn), F.lit(0.0)))
        again = checkpointed(due.where("_due <> _came").select(*keys, "_block", F.col("_due").alias("_came")))
        if not again.limit(1).count():
            discard(points, again)
            return done.select(*keys, F.explode("_found").alias(by))
        now = checkpointed(done.join(again.drop("_came"), [*keys, "_block"], "left_anti").unionByName(run(points.join(again, [*keys, "_block"]))))
        discard(done, again)
        done = now


def regimes(series: DataFrame, changes: DataFrame, keys: Sequence[str], by: str, least: int = 3, begins: bool = False, block: int = BLOCK) -> DataFrame:
    """Runs of windows between change points; a run of fewer than least windows joins the run before it, but for the first.

    A change point is the last window of its run, or with begins the first, as where a window's value is its deviation
    from the window before. Columns: keys, regime (from 0), first_w, last_w, windows. Change points are counted in blocks,
    and the counts of the blocks before are added.
    """
    marked = series.select(*keys, by).join(changes.withColumn("_change", F.lit(1)), [*keys, by], "left").withColumns({"_change": F.coalesce("_change", F.lit(0)), "_block": F.floor(F.col(by) / block)})
    past = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    sums = marked.groupBy(*keys, "_block").agg(F.sum("_change").alias("_sum")).withColumn("_past", F.coalesce(F.sum("_sum").over(past), F.lit(0))).drop("_sum")
    inside = F.sum("_change").over(Window.partitionBy(*keys, "_block").orderBy(by))
    runs = marked.withColumn("_run", inside if begins else inside - F.col("_change")).join(sums, [*keys, "_block"]).withColumn("_run", F.col("_run") + F.col("_past"))
    runs = runs.groupBy(*keys, "_run").agg(F.min(by).alias("first_w"), F.max(by).alias("last_w"), F.count("*").alias("windows"))
    turn = Window.partitionBy(*keys).orderBy("_run")  # a row a run
    kept = runs.withColumn("_own", ((F.col("_run") == 0) | (F.col("windows") >= least)).cast("bigint")).withColumn("regime", F.sum("_own").over(turn) - 1)
    return kept.groupBy(*keys, "regime").agg(F.min("first_w").alias("first_w"), F.max("last_w").alias("last_w"), F.sum("windows").alias("windows"))


def log_regimes(deviations: DataFrame, keys: Sequence[str], sigmas: float = 3.0, least: int = 3, block: int = BLOCK) -> DataFrame:
    """(keys, regime, first_w, last_w, windows) of each source's log windows. deviations: window_deviation(), whose first window is number 1."""
    series = deviations.select(*keys, "w", F.round(F.col("distance") + F.col("divergence"), 4).alias("x"))
    every = series.select(*keys, "w").unionByName(series.groupBy(*keys).agg(F.min("w").alias("w")).where("w is not null").select(*keys, (F.col("w") - 1).alias("w")))
    return regimes(every, change_points(series, keys, "w", "x", sigmas=sigmas, block=block), keys, "w", least, begins=True, block=block)


def regime_baseline(prints: DataFrame, windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What a regime's windows usually hold: (regime, node, template, expected).

    prints: (w, node, template, n); windows: (regime, w), every window of the regime. A template counts if three fifths of
    the windows hold it; expected is the median of its counts, rounded down, over the windows from its first on.
    Windows without it are counted, not made into rows.
    """
    every = Window.partitionBy(*keys, "regime")
    placed = windows.withColumns({"_at": F.row_number().over(every.orderBy("w")), "_size": F.count("*").over(every)})
    held = prints.join(placed, [*keys, "w"]).groupBy(*keys, "regime", "node", "template").agg(F.sort_array(F.collect_list("n")).alias("_n"), F.min("_at").alias("_first"), F.max("_size").alias("_size"))
    held = held.where(F.size("_n") * 5 >= F.col("_size") * 3).withColumn("_span", (F.col("_size") - F.col("_first") + 1).cast("int"))
    zeros = F.col("_span") - F.size("_n")
    middle = lambda at: F.when(at > zeros, F.element_at("_n", F.greatest(at - zeros, F.lit(1)))).otherwise(0)
    low, high = F.expr("(_span + 1) div 2").cast("int"), F.expr("_span div 2 + 1").cast("int")
    return held.select(*keys, "regime", "node", "template", F.floor((middle(low) + middle(high)) / 2).cast("bigint").alias("expected"))


def structural_anomalies(prints: DataFrame, windows: DataFrame, baseline: DataFrame, importance: Column, percent: float = 0.9, fresh: float = 2.0, rate: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """Departures of the regimes' most unusual windows from their baseline: (regime, w, node, template, kind, expected, observed, score).

    missing_template weighs importance times the expected count, new_template importance times the observed count times
    fresh, rate_anomaly (a ratio beyond rate either way) importance times the ratio's absolute log2. A window's departures
    are reported if their sum is above 0 and above that percentile of its regime's windows. Regimes without a baseline
    report none. importance: a column over node.
    """
    of = [*keys, "regime"]
    known = windows.join(baseline.select(*of).distinct(), of, "left_semi")
    due = known.join(baseline, of)
    seen = prints.join(known, [*keys, "w"]).withColumnRenamed("n", "observed")
    both = due.join(seen, [*of, "w", "node", "template"], "full")
    ratio = F.col("observed") / F.col("expected")
    kind = (
        F.when(F.col("observed").isNull(), "missing_template")
        .when(F.col("expected").isNull(), "new_template")
        .when((F.col("expected") > 0) & ((ratio > rate) | (ratio < 1 / rate)), "rate_anomaly")
    )
    weight = F.when(F.col("kind") == "missing_template", F.col("expected")).when(F.col("kind") == "new_template", F.col("observed") * fresh).otherwise(F.abs(F.log2(ratio)))
    found = both.withColumn("kind", kind).where("kind is not null").withColumn("score", F.round(importance * weight, 6))
    totals = known.join(found.groupBy(*of, "w").agg(F.sum("score").alias("_sum")), [*of, "w"], "left").select(*of, "w", F.round(F.coalesce("_sum", F.lit(0.0)), 6).alias("_sum"))
    limits = totals.groupBy(*of).agg(F.round(F.percentile("_sum", F.lit(percent)), 6).alias("_limit"))
    flagged = totals.join(limits, of).where("_sum > _limit and _sum > 0").select(*of, "w")
    zero = F.lit(0).cast("bigint")
    return found.join(flagged, [*of, "w"]).select(*of, "w", "node", "template", "kind", F.coalesce("expected", zero).alias("expected"), F.coalesce("observed", zero).alias("observed"), "score")


def regime_transitions(prints: DataFrame, windows: DataFrame, importance: Column, edge: int = 2, fresh: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """Templates of the first windows of a regime that the last ones of the regime before lack, and the reverse.

    Columns: regime (the new one), w (its first window), node, template, kind, score. Regimes are numbered without gaps.
    """
    of = [*keys, "regime"]
    one = Window.partitionBy(*of)
    placed = windows.withColumns({"_at": F.row_number().over(one.orderBy("w")), "_back": F.row_number().over(one.orderBy(F.desc("w")))})
    after = (F.col("regime") + 1).alias("regime")
    begins = placed.where("_at = 1").select(*of, F.col("w").alias("_begin")).join(placed.select(*keys, after).distinct(), of, "left_semi")
    edges = placed.where(F.col("_at") <= edge).select(*of, "w", F.lit(1).alias("_new"))
    edges = edges.unionByName(placed.where(F.col("_back") <= edge).select(*keys, after, "w", F.lit(0).alias("_new")))
    held = prints.join(edges, [*keys, "w"]).join(begins, of).groupBy(*of, "_begin", "node", "template").agg(F.min("_new").alias("_low"), F.max("_new").alias("_high"))
    came = F.col("_low") == 1
    kind = F.when(came, "regime_transition_appeared").otherwise("regime_transition_disappeared")
    return held.where("_low = _high").select(*of, F.col("_begin").alias("w"), "node", "template", kind.alias("kind"), (importance * F.when(came, fresh).otherwise(1.0)).alias("score"))
