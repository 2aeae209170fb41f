"""Statistics of numeric telemetry: windows, publishing rates, frozen and faulty signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telescribe.operators.relational import TIE, moments, window_index


def bag_metadata(tel: DataFrame, unit_us: int = 1_000_000) -> DataFrame:
    """Messages and rate of each topic of a recording, the rate over the recording's length; its ends, messages and topics."""
    topics = tel.groupBy("bag", "topic").agg(F.count("*").alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    w = Window.partitionBy("bag")  # a row a topic
    own = topics.withColumns({"start_us": F.min("a").over(w), "end_us": F.max("b").over(w), "total": F.sum("n").over(w), "topics": F.count("*").over(w)})
    seconds = (F.col("end_us") - F.col("start_us")) / 1e6
    hz = F.when(seconds > 0, F.round(F.col("n") / (seconds * 1e6 / unit_us) + TIE, 2)).otherwise(0.0)
    return own.select("bag", "topic", "n", F.round(seconds, 2).alias("duration_s"), hz.alias("hz"), "start_us", "end_us", "total", "topics")


def topic_stats(tel: DataFrame) -> DataFrame:
    return tel.groupBy("bag", "topic").agg(*moments(F.col("value")))


def windowed_stats(tel: DataFrame, width_us: int) -> DataFrame:
    """Statistics by windows anchored at each recording's start; windows without messages are rows of count 0."""
    bags = tel.groupBy("bag").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    indexed = tel.join(bags, "bag").withColumn("w", window_index(F.col("ts_us"), F.col("t0"), width_us))
    full = indexed.groupBy("bag", "topic", "w").agg(*moments(F.col("value")))
    every = tel.select("bag", "topic").distinct().join(bags, "bag").withColumn("w", F.explode(F.sequence(F.lit(0).cast("bigint"), window_index(F.col("t1"), F.col("t0"), width_us))))
    return every.select("bag", "topic", "w").join(full, ["bag", "topic", "w"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def field_statistics(signals: DataFrame, width_us: int | None = None, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Statistics of every field of every topic, over a stretch of the recording (all of it without ends) or its windows.

    Columns: bag, topic, w, start_us, end_us of the window, messages, field, n (finite values), mean, std, low, high. Windows
    begin at the stretch's start and hold their right edge, the first one both; the last ends with the stretch. A window
    without messages is one row without a field. signals: (bag, topic, field, seq, ts_us, value).
    """
    bags = signals.groupBy("bag").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))  # a row a recording
    bags = bags.withColumns({"t0": F.col("t0") if start_us is None else F.lit(start_us).cast("bigint"), "t1": F.col("t1") if end_us is None else F.lit(end_us).cast("bigint")})
    rows = signals.join(F.broadcast(bags), "bag").where("ts_us >= t0 and ts_us <= t1")
    w = F.lit(0).cast("bigint") if width_us is None else window_index(F.col("ts_us"), F.col("t0"), width_us)
    # a window's messages are told apart by their number, so fields and messages come from one grouping
    per = rows.withColumn("w", w).groupBy("bag", "topic", "w", "field").agg(*moments(F.col("value")))
    heard = rows.withColumn("w", w).groupBy("bag", "topic", "w").agg(F.countDistinct("seq", "ts_us").alias("messages"))
    last = F.lit(0).cast("bigint") if width_us is None else window_index(F.col("t1"), F.col("t0"), width_us)
    every = signals.select("bag", "topic").distinct().join(F.broadcast(bags), "bag").withColumn("w", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    begin = F.col("t0") + F.col("w") * (width_us or 0)
    end = F.col("t1") if width_us is None else F.least(begin + width_us, F.col("t1"))
    out = every.select("bag", "topic", "w", begin.alias("start_us"), end.alias("end_us")).join(heard, ["bag", "topic", "w"], "left").join(per, ["bag", "topic", "w"], "left")
    return out.withColumn("messages", F.coalesce("messages", F.lit(0).cast("bigint")))


def topic_ends(tel: DataFrame) -> DataFrame:
    """(bag, topic, t0, t1): first and last time of each topic."""
    return tel.groupBy("bag", "topic").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))


def rate_bins(tel: DataFrame, width_us: int, ends: DataFrame | None = None, unit_us: int = 1_000_000) -> DataFrame:
    """(bag, topic, bins, bin, t0, start_us, n, hz) of bins from each topic's first message on, but for the empty ones.

    hz is the messages in a unit of time, rounded to two digits. ends: topic_ends(), where it is known already.
    """
    ends = topic_ends(tel) if ends is None else ends
    bins = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / width_us)).cast("bigint")
    binned = tel.join(ends.withColumn("bins", bins), ["bag", "topic"])
    binned = binned.withColumn("bin", F.least(F.floor((F.col("ts_us") - F.col("t0")) / width_us), F.col("bins") - 1).cast("bigint"))
    counts = binned.groupBy("bag", "topic", "bins", "bin").agg(F.min("t0").alias("t0"), F.count("*").alias("n"))
    return counts.select("bag", "topic", "bins", "bin", "t0", (F.col("t0") + F.col("bin") * width_us).alias("start_us"), "n", F.round(F.col("n") / (width_us / unit_us) + TIE, 2).alias("hz"))


def frequency(full: DataFrame) -> DataFrame:
    """Mean, population deviation and ends of the rates of all bins, the empty ones included. full: rate_bins()."""
    own = full.groupBy("bag", "topic", "bins").agg(F.sum("hz").alias("t"), F.sum(F.col("hz") * F.col("hz")).alias("s"), F.sum("n").alias("messages"), F.count("*").alias("full_bins"), F.max("hz").alias("max_hz"), F.min("hz").alias("low"), F.min("t0").alias("t0"))
    mean = F.col("t") / F.col("bins")
    return own.select(
        "bag", "topic", "bins", "full_bins", "messages", F.round(mean + TIE, 2).alias("mean_hz"), F.round(F.sqrt(F.greatest(F.col("s") / F.col("bins") - mean * mean, F.lit(0.0))) + TIE, 2).alias("std_hz"), "max_hz",
        F.when(F.col("full_bins") < F.col("bins"), 0.0).otherwise(F.col("low")).alias("min_hz"), "t0",
    )


def topic_frequency(tel: DataFrame, width_us: int, unit_us: int = 1_000_000) -> DataFrame:
    """Rate in bins from each topic's first message on, empty ones included, and its mean and population deviation."""
    return frequency(rate_bins(tel, width_us, unit_us=unit_us)).drop("t0")


def dropouts(full: DataFrame, bags: DataFrame, width_us: int, share: float = 0.3, margin_us: int = 10_000_000) -> DataFrame:
    """(bag, topic, start_us, hz, mean_hz): bins whose rate is below a share of the mean, but for those at the recording's end.

    full: rate_bins(); bags: (bag, end_us). Empty bins count; they are made from the topics' numbers of bins.
    """
    every = frequency(full).where("mean_hz > 0").select("bag", "topic", "t0", "mean_hz", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"))
    both = every.join(full.select("bag", "topic", "bin", "hz"), ["bag", "topic", "bin"], "left").withColumns({"hz": F.coalesce("hz", F.lit(0.0)), "start_us": F.col("t0") + F.col("bin") * width_us})
    low = both.where(F.col("hz") < share * F.col("mean_hz")).join(F.broadcast(bags.select("bag", "end_us")), "bag")  # a row a recording
    return low.where(F.col("start_us") < F.col("end_us") - margin_us).select("bag", "topic", "start_us", "hz", "mean_hz")


def _previous(windows: DataFrame, keys: list[str], by: str, *names: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(by)
    return windows.withColumns({f"p_{n}": F.lag(n).over(w) for n in names})


def freeze_transitions(stats: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Onset: deviation falls from over .001 to under 1e-6. Resume: the reverse, after a mean other than 0."""
    s = _previous(stats, keys, by, "std", "mean")
    kind = F.when((F.col("p_std") > 0.001) & (F.col("std") < 1e-6), "FREEZE_ONSET").when((F.col("p_std") < 1e-6) & (F.col("std") > 0.001) & (F.col("p_mean") != 0), "SENSOR_RESUME")
    return s.select(*keys, by, kind.alias("category")).where("category is not null")


def fault_transitions(stats: DataFrame, keys: list[str], by: str) -> DataFrame:
    """A health flag's mean crosses one half; one of exactly one half is on neither side."""
    s = _previous(stats, keys, by, "mean")
    kind = F.when((F.col("p_mean") > 0.5) & (F.col("mean") < 0.5), "HW_FAULT_ONSET").when((F.col("p_mean") < 0.5) & (F.col("mean") > 0.5), "HW_FAULT_RECOVERED")
    return s.select(*keys, by, kind.alias("category")).where("category is not null")


def degradation(stats: DataFrame, keys: list[str], by: str, least: float = 50, share: float = 0.3) -> DataFrame:
    """Windows whose mean falls below a share of one over least; empty windows count as 0."""
    s = _previous(stats.withColumn("mean", F.coalesce("mean", F.lit(0.0))), keys, by, "mean")
    return s.where((F.col("p_mean") > least) & (F.col("mean") < share * F.col("p_mean"))).select(*keys, by, F.col("p_mean").alias("before"), F.col("mean").alias("after"))


def stalls(command: DataFrame, motion: DataFrame, keys: list[str], least: float = 0.05) -> DataFrame:
    """Windows in which motion is commanded and none is seen; a window without odometry counts as none."""
    m = motion.select(*keys, F.col("std").alias("m_std"))
    return command.where(F.col("mean") > least).join(m, keys, "left").where(F.coalesce("m_std", F.lit(0.0)) < 1e-6).select(*keys, "mean")


def nearest_samples(tel: DataFrame, at_us: int, k: int) -> DataFrame:
    return tel.withColumn("distance_us", F.abs(F.col("ts_us") - at_us)).orderBy("distance_us", "seq").limit(k).select("seq", "ts_us", "topic", "value", "distance_us")
