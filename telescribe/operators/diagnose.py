"""The anomaly rules of a recording's signals, each one filter over global, windowed or rate statistics.

Signals: (bag, topic, field, ts_us, value). All rules give rows of one shape, so their union is one table:
(bag, severity, category, topic, field, ts_us, value, expected); ts_us is null where a rule speaks of the whole recording.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telescribe.operators import telemetry as T
from telescribe.operators.relational import TIE, moments, window_index
from telescribe.operators.scratch import checkpointed
from telescribe.plans import rules

#: Width of windows and of rate bins, and how long before a recording's end rates say nothing.
WINDOW_US, BIN_US, MARGIN_US = 30_000_000, 5_000_000, 10_000_000
#: Messages from which a signal that does not change is frozen, and a health flag at fault.
FROZEN_FROM, FAULT_FROM = 10, 5


def bounds(signals: DataFrame) -> DataFrame:
    """(bag, start_us, end_us) of every recording."""
    return signals.groupBy("bag").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


def messages(signals: DataFrame) -> DataFrame:
    """(bag, topic, seq, ts_us): one row a message of those with fields."""
    return signals.select("bag", "topic", "seq", "ts_us").distinct()


class Statistics:
    """What all rules of a recording's signals read, each worked out when first asked for and written.

    Three passes over the signals make them all: the ends of topics, the windows of fields, and the rates' bins.
    """

    def __init__(self, signals: DataFrame, window_us: int = WINDOW_US, bin_us: int = BIN_US, margin_us: int = MARGIN_US, unit_us: int = 1_000_000):
        self.signals, self.window_us, self.bin_us, self.margin_us, self.unit_us = signals, window_us, bin_us, margin_us, unit_us

    @cached_property
    def ends(self) -> DataFrame:
        """(bag, topic, t0, t1)."""
        return checkpointed(T.topic_ends(self.signals))

    @cached_property
    def bags(self) -> DataFrame:
        """(bag, start_us, end_us)."""
        return self.ends.groupBy("bag").agg(F.min("t0").alias("start_us"), F.max("t1").alias("end_us"))

    @cached_property
    def windows(self) -> DataFrame:
        """(bag, topic, field, w, start_us, n, mean, std, low, high, avg, spread) of windows that hold any of a field; avg is
        not rounded, spread is the sum of squares about it."""
        rows = self.signals.join(F.broadcast(self.bags.select("bag", F.col("start_us").alias("t0"))), "bag")  # a row a recording
        rows = rows.withColumn("w", window_index(F.col("ts_us"), F.col("t0"), self.window_us))
        v = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
        out = rows.groupBy("bag", "topic", "field", "w").agg(F.min("t0").alias("t0"), *moments(F.col("value")), F.avg(v).alias("avg"), (F.var_pop(v) * F.count(v)).alias("spread"))
        return checkpointed(out.withColumn("start_us", F.col("t0") + F.col("w") * self.window_us).drop("t0"))

    @cached_property
    def fields(self) -> DataFrame:
        """(bag, topic, field, n, mean, std, low, high): the windows rolled up, which is exact."""
        keys = ["bag", "topic", "field"]
        whole = self.windows.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("avg")) / F.sum("n")).alias("_mean"))
        away = F.col("avg") - F.col("_mean")
        out = self.windows.join(whole, keys).groupBy(*keys).agg(F.max("_n").alias("n"), F.max("_mean").alias("_mean"), F.sum(F.col("spread") + F.col("n") * away * away).alias("_spread"), F.min("low").alias("low"), F.max("high").alias("high"))
        std = F.when(F.col("n") > 1, F.sqrt(F.col("_spread") / (F.col("n") - 1))).otherwise(0.0)
        return checkpointed(out.select(*keys, "n", F.round(F.col("_mean") + TIE, 6).alias("mean"), F.round(std, 6).alias("std"), "low", "high"))

    @cached_property
    def bins(self) -> DataFrame:
        """rate_bins() of all topics."""
        return checkpointed(T.rate_bins(messages(self.signals), self.bin_us, self.ends, self.unit_us))


def expected_zero() -> Column:
    """Whether the row's field may well be zero all the time."""
    return reduce(lambda a, b: a | b, [(F.col("topic") == t) & F.col("field").isin(*fields) for t, fields in rules.EXPECTED_ZERO.items()])


#: A rule: when it fires, severity, category, and the columns that it reports as value and as what was expected.
Rule = tuple[Column, str, str | Column, str, str | None]


def judged(rows: DataFrame, checks: list[Rule], ts: str | None = None, topic: str | None = None) -> DataFrame:
    """The findings of all rules over one table, in one pass: (bag, severity, category, topic, field, ts_us, value, expected)."""
    of = lambda name: F.lit(None).cast("double") if name is None else F.col(name).cast("double")
    kind = lambda c: F.lit(c) if isinstance(c, str) else c
    hits = [F.when(when, F.struct(F.lit(severity).alias("severity"), kind(category).alias("category"), of(value).alias("value"), of(expected).alias("expected"))) for when, severity, category, value, expected in checks]
    where = (F.col("topic") if topic is None else F.lit(topic)).alias("topic")
    field = (F.col("field") if "field" in rows.columns else F.lit(None).cast("string")).alias("field")
    at = (F.lit(None).cast("bigint") if ts is None else F.col(ts)).alias("ts_us")
    out = rows.select("bag", where, field, at, F.explode(F.array_compact(F.array(*hits))).alias("x"))
    return out.select("bag", "x.severity", "x.category", "topic", "field", "ts_us", "x.value", "x.expected")


def of_fields(st: Statistics) -> DataFrame:
    """Fields over the whole recording: such as never change, at zero or at another value, at fault, or out of range."""
    topic, field, mean, std, low = (F.col(c) for c in ("topic", "field", "mean", "std", "low"))
    still = (std < 1e-6) & (F.col("n") > FROZEN_FROM)
    key = topic.isin(*rules.KEY_TOPICS) & still & ~expected_zero()
    imu_data = (topic == "/device/imu_data") & still & ~expected_zero()
    flags = field.isin(*rules.HEALTH_FLAGS) & (topic == "/device/health_status")
    return judged(st.fields, [
        (key & (mean == 0), "WARNING", "ZERO_FIELD", "mean", None),
        (key & (mean != 0), "CRITICAL", "FROZEN_SENSOR", "mean", None),
        ((topic == "/unbiased_imu_PRY") & field.isin("x", "y", "z") & still, "CRITICAL", "IMU_FROZEN", "mean", None),
        ((topic == "/unbiased_imu_PRY") & (field == "z") & (std > 100), "WARNING", "IMU_HIGH_VARIANCE", "std", None),
        (flags & (mean < 0.5) & (F.col("n") > FAULT_FROM), "CRITICAL", "HW_FAULT", "mean", None),
        ((topic == "/device/odom_status") & (field.endswith("_error") | (field == "is_gliding")) & ~expected_zero() & (low < 0.5), "WARNING", "ODOM_HW_ERROR", "mean", None),
        (imu_data & field.startswith("magnetic") & (mean == 0), "INFO", "IMU_HW_FIELD_ZERO", "mean", None),
        (imu_data & (mean != 0), "WARNING", "IMU_HW_FROZEN", "mean", None),
        (topic.isin(*rules.LIDAR_TOPICS) & (field == "num_valid_points") & (mean > 50) & (low < 0.3 * mean), "WARNING", "LIDAR_POINT_DROP", "low", "mean"),
        ((topic == "/device/scrubber_status") & (field == "water_level") & (low == 0), "WARNING", "SCRUBBER_NO_WATER", "low", None),
        (topic.isin(*rules.IR_TOPICS) & (field == "data") & still & (mean == 0), "WARNING", "IR_SENSOR_DEAD", "mean", None),
    ])


def of_windows(st: Statistics) -> DataFrame:
    """Fields that freeze, resume, fail or recover between two windows that hold them; of the former only those that the
    recording's first window holds."""
    one = Window.partitionBy("bag", "topic", "field")  # a field's windows of one recording
    turn = one.orderBy("w")
    rows = st.windows.withColumns({"p_std": F.lag("std").over(turn), "p_mean": F.lag("mean").over(turn), "first": F.min("w").over(one)})
    own = F.col("topic").isin(*rules.KEY_TOPICS) & ~expected_zero() & (F.col("first") == 0)
    flags = F.col("field").isin(*rules.HEALTH_FLAGS) & (F.col("topic") == "/device/health_status")
    std, p_std, mean, p_mean = (F.col(c) for c in ("std", "p_std", "mean", "p_mean"))
    return judged(rows, [
        (own & (p_std > 0.001) & (std < 1e-6), "WARNING", "FREEZE_ONSET", "mean", None),
        (own & (p_std < 1e-6) & (std > 0.001) & (p_mean != 0), "INFO", "SENSOR_RESUME", "mean", None),
        (flags & (p_mean > 0.5) & (mean < 0.5), "CRITICAL", "HW_FAULT_ONSET", "mean", None),
        (flags & (p_mean < 0.5) & (mean > 0.5), "INFO", "HW_FAULT_RECOVERED", "mean", None),
    ], ts="start_us")


def of_rates(st: Statistics, unstable: float = 0.2, share: float = 0.3) -> DataFrame:
    """Topics whose rate drops, or varies much."""
    full = st.bins.where(F.col("topic").isin(*rules.KEY_TOPICS, *rules.LIDAR_TOPICS))
    kind = F.when(F.col("topic").isin(*rules.LIDAR_TOPICS), "LIDAR_FREQ_DROPOUT").otherwise("FREQUENCY_DROPOUT")
    low = judged(T.dropouts(full, st.bags, st.bin_us, share, st.margin_us), [(F.lit(True), "CRITICAL", kind, "hz", "mean_hz")], ts="start_us")
    uneven = F.col("topic").isin(*rules.KEY_TOPICS) & (F.col("mean_hz") > 0) & (F.col("std_hz") > unstable * F.col("mean_hz"))
    return low.unionByName(judged(T.frequency(full), [(uneven, "WARNING", "UNSTABLE_FREQUENCY", "std_hz", "mean_hz")]))


def of_recordings(st: Statistics) -> DataFrame:
    """Commands, odometry and localization of a whole recording held against each other: one row a recording."""
    pose, odom, command = "/localization/current_pose", "/odom", "/chassis_cmd_vel"
    pick = {
        "cmd": (command, "linear_x", "high"), "odom": (odom, "twist_linear_x", "high"), "x": (pose, "position_x", "std"), "y": (pose, "position_y", "std"),
        "p_low": (pose, "position_x", "low"), "p_high": (pose, "position_x", "high"), "o_low": (odom, "position_x", "low"), "o_high": (odom, "position_x", "high"),
    }
    stats = [F.max(F.when((F.col("topic") == t) & (F.col("field") == f), F.col(s))).alias(n) for n, (t, f, s) in pick.items()]
    there = [F.bool_or(F.col("topic") == t).alias(n) for n, t in (("has_cmd", command), ("has_odom", odom))]
    rows = st.fields.groupBy("bag").agg(*stats, *there)
    # a missing speed counts as 0, a missing place as none
    rows = rows.withColumns({"cmd": F.coalesce("cmd", F.lit(0.0)), "odom": F.coalesce("odom", F.lit(0.0)), "range": F.col("p_high") - F.col("p_low"), "o_range": F.col("o_high") - F.col("o_low")})
    both = F.col("has_cmd") & F.col("has_odom")
    speed = judged(rows, [
        (both & (F.col("cmd") > 0.01) & (F.col("odom") < 0.001), "CRITICAL", "CMD_ODOM_MISMATCH", "odom", "cmd"),
        (both & (F.col("cmd") < 0.001) & (F.col("odom") > 0.1), "WARNING", "UNEXPECTED_MOTION", "odom", "cmd"),
    ], topic=odom)
    place = judged(rows, [
        ((F.col("x") < 0.001) & (F.col("y") < 0.001), "WARNING", "LOCALIZATION_STUCK", "x", None),
        ((F.col("range") > 0.5) & (F.col("o_range") > 0.5) & (F.abs(F.col("range") / F.col("o_range") - 1) > 0.5), "WARNING", "ODOM_LOC_DIVERGENCE", "range", "o_range"),
    ], topic=pose)
    return speed.unionByName(place)


def of_stalls(st: Statistics) -> DataFrame:
    """Windows in which motion is commanded and none is seen; a window without odometry counts as none."""
    rows = st.windows.where("(topic = '/chassis_cmd_vel' and field = 'linear_x') or (topic = '/odom' and field = 'twist_linear_x')")
    own = rows.groupBy("bag", "w").agg(*[F.max(F.when(F.col("topic") == t, F.col(c))).alias(n) for n, t, c in (("mean", "/chassis_cmd_vel", "mean"), ("start_us", "/chassis_cmd_vel", "start_us"), ("seen", "/odom", "std"))])
    known = st.ends.where("topic = '/odom'").select("bag")
    hit = (F.col("mean") > 0.05) & (F.coalesce("seen", F.lit(0.0)) < 1e-6)
    return judged(own.join(known, "bag", "left_semi"), [(hit, "WARNING", "STALL_DETECTED", "mean", None)], ts="start_us", topic="/chassis_cmd_vel")


def of_lidars(st: Statistics) -> DataFrame:
    """Valid points that drop from one window to the next; windows without any count as 0."""
    own = F.col("topic").isin(*rules.LIDAR_TOPICS) & (F.col("field") == "num_valid_points")
    keys = ["bag", "topic", "field"]
    last = window_index(F.col("end_us"), F.col("start_us"), st.window_us)
    every = st.fields.where(own).select(*keys).join(st.bags, "bag").select(*keys, F.col("start_us").alias("t0"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("w"))
    dense = every.join(st.windows.where(own).select(*keys, "w", "mean"), [*keys, "w"], "left")
    dense = dense.withColumns({"mean": F.coalesce("mean", F.lit(0.0)), "start_us": F.col("t0") + F.col("w") * st.window_us})
    dense = dense.withColumn("before", F.lag("mean").over(Window.partitionBy("bag", "topic").orderBy("w")))  # a topic's windows of one recording
    return judged(dense, [((F.col("before") > 50) & (F.col("mean") < 0.3 * F.col("before")), "WARNING", "LIDAR_DEGRADATION", "mean", "before")], ts="start_us")


def of_texts(texts: DataFrame, first: int = 50) -> DataFrame:
    """Triggered protectors, from (bag, topic, ts_us, seq, text): of each the first messages, of which one is enough."""
    own = texts.where("topic = '/protector'").groupBy("bag", "topic").agg(F.slice(F.array_sort(F.collect_list(F.struct("ts_us", "seq", "text"))), 1, first).alias("m"))
    hits = F.size(F.filter("m", lambda x: F.coalesce(x["text"].contains("1"), F.lit(False))))
    return judged(own.select("bag", "topic", hits.alias("hits"), F.size("m").alias("every")), [(F.col("hits") > 0, "WARNING", "PROTECTOR_TRIGGERED", "hits", "every")])


#: The tables of rules, and the categories that each tells of.
TABLES: tuple[tuple[Callable[[Statistics], DataFrame], tuple[str, ...]], ...] = (
    (of_fields, ("ZERO_FIELD", "FROZEN_SENSOR", "IMU_FROZEN", "IMU_HIGH_VARIANCE", "HW_FAULT", "ODOM_HW_ERROR", "IMU_HW_FIELD_ZERO", "IMU_HW_FROZEN", "LIDAR_POINT_DROP", "SCRUBBER_NO_WATER", "IR_SENSOR_DEAD")),
    (of_windows, ("FREEZE_ONSET", "SENSOR_RESUME", "HW_FAULT_ONSET", "HW_FAULT_RECOVERED")),
    (of_rates, ("FREQUENCY_DROPOUT", "LIDAR_FREQ_DROPOUT", "UNSTABLE_FREQUENCY")),
    (of_recordings, ("CMD_ODOM_MISMATCH", "UNEXPECTED_MOTION", "LOCALIZATION_STUCK", "ODOM_LOC_DIVERGENCE")),
    (of_stalls, ("STALL_DETECTED",)),
    (of_lidars, ("LIDAR_DEGRADATION",)),
)


def findings(st: Statistics, texts: DataFrame | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """The findings of all rules, or those of some categories; only the statistics that they need are worked out."""
    parts = [table(st) for table, kinds in TABLES if only is None or set(kinds) & set(only)]
    if texts is not None and (only is None or "PROTECTOR_TRIGGERED" in only):
        parts.append(of_texts(texts))
    out = reduce(DataFrame.unionByName, parts)
    return out if only is None else out.where(F.col("category").isin(*only))


def anomalies(signals: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """All rules' findings in one table."""
    return findings(Statistics(signals), texts)


# What a category's finding is called; {0} is the topic and the field.
TITLES = {
    "ZERO_FIELD": "{0} is constantly 0.0", "FROZEN_SENSOR": "{0} frozen", "FREEZE_ONSET": "{0} froze", "SENSOR_RESUME": "{0} resumed", "FREQUENCY_DROPOUT": "{0} dropped in rate",
    "UNSTABLE_FREQUENCY": "{0} has unstable frequency", "CMD_ODOM_MISMATCH": "Commands were sent (cmd_vel.linear_x > 0) but odom shows no motion", "UNEXPECTED_MOTION": "No commands sent but odom shows motion",
    "STALL_DETECTED": "Commands active but odom frozen in window", "IMU_FROZEN": "IMU frozen: {0}", "IMU_HIGH_VARIANCE": "IMU Z-axis has very high variance", "LOCALIZATION_STUCK": "Localization position is not changing",
    "ODOM_LOC_DIVERGENCE": "Odometry and localization ranges differ significantly", "HW_FAULT": "{0} reports FAULT", "HW_FAULT_ONSET": "{0} went to FAULT", "HW_FAULT_RECOVERED": "{0} recovered", "ODOM_HW_ERROR": "{0} reported error",
    "IMU_HW_FIELD_ZERO": "{0} always 0 (sensor may be disabled)", "IMU_HW_FROZEN": "{0} frozen", "LIDAR_POINT_DROP": "{0} valid points dropped", "LIDAR_DEGRADATION": "{0} point count dropped", "LIDAR_FREQ_DROPOUT": "{0} dropped in rate",
    "SCRUBBER_NO_WATER": "Water level reached 0 during operation", "PROTECTOR_TRIGGERED": "Protector triggered", "IR_SENSOR_DEAD": "{0} always 0.0 - sensor may be disconnected",
}


def described(rows: DataFrame) -> DataFrame:
    """Adds description: the category's title with topic and field; numbers stay in value and expected."""
    title = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), F.col("category")), F.col("category"))
    return rows.withColumn("description", F.replace(title, F.lit("{0}"), F.concat_ws(".", "topic", "field")))


#: What the profiler tells of.
PROFILED = ("ZERO_FIELD", "FROZEN_SENSOR", "FREEZE_ONSET", "CMD_ODOM_MISMATCH", "HW_FAULT", "IMU_HW_FROZEN", "LIDAR_POINT_DROP", "IR_SENSOR_DEAD")


def profile(st: Statistics) -> DataFrame:
    """The profiler's findings: fewer rules, names of its own, and a rate that varies by .3 of its mean."""
    named = F.create_map(*[F.lit(x) for x in ("FREQUENCY_DROPOUT", "FREQ_DROPOUT", "UNSTABLE_FREQUENCY", "UNSTABLE_FREQ")])
    rates = of_rates(st, unstable=0.3).where("category <> 'LIDAR_FREQ_DROPOUT'")
    return findings(st, only=PROFILED).unionByName(rates.withColumn("category", F.try_element_at(named, F.col("category"))))


def profiler_summary(findings: DataFrame, bags: DataFrame, abnormal: DataFrame) -> DataFrame:
    """(bag, critical, warnings, logs, types, health) of every recording; abnormal: (bag, ..) a row an abnormal log or status event."""
    critical = F.col("category").isin(*rules.PROFILER_CRITICAL)
    by = findings.groupBy("bag", "category").agg(F.count("*").alias("n"))
    own = by.groupBy("bag").agg(
        F.sum(F.when(critical, F.col("n")).otherwise(0)).alias("critical"), F.sum(F.when(critical, 0).otherwise(F.col("n"))).alias("warnings"),
        F.array_join(F.array_sort(F.collect_list(F.concat("category", F.lit(":"), F.col("n").cast("string")))), ", ").alias("types"),
    )
    logs = abnormal.groupBy("bag").agg(F.count("*").alias("logs"))
    zero = F.lit(0).cast("bigint")
    out = bags.select("bag").join(own, "bag", "left").join(logs, "bag", "left").withColumns({c: F.coalesce(c, zero) for c in ("critical", "warnings", "logs")}).withColumn("types", F.coalesce("types", F.lit("")))
    health = F.expr("CASE WHEN critical > 0 OR logs > 20 THEN 'PROBLEMATIC' WHEN warnings > 3 OR logs > 5 THEN 'DEGRADED' WHEN warnings > 0 OR logs > 0 THEN 'MARGINAL' ELSE 'HEALTHY' END")
    return out.select("bag", "critical", "warnings", "logs", "types", health.alias("health"))


def validation(st: Statistics) -> DataFrame:
    """(bag, type, topic, field, ts_us, value): the validator's checks of every topic: frozen fields and windows, and drops in rate."""
    none = F.lit(None)
    still = st.fields.where((F.col("std") < 1e-6) & (F.col("n") > FROZEN_FROM)).select("bag", F.lit("frozen_sensor").alias("type"), "topic", "field", none.cast("bigint").alias("ts_us"), F.col("mean").alias("value"))
    windows = st.windows.where((F.col("std") < 1e-6) & (F.col("n") > FAULT_FROM) & ~F.col("field").isin(*rules.WINDOW_MAY_FREEZE))
    windows = windows.select("bag", F.lit("frozen_window").alias("type"), "topic", "field", F.col("start_us").alias("ts_us"), F.col("mean").alias("value"))
    # without the guard at the recording's end
    low = T.dropouts(st.bins, st.bags, st.bin_us, margin_us=-(1 << 60)).select("bag", F.lit("frequency_dropout").alias("type"), "topic", none.cast("string").alias("field"), F.col("start_us").alias("ts_us"), F.col("hz").alias("value"))
    return still.unionByName(windows).unionByName(low)


def evidence(st: Statistics) -> DataFrame:
    """(bag, kind, topic, field, ts_us, value): what an agent's tools put on record: FROZEN, FREQUENCY DROP, UNSTABLE FREQUENCY."""
    none = F.lit(None)
    still = st.fields.where((F.col("std") < 1e-6) & (F.col("n") > FROZEN_FROM)).select("bag", F.lit("FROZEN").alias("kind"), "topic", "field", none.cast("bigint").alias("ts_us"), F.col("mean").alias("value"))
    low = T.dropouts(st.bins, st.bags, st.bin_us, margin_us=-(1 << 60)).select("bag", F.lit("FREQUENCY DROP").alias("kind"), "topic", none.cast("string").alias("field"), F.col("start_us").alias("ts_us"), F.col("hz").alias("value"))
    uneven = T.frequency(st.bins).where("std_hz > 0.3 * mean_hz").select("bag", F.lit("UNSTABLE FREQUENCY").alias("kind"), "topic", none.cast("string").alias("field"), none.cast("bigint").alias("ts_us"), F.col("std_hz").alias("value"))
    return still.unionByName(low).unionByName(uneven)
