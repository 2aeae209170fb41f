"""Telemetry, log and bag views of the driver's events table; for each view also the SQL that DuckDB reads it with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telescribe.functions.text import chosen, settled

START_US, DAY_US = 1704067200000000, 86400000000
#: Message texts by remainder of k; {0} is the event's number.
TEXTS = (
    ("still_flag: ", "seq % 2"), ("navigation module stuck at 35", None), ("imu calibrating offset", None), ("localization lost near dock", None),
    ("localization_status ", "seq % 3"), ("TFAutoAdapt1 update", None), ("recieve 3 ssd bounding boxes", None), ("battery level: 57", None),
    ("[overdark] Time: 12.5", None), ("MakePlan fail for goal", None), ("cmd not safe", None), ("heartbeat ok seq ", "seq"),
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts_us, bag (day), user_id, topic, value, k."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"), ts.alias("ts_us"), F.floor((ts - START_US) / DAY_US).cast("bigint").alias("bag"), "user_id",
        F.concat(F.lit("/"), "event_type").alias("topic"), "value", F.regexp_extract("props", r"(-?\d+)", 1).cast("bigint").alias("k"), "props",
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with node, level and raw_message."""
    full = [F.lit(text) if tail is None else F.concat(F.lit(text), F.expr(tail).cast("string"), F.lit(" code 0x1F" if tail == "seq" else "")) for text, tail in TEXTS]
    message = chosen([(F.col("k") % 12 == i, x) for i, x in enumerate(full)])
    level = F.when(F.col("topic") == "/error", 8).when(F.col("topic") == "/signup", 4).otherwise(2)
    node = F.concat(F.lit("/node_"), (F.col("user_id") % 13).cast("string"))
    return settled(settled(events(spark, sf_dir), k=F.col("k")), node=node, level=level, raw_message=message)


# Stand-ins for a robot's signals: (event topic, robot topic, field, value of the event's value and recording).
FEEDS = (
    ("/click", "/chassis_cmd_vel", "linear_x", "CASE WHEN bag % 7 = 3 THEN 0.0 WHEN bag % 7 = 5 THEN 0.5 ELSE value / 100 END"),
    ("/click", "/chassis_cmd_vel", "angular_z", "CASE WHEN bag % 3 = 0 THEN 0.25 ELSE value / 50 END"),
    ("/click", "/chassis_cmd_vel", "linear_y", "0.0"),
    ("/view", "/odom", "twist_linear_x", "CASE WHEN bag % 7 = 4 THEN 0.0 ELSE value / 100 END"),
    ("/view", "/odom", "twist_angular_z", "CASE WHEN bag % 5 = 1 THEN 0.0 ELSE value / 10 END"),
    ("/view", "/odom", "twist_linear_y", "0.0"),
    ("/view", "/odom", "position_x", "value"),
    ("/purchase", "/localization/current_pose", "position_x", "CASE WHEN bag % 5 = 2 THEN 1.5 ELSE value * 3 END"),
    ("/purchase", "/localization/current_pose", "position_y", "CASE WHEN bag % 5 = 2 THEN 2.5 ELSE value END"),
    ("/purchase", "/front_end_pose", "position_x", "CASE WHEN (ts_us % 86400000000 >= 43200000000) = (bag % 2 = 0) THEN 4.0 ELSE value END"),
    ("/purchase", "/raw_scan", "num_valid_points", "CASE WHEN value > 90 THEN 10.0 * value ELSE 4.0 * value END"),
    ("/signup", "/device/health_status", "imu_board", "CASE WHEN value < 50 THEN 0.0 ELSE 1.0 END"),
    ("/signup", "/device/health_status", "spare_flag", "0.0"),
    ("/signup", "/device/odom_status", "left_error", "CASE WHEN value < 10 THEN 0.0 ELSE 1.0 END"),
    ("/signup", "/device/scrubber_status", "water_level", "CASE WHEN bag % 4 = 2 AND value < 20 THEN 0.0 ELSE value END"),
    ("/error", "/unbiased_imu_PRY", "x", "CASE WHEN bag % 4 = 1 THEN 12.0 ELSE value END"),
    ("/error", "/unbiased_imu_PRY", "z", "value * 10"),
    ("/error", "/device/imu_data", "magnetic_x", "CASE WHEN bag % 2 = 0 THEN 0.0 ELSE value END"),
    ("/error", "/device/imu_data", "accel_x", "CASE WHEN bag % 3 = 0 THEN 3.0 ELSE value END"),
    ("/error", "/ir_sticker3", "data", "CASE WHEN bag % 6 = 5 THEN 0.0 ELSE value END"),
)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bag, topic, field, seq, ts_us, value: the events as fields of a robot's topics."""
    rows = [F.struct(F.lit(e).alias("of"), F.lit(t).alias("topic"), F.lit(f).alias("field"), F.expr(x).cast("double").alias("value")) for e, t, f, x in FEEDS]
    each = events(spark, sf_dir).select("bag", "seq", "ts_us", F.col("topic").alias("own"), F.explode(F.array(*rows)).alias("x"))
    return each.where("own = x.of").select("bag", "x.topic", "x.field", "seq", "ts_us", "x.value")


SIGNALS_SQL = "sg AS (" + " UNION ALL ".join(f"SELECT bag, '{t}' AS topic, '{f}' AS field, seq, ts_us, ({x})::DOUBLE AS value FROM ev WHERE topic = '{e}'" for e, t, f, x in FEEDS) + ")"


EVENTS_SQL = rf"""ev AS (SELECT event_id AS seq, epoch_us(ts) AS ts_us, (epoch_us(ts) - {START_US}) // {DAY_US} AS bag, user_id,
 '/' || event_type AS topic, value, regexp_extract(props, '(-?\d+)', 1)::BIGINT AS k, props FROM events)"""
LOGS_SQL = f"""{EVENTS_SQL}, lg AS (SELECT *, '/node_' || (user_id % 13) AS node, CASE topic WHEN '/error' THEN 8 WHEN '/signup' THEN 4 ELSE 2 END AS level,
 CASE k % 12 {" ".join(f"WHEN {i} THEN '{t}'" + (f" || ({x})" if x else "") + (" || ' code 0x1F'" if x == "seq" else "") for i, (t, x) in enumerate(TEXTS))} END AS raw_message FROM ev)"""
