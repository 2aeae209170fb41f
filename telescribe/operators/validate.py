"""Cross-validation: what log texts claim, held against a snapshot of the sensors at the time of the text.

A snapshot holds, for each topic, the statistics of all its fields in the window whose middle lies nearest. A claim may look
at several fields, and at a second topic or field where the first has nothing to say.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telescribe.operators import incidents as I
from telescribe.operators import logs as L
from telescribe.operators import packets as P
from telescribe.operators import telemetry as T
from telescribe.operators.relational import numbered
from telescribe.operators.scratch import checkpointed, discard
from telescribe.plans import rules

NONE, YES, NO = "NO_SENSOR_DATA", "CONFIRMED", "CONTRADICTED"


def windows(signals: DataFrame, width_us: int = rules.SNAPSHOT_US, topics: tuple[str, ...] = rules.SNAPSHOT_TOPICS) -> DataFrame:
    """(bag, topic, start_us, end_us, fields) of every window of a recording, those without messages, too; fields: by name
    their n, mean and std. A field without finite values in a window has n 0 there, one without messages is not in it."""
    rows = T.field_statistics(signals.where(F.col("topic").isin(*topics)), width_us)
    one = F.when(F.col("field").isNotNull(), F.struct("field", F.struct("n", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"))))
    return rows.groupBy("bag", "topic", "start_us", "end_us").agg(F.map_from_entries(F.array_sort(F.collect_list(one))).alias("fields"))


def snapshots(probes: DataFrame, own: DataFrame, width_us: int = rules.SNAPSHOT_US) -> DataFrame:
    """(bag, seq, sensors): for each probe (bag, seq, ts_us) its topics' fields in the nearest windows; topics without any
    are left out. own: windows(). Middles two widths away or further do not count; of equally near ones the first does."""
    met = L.nearest_windows(probes.select("bag", "seq", "ts_us"), own, width_us, ["bag"]).where(F.size("fields") > 0)
    return met.groupBy("bag", "seq").agg(F.map_from_entries(F.collect_list(F.struct("topic", "fields"))).alias("sensors"))


def _stat(topic: Column | str, field: str, what: str) -> Column:
    fields = F.try_element_at("sensors", F.lit(topic)) if isinstance(topic, str) else topic
    return F.try_element_at(fields, F.lit(field))[what]


def _either(first: str, second: str) -> Column:
    """The fields of a topic, or of a second one where the snapshot lacks the first."""
    return F.coalesce(F.try_element_at("sensors", F.lit(first)), F.try_element_at("sensors", F.lit(second)))


def _text(form: str, *values: Column) -> Column:
    return F.format_string(form, *[F.coalesce(v, F.lit(0.0)) for v in values])


#: A check: verdict and detail of a snapshot.
Check = tuple[Column, Column]


def _case(*arms: tuple[Column, str, Column | str], other: tuple[str, Column | str]) -> Check:
    """The first arm (condition, verdict, detail) that holds, else the other."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    out = []
    for i in (1, 2):
        chain = reduce(lambda c, arm: (F.when if c is None else c.when)(F.coalesce(arm[0], F.lit(False)), as_column(arm[i])), arms, None)
        out.append(chain.otherwise(as_column(other[i - 1])))
    return out[0], out[1]


def zero_velocity() -> Check:
    n, lx, az = (_stat("/odom", f, w) for f, w in (("twist_linear_x", "n"), ("twist_linear_x", "mean"), ("twist_angular_z", "mean")))
    lx, az = F.abs(lx), F.abs(F.coalesce(az, F.lit(0.0)))
    return _case((n.isNull(), NONE, "No /odom twist data in window"), ((lx < 0.01) & (az < 0.01), YES, _text("Velocity near zero (linear=%.4f, angular=%.4f)", lx, az)), other=(NO, _text("Velocity NOT zero (linear=%.4f, angular=%.4f)", lx, az)))


def odom_frozen() -> Check:
    n, std = (_stat("/odom", "twist_linear_x", w) for w in ("n", "std"))
    return _case(
        (F.coalesce(n, F.lit(0)) < 2, NONE, "Insufficient /odom data in window"), (std < 1e-4, YES, _text("Odom twist frozen (std=%.6f) — consistent with still_flag=1", std)),
        other=(NO, _text("Odom twist NOT frozen (std=%.6f) — robot may be moving despite still_flag=1", std)),
    )


def odom_active() -> Check:
    n, std, mean = (_stat("/odom", "twist_linear_x", w) for w in ("n", "std", "mean"))
    mean = F.abs(mean)
    return _case(
        (F.coalesce(n, F.lit(0)) < 2, NONE, "Insufficient /odom data in window"), ((std > 1e-4) | (mean > 0.01), YES, _text("Odom active (mean=%.4f, std=%.6f) — consistent with still_flag=0", mean, std)),
        other=(NO, _text("Odom appears frozen (mean=%.4f, std=%.6f) — robot not moving despite still_flag=0", mean, std)),
    )


def pose_frozen() -> Check:
    pose = "/localization/current_pose"
    n, x, y = _stat(pose, "position_x", "n"), _stat(pose, "position_x", "std"), F.coalesce(_stat(pose, "position_y", "std"), F.lit(0.0))
    return _case((F.coalesce(n, F.lit(0)) < 2, NONE, "Insufficient localization data in window"), ((x < 1e-4) & (y < 1e-4), YES, _text("Pose frozen (std_x=%.6f, std_y=%.6f)", x, y)), other=(NO, _text("Pose changing (std_x=%.6f, std_y=%.6f)", x, y)))


def imu_frozen() -> Check:
    """The first axis with two values or more decides."""
    imu = _either("/unbiased_imu_PRY", "/device/imu_data")
    arms = [(imu.isNull(), NONE, F.lit("No IMU data in window"))]
    for axis in rules.IMU_AXES:
        n, std = _stat(imu, axis, "n"), _stat(imu, axis, "std")
        arms += [((n >= 2) & (std < 1e-4), YES, _text(f"IMU {axis} frozen (std=%.6f)", std)), (n >= 2, NO, _text(f"IMU {axis} active (std=%.6f)", std))]
    return _case(*arms, other=(NONE, "No usable IMU fields in window"))


def zero_command() -> Check:
    own = _either("/chassis_cmd_vel", "/cmd_vel")
    n, mean = _stat(own, "linear_x", "n"), F.abs(_stat(own, "linear_x", "mean"))
    return _case((n.isNull(), NONE, "No cmd_vel data in window"), (mean < 0.01, YES, _text("cmd_vel suppressed (mean=%.4f)", mean)), other=(NO, _text("cmd_vel NOT suppressed (mean=%.4f)", mean)))


#: The check of each rule.
CHECKS = {
    "path_planning_failed_check_velocity": zero_velocity, "still_flag_check_odom": odom_frozen, "still_flag_moving_check_odom": odom_active, "localization_lost_check_pose": pose_frozen,
    "imu_calibrating_check_imu": imu_frozen, "not_moving_check_velocity": zero_velocity, "cmd_not_safe_check_cmd_vel": zero_command,
}


def checked(events: DataFrame, snaps: DataFrame) -> DataFrame:
    """events (bag, seq, raw_message, ..) with checks (rule, description, verdict, detail of each claim), verdict and confidence.

    A contradiction decides, then whether all claims are confirmed or some; without a claim the event is UNCHECKED. An event
    without a snapshot has no sensor data.
    """
    rows = events.join(snaps, ["bag", "seq"], "left")
    claims = []
    for pattern, rule, *_ in rules.CHECKS:
        verdict, detail = CHECKS[rule]()
        nothing = F.col("sensors").isNull()
        one = F.struct(F.lit(rule).alias("rule"), F.lit(rules.CLAIMS[rule]).alias("description"), F.when(nothing, NONE).otherwise(verdict).alias("verdict"), F.when(nothing, "No sensor data available").otherwise(detail).alias("detail"))
        claims.append(F.when(F.col("raw_message").rlike(f"(?i){pattern}"), one))
    rows = rows.withColumn("checks", F.array_compact(F.array(*claims)))
    some = lambda v: F.exists("checks", lambda c: c["verdict"] == v)
    verdict = F.when(F.size("checks") == 0, "UNCHECKED").when(some(NO), NO).when(some(YES), YES).otherwise(NONE)
    sure = F.when(some(NO), 0.9).when((F.size("checks") > 0) & F.forall("checks", lambda c: c["verdict"] == YES), 0.8).when(some(YES), 0.6).otherwise(0.0)
    return rows.withColumns({"verdict": verdict, "confidence": sure})


@dataclass(frozen=True)
class Validation:
    """packets: one row a packet of evidence; routes: log rows by route; states: what held how long."""

    packets: DataFrame
    routes: DataFrame
    states: DataFrame


def cross_validated(signals: DataFrame, logs: DataFrame, width_us: int = rules.SNAPSHOT_US, sample: int = 1, sensors: bool = True) -> Validation:
    """The evidence packets of recordings' log rows, in order of time.

    packets: packet_id, bag, ts_us, node, level, message (500 characters), event_type, dedup_count, first_us, last_us,
    robot_state, category, severity, sensors, checks, verdict, confidence, summary. logs: messages.logs(). Rows are
    denoised over all recordings. An event is held against sensors if it is an error or makes a claim; of these every
    sample-th, the first included, and none without sensors. A log row of a recording without signals is looked up in
    the first recording that has any.
    """
    every = checkpointed(numbered(L.classified(logs).withColumnRenamed("seq", "place"), ["ts_us", "bag", "place"], "seq"))
    routes = checkpointed(L.routed(every).groupBy("route").agg(F.count("*").alias("n")))
    events = numbered(P.denoised(every), ["ts_us", "seq"], "number")
    events = P.classified(events).withColumns({"packet_id": F.format_string("EP-%04d", F.col("number") + 1)})
    events = checkpointed(events)
    due = P.every_nth(events.where("wants_sensors"), sample).select("seq") if sensors else events.select("seq").limit(0)
    known = signals.select("bag").distinct()
    first = known.agg(F.min("bag").alias("_first"))
    probes = events.join(due, "seq", "left_semi").select(F.col("bag").alias("_own"), "seq", "ts_us")
    probes = probes.join(known.withColumn("_own", F.col("bag")), "_own", "left").join(F.broadcast(first)).select(F.coalesce("bag", "_first").alias("bag"), "seq", "ts_us", "_own")
    snaps = snapshots(probes, windows(signals, width_us), width_us).join(probes.select("seq", F.col("_own").alias("own")), "seq").select(F.col("own").alias("bag"), "seq", "sensors")
    held = checked(events.join(due, "seq", "left_semi"), snaps)
    rest = events.join(due, "seq", "left_anti").withColumns({"sensors": F.lit(None).cast(held.schema["sensors"].dataType), "checks": F.array().cast(held.schema["checks"].dataType), "verdict": F.lit("UNCHECKED"), "confidence": F.lit(0.0)})
    # one timeline of states over all recordings
    changes = checkpointed(L.state_changes(every.withColumn("bag", F.lit("")), ("bag",)))
    points = events.select(F.lit("").alias("bag"), F.col("seq").alias("key"), F.col("ts_us").alias("at_us"))
    states = I.state_at(points, changes).groupBy(F.col("key").alias("seq")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "value")))).alias("robot_state"))
    out = held.unionByName(rest).join(states, "seq", "left")
    out = out.withColumn("summary", summary())
    packets = checkpointed(out.select("packet_id", "bag", "ts_us", "node", "level", F.substring("raw_message", 1, 500).alias("message"), F.col("log_event").alias("event_type"), "dedup_count", "first_us", "last_us", "robot_state", "category", "severity", "sensors", "checks", "verdict", "confidence", "summary"))
    found = Validation(packets, routes, checkpointed(L.state_summary(changes)))
    discard(every, events, changes)
    return found


def summary() -> Column:
    """A packet in a few lines: the text, what bears it out or speaks against it, and the robot's state."""
    head = F.concat(F.lit("["), L.level_name(F.col("level")), F.lit("] ["), F.col("node"), F.lit("] "), F.substring("raw_message", 1, 120))
    again = F.format_string(" (repeated %dx over %.1fs)", F.col("dedup_count"), (F.col("last_us") - F.col("first_us")) / 1e6)
    head = F.concat(head, F.when(F.col("dedup_count") > 1, again).otherwise(""))
    hit = F.filter("checks", lambda c: c["verdict"] == F.col("verdict"))
    why = F.when(F.col("verdict").isin(YES, NO) & (F.size(hit) > 0), F.concat(F.lit("  -> "), F.col("verdict"), F.lit(" by sensor: "), hit[0]["detail"]))
    states = F.array_join(F.transform(F.map_entries("robot_state"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    state = F.when(F.size("robot_state") > 0, F.concat(F.lit("  -> State: "), states))
    return F.concat_ws("\n", head, why, state)


def contradictions(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("verdict") == NO)


def confirmed(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("verdict") == YES)


def by_severity(packets: DataFrame, severity: str) -> DataFrame:
    return packets.where(F.col("severity") == severity)
