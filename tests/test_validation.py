"""Snapshots of several fields, the checks of claims, and a cross-validation of recordings from end to end."""

import json
import struct
import sys

import pytest
from pyspark.sql import functions as F

from telescribe import __main__ as cli
from telescribe import analysis
from telescribe.operators import relational
from telescribe.operators import validate as X
from telescribe.sinks import reports

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_recordings import LOG, TWIST, bag, connection, log, message, twist  # noqa: E402

SIGNALS = "bag string, topic string, field string, seq long, ts_us long, value double"
EVENTS = "bag string, seq long, ts_us long, raw_message string"


def verdicts(spark, signals, texts, at=1_000_000):
    rows = [("b", t, f, i, ts, v) for i, (t, f, ts, v) in enumerate(signals)] or [("b", "/other", "x", 0, 0, 0.0)]
    events = spark.createDataFrame([("b", i, at, t) for i, t in enumerate(texts)], EVENTS)
    snaps = X.snapshots(events, X.windows(spark.createDataFrame(rows, SIGNALS)))
    return [[(c.verdict, c.detail) for c in r.checks] for r in X.checked(events, snaps).orderBy("seq").collect()]


def test_two_fields_decide(spark):
    still = [("/odom", f, ts, 0.0) for ts in (0, 900_000, 1_500_000) for f in ("twist_linear_x", "twist_angular_z")]
    turning = [(t, f, ts, 0.5 if f == "twist_angular_z" else v) for t, f, ts, v in still]
    assert verdicts(spark, still, ["MakePlan fail"]) == [[("CONFIRMED", "Velocity near zero (linear=0.0000, angular=0.0000)")]]
    assert verdicts(spark, turning, ["MakePlan fail"]) == [[("CONTRADICTED", "Velocity NOT zero (linear=0.0000, angular=0.5000)")]]
    # a missing turn counts as none
    assert verdicts(spark, still[::2], ["not move time: 3"])[0][0][0] == "CONFIRMED"
    pose = [("/localization/current_pose", f, ts, 1.0 + (ts if f == "position_y" else 0)) for ts in (0, 900_000) for f in ("position_x", "position_y")]
    assert verdicts(spark, pose, ["localization lost"])[0][0][0] == "CONTRADICTED" and verdicts(spark, pose[::2], ["localization lost"])[0][0][0] == "CONFIRMED"


def test_fall_backs_in_order(spark):
    device = [("/device/imu_data", "pitch_angle", ts, 1.0) for ts in (0, 900_000)]
    assert verdicts(spark, device, ["imu calibrating"]) == [[("CONFIRMED", "IMU pitch_angle frozen (std=0.000000)")]]
    first = [("/unbiased_imu_PRY", f, ts, float(ts) if f == "x" else 2.0) for ts in (0, 900_000) for f in ("x", "y")]
    # the first topic decides, and of its axes z before x before y; z with one value says nothing
    assert verdicts(spark, device + first + [("/unbiased_imu_PRY", "z", 0, 1.0)], ["imu calibrating"])[0][0][0] == "CONTRADICTED"
    assert verdicts(spark, device + [("/unbiased_imu_PRY", "other", 0, 1.0)], ["imu calibrating"]) == [[("NO_SENSOR_DATA", "No usable IMU fields in window")]]
    assert verdicts(spark, [("/cmd_vel", "linear_x", 0, 0.0)], ["cmd not safe"]) == [[("CONFIRMED", "cmd_vel suppressed (mean=0.0000)")]]
    assert verdicts(spark, [("/cmd_vel", "linear_x", 0, 0.0), ("/chassis_cmd_vel", "linear_x", 0, 0.4)], ["cmd not safe"])[0][0][0] == "CONTRADICTED"
    assert verdicts(spark, [("/cmd_vel", "linear_x", 0, 0.0), ("/chassis_cmd_vel", "linear_y", 0, 0.4)], ["cmd not safe"]) == [[("NO_SENSOR_DATA", "No cmd_vel data in window")]]


def test_no_data(spark):
    assert verdicts(spark, [], ["still_flag: 1", "hello"]) == [[("NO_SENSOR_DATA", "No sensor data available")], []]
    one = [("/odom", "twist_linear_x", 0, 1.0)]
    assert verdicts(spark, one, ["still_flag: 0"]) == [[("NO_SENSOR_DATA", "Insufficient /odom data in window")]]
    # a window without messages is nearest, so its topic has nothing to say
    far = [("/odom", "twist_linear_x", ts, 0.0) for ts in (0, 100_000, 9_000_000, 9_100_000)]
    assert verdicts(spark, far, ["still_flag: 1"], at=5_000_000)[0][0][0] == "NO_SENSOR_DATA" and verdicts(spark, far, ["still_flag: 1"])[0][0][0] == "CONFIRMED"


def test_several_claims(spark):
    rows = [("/odom", "twist_linear_x", ts, 0.0) for ts in (0, 900_000)] + [("/cmd_vel", "linear_x", 0, 1.0)]
    events = spark.createDataFrame([("b", 0, 1, "MakePlan fail, cmd not safe"), ("b", 1, 1, "MakePlan fail, imu calibrating"), ("b", 2, 1, "MakePlan fail"), ("b", 3, 1, "")], EVENTS)
    signals = spark.createDataFrame([("b", t, f, i, ts, v) for i, (t, f, ts, v) in enumerate(rows)], SIGNALS)
    got = {r.seq: (r.verdict, r.confidence) for r in X.checked(events, X.snapshots(events, X.windows(signals))).collect()}
    assert got == {0: ("CONTRADICTED", 0.9), 1: ("CONFIRMED", 0.6), 2: ("CONFIRMED", 0.8), 3: ("UNCHECKED", 0.0)}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("validated")
    head = connection(0, "/cmd_vel", "geometry_msgs/Twist", TWIST) + connection(1, "/rosout", "rosgraph_msgs/Log", LOG)
    for name, start, speed in (("a.bag", 1000, 0.0), ("b.bag", 5000, 0.7)):
        chunk = head + b"".join(message(0, start + i * 0.5, twist(speed)) for i in range(60))
        chunk += b"".join(message(1, start + 5 + i, log(2, "/n", f"localization_status {i % 2}")) for i in range(12))
        chunk += message(1, start + 10, log(4, "/nav", "cmd not safe")) + message(1, start + 11, log(8, "/nav", "motor fault " + "x" * 700)) + message(1, start + 12, log(2, "/nav", "still_flag: 1")) + message(1, start + 13, log(2, "/nav", "heartbeat"))
        (out / name).write_bytes(bag([("none", chunk)]))
    return str(out)


def test_recordings(spark, folder):
    found = analysis.validate(spark, folder)
    rows = {(r.bag, r.message[:12]): r for r in found.packets.collect()}
    assert sorted(r.packet_id for r in rows.values()) == [f"EP-{i:04d}" for i in range(1, len(rows) + 1)]
    safe = [rows[b, "cmd not safe"] for b in ("a.bag", "b.bag")]
    assert [(r.verdict, r.confidence, r.checks[0].detail) for r in safe] == [("CONFIRMED", 0.8, "cmd_vel suppressed (mean=0.0000)"), ("CONTRADICTED", 0.9, "cmd_vel NOT suppressed (mean=0.7000)")]
    assert safe[1].sensors["/cmd_vel"]["linear_x"].n > 1 and safe[1].summary.startswith("[WARN] [/nav] cmd not safe\n  -> CONTRADICTED by sensor: cmd_vel NOT")
    fault = rows["a.bag", "motor fault "]
    assert (fault.severity, fault.category, fault.verdict, len(fault.message)) == ("CRITICAL", "ERROR", "UNCHECKED", 500)
    flag = rows["b.bag", "still_flag: "]
    assert flag.verdict == "NO_SENSOR_DATA" and flag.robot_state["motion_state.still_flag"] == "1"
    group = [r for r in rows.values() if r.dedup_count > 1]
    assert [(r.dedup_count, r.first_us, r.last_us) for r in group] == [(24, 1005 * 10**6, 5016 * 10**6)] and "(repeated 24x over 4011.0s)" in group[0].summary
    assert X.contradictions(found.packets).count() == 1 and X.confirmed(found.packets).count() == 1 and X.by_severity(found.packets, "CRITICAL").count() == 2
    report = reports.validation_report(found.packets, found.routes, found.states)
    assert report["stats"]["raw_log_events"] == 32 and report["denoise_stats"]["deduped"] == 24 and sum(report["stats"]["verdicts"].values()) == len(rows)
    assert report["state_timeline_summary"]["motion_state.still_flag"]["current_value"] == "1"
    text = reports.validation_text(report, found.packets)
    assert text.startswith("Cross-Validation Report: 2 bags, 32 raw logs") and "=== CONTRADICTIONS (1) ===" in text and text.count("motor fault") == 2


def test_sampling_and_no_sensors(spark, folder):
    every = analysis.validate(spark, folder).packets
    some, none = (analysis.validate(spark, folder, **k).packets for k in ({"sample": 4}, {"sensors": False}))
    wanting = [r.packet_id for r in every.where("size(checks) > 0 or level >= 8").orderBy("packet_id").collect()]
    checked = {r.packet_id for r in some.where("size(checks) > 0 or sensors is not null").collect()}
    assert checked and checked <= set(wanting[::4]) and some.count() == every.count()
    assert {r.verdict for r in none.collect()} == {"UNCHECKED"}


def test_command_line(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(sys, "argv", ["telescribe", "crossval", folder, str(tmp_path / "out")])
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    cli.main()
    report = json.loads("\n".join(p.read_text() for p in (tmp_path / "out" / "report").glob("part-*")))
    assert report["stats"]["total_bags"] == 2
    assert spark.read.json(str(tmp_path / "out" / "evidence_packets")).where("verdict = 'CONTRADICTED'").count() == 1
    assert "Verdicts: CONFIRMED=1" in "\n".join(p.read_text() for p in (tmp_path / "out" / "summary").glob("part-*"))


def test_numbers(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("y")).repartition(7)
    got = relational.numbered(df, ["y", F.desc("x")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [(r.y, -r.x) for r in got] == sorted((r.y, -r.x) for r in got)
    assert relational.numbered(df.limit(0), ["x"], "n").count() == 0


def test_clock():
    assert [reports.clock(x) for x in (0, 59_999.9996, 3_599_999.6, 86_399_500.0)] == ["00:00:00.000", "00:01:00.000", "01:00:00.000", "23:59:59.500"]
