"""Recordings byte by byte, their fields, text logs, rules files, reports, streams and whole analyses."""

import bz2
import json
import math
import struct
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from telescribe import __main__ as cli
from telescribe import analysis
from telescribe.operators import diagnose, values
from telescribe.sinks import layouts, reports
from telescribe.sources import catalog, messages, recording, text_log
from telescribe.streaming import telemetry as streams

TWIST = "Vector3 linear\nVector3 angular\n" + "=" * 80 + "\nMSG: geometry_msgs/Vector3\nfloat64 x\nfloat64 y\nfloat64 z\n"
LOG = "byte DEBUG=1\nHeader header\nbyte level\nstring name\nstring msg # text\nstring file\nstring function\nuint32 line\nstring[] topics\n" + "=" * 80 + "\nMSG: std_msgs/Header\nuint32 seq\ntime stamp\nstring frame_id\n"
SCAN = "float32 range_min\nfloat32 range_max\nfloat32[] ranges"
STATUS = "byte level\nstring name\nKeyValue[] values\n===\nMSG: diagnostic_msgs/KeyValue\nstring key\nstring value"
OTHER = "int16 a\nbool b\nuint8[3] c\nfloat32[] d\nstring e"


def text(s):
    return struct.pack("<I", len(s.encode())) + s.encode()


def header(**fields):
    out = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in fields.items())
    return struct.pack("<I", len(out)) + out


def record(data, **fields):
    return header(**fields) + struct.pack("<I", len(data)) + data


def connection(i, topic, kind, definition):
    more = header(type=kind.encode(), md5sum=b"x", message_definition=definition.encode(), callerid=b"/n", latching=b"1")[4:]
    return record(more, op=b"\x07", conn=struct.pack("<I", i), topic=topic.encode())


def message(i, at, raw):
    return record(raw, op=b"\x02", conn=struct.pack("<I", i), time=struct.pack("<II", int(at), round(at % 1 * 1e9)))


def bag(chunks, index=4096):
    out = b"#ROSBAG V2.0\n" + record(b" " * 100, op=b"\x03", index_pos=struct.pack("<Q", index), conn_count=struct.pack("<I", 1), chunk_count=struct.pack("<I", 1))
    for name, data in chunks:
        packed = bz2.compress(data) if name == "bz2" else data
        out += record(packed, op=b"\x05", compression=name.encode(), size=struct.pack("<I", len(data))) + record(b"zz", op=b"\x04")
    return out


def twist(x, z=0.0):
    return struct.pack("<6d", x, 0, 0, 0, 0, z)


def log(level, name, msg):
    return struct.pack("<III", 1, 2, 3) + text("") + struct.pack("<b", level) + text(name) + text(msg) + text("f.cpp") + text("go") + struct.pack("<I", 7) + struct.pack("<I", 1) + text("/t")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("bags")
    head = connection(0, "/chassis_cmd_vel", "geometry_msgs/Twist", TWIST) + connection(1, "/rosout", "rosgraph_msgs/Log", LOG) + connection(2, "/odom", "geometry_msgs/Twist", TWIST)
    first = head + b"".join(message(0, 1000 + i, twist(0.5 + i % 3, 0.25)) for i in range(60)) + message(1, 1010, log(8, "nav", "navigation module stuck at 35")) + message(1, 1011, log(1, "/nav", "debug"))
    second = head + b"".join(message(2, 1100 + i, twist(0.0)) for i in range(40)) + message(1, 1105, log(4, "/m", "still_flag: 1")) + message(9, 1200, b"")
    (out / "a.bag").write_bytes(bag([("none", first), ("bz2", second), ("bz2", b"")], 1 << 40))
    broken = record(b"no bz2", op=b"\x05", compression=b"bz2", size=struct.pack("<I", 9))
    (out / "b.bag").write_bytes(bag([("none", head + message(0, 9000, twist(1)))], 0) + broken + record(head + message(0, 9001, twist(2)), op=b"\x05", compression=b"none", size=b"\0\0\0\0") + b"\x10\0\0\0cut")
    (out / "c.bag").write_bytes(b"no recording")
    return str(out)


def test_reader(spark, folder):
    rows = recording.read(spark, folder).collect()
    by = {b: [r for r in rows if r.bag == b] for b in ("a.bag", "b.bag", "c.bag")}
    assert [len(by[b]) for b in by] == [103, 2, 0]
    assert by["a.bag"][0].topic == "/chassis_cmd_vel" and by["a.bag"][0].msgtype == "geometry_msgs/msg/Twist" and by["a.bag"][0].latching == 1 and by["a.bag"][0].ts_ns == 1000 * 10**9
    assert [r.number for r in by["a.bag"]] == list(range(103))
    assert {(r.bag, r.topic): r.n for r in recording.topic_counts(recording.read(spark, folder)).collect()}[("a.bag", "/odom")] == 40
    assert recording.read(spark, folder, ["/rosout"]).count() == 3
    assert {r.bag: r.truncated for r in catalog.discovered(spark, folder).collect()} == {"a.bag": True, "b.bag": True}


def indexed_bag(chunks, gap=b""):
    """A recording with an index, and records of another kind between its chunks; chunks: (compression, data, {connection: messages})."""
    out = bytearray(b"#ROSBAG V2.0\n")
    at = len(out)
    head = lambda pos: record(b" " * 100, op=b"\x03", index_pos=struct.pack("<Q", pos), conn_count=struct.pack("<I", 3), chunk_count=struct.pack("<I", len(chunks)))
    out += head(0)
    infos = b""
    for name, data, counts in chunks:
        packed = bz2.compress(data) if name == "bz2" else data
        pos = len(out)
        out += record(packed, op=b"\x05", compression=name.encode(), size=struct.pack("<I", len(data))) + record(gap, op=b"\x04")
        infos += record(b"".join(struct.pack("<II", c, n) for c, n in counts.items()), op=b"\x06", ver=struct.pack("<I", 1), chunk_pos=struct.pack("<Q", pos), start_time=struct.pack("<II", 1000, 0), end_time=struct.pack("<II", 1200, 0), count=struct.pack("<I", len(counts)))
    place = len(out)
    out[at : at + len(head(0))] = head(place)
    return bytes(out) + HEAD + infos


HEAD = connection(0, "/chassis_cmd_vel", "geometry_msgs/Twist", TWIST) + connection(1, "/rosout", "rosgraph_msgs/Log", LOG) + connection(2, "/odom", "geometry_msgs/Twist", TWIST)


def test_ranges(spark, tmp_path):
    """Files read by index and by steps, in ranges of few bytes, against the same files read whole."""
    one = HEAD + b"".join(message(0, 1000 + i, twist(i)) for i in range(30)) + message(9, 1000, b"unknown")
    two = b"".join(message(2, 1100 + i, twist(i)) for i in range(20)) + message(1, 1150, log(8, "nav", "stuck"))
    three = message(0, 1190, twist(7)) + message(1, 1199, log(4, "/m", "still_flag: 1"))
    chunks = [("none", one, {0: 30, 9: 1}), ("bz2", two, {2: 20, 1: 1}), ("bz2", three, {0: 1, 1: 1})]
    whole = indexed_bag(chunks, b"x" * 5000)
    files = {"whole.bag": whole, "cut.bag": whole[:-40], "short.bag": whole[: len(whole) // 2], "no_index.bag": whole.replace(struct.pack("<Q", whole.index(HEAD, len(whole) // 2)), bytes(8), 1), "empty.bag": b"", "other.bag": b"text\n", "bare.bag": b"#ROSBAG V2.0\n"}
    (tmp_path / "below").mkdir()
    for name, content in files.items():
        (tmp_path / ("below" if name == "cut.bag" else ".") / name).write_bytes(content)
    want = {tuple(r) for name, content in files.items() for r in recording.messages_of(content, name)}
    assert len(want) == 3 * 53 + 51
    for size in (1000, 1 << 26):
        rows = recording.read(spark, str(tmp_path), range_bytes=size)
        got = [tuple(r[:-1]) + (bytes(r[-1]),) for r in rows.collect()]
        assert len(got) == len(want) and set(got) == want
        assert rows.rdd.getNumPartitions() > (6 if size == 1000 else 0)
    assert {tuple(r)[:-1] for r in recording.read(spark, str(tmp_path), ["/rosout"]).collect()} == {r[:-1] for r in want if r[2] == "/rosout"}
    assert recording.read(spark, str(tmp_path), ["/none"]).count() == 0
    assert {tuple(r)[:-1] for r in recording.read_whole(spark, str(tmp_path), ["/odom"]).collect()} == {r[:-1] for r in want if r[2] == "/odom"}
    found = {r.bag: (r.n, r.truncated) for r in catalog.discovered(spark, str(tmp_path)).collect()}
    assert found == {"whole.bag": (53, False), "cut.bag": (53, False), "short.bag": (51, True), "no_index.bag": (53, True)}


def test_unasked_chunks_are_not_read(spark, tmp_path):
    """Of a recording with an index, a chunk without the topics asked for may be broken."""
    one = HEAD + message(0, 1000, twist(1))
    good = indexed_bag([("none", one, {0: 1}), ("bz2", message(2, 1100, twist(2)), {2: 1})])
    (tmp_path / "x.bag").write_bytes(good.replace(b"BZh9", b"none"))
    assert [r.number for r in recording.read(spark, str(tmp_path), ["/chassis_cmd_vel"]).collect()] == [0]
    assert recording.read(spark, str(tmp_path), ["/odom"]).count() == 0


def test_beyond_two_gigabytes(spark, tmp_path):
    """A file of 5 GB, most of it a hole, is read in several tasks, by its index and without it."""
    hole = (2**32 - 1) // 2 * 2 - 4096
    one, two = HEAD + message(0, 1000, twist(1)), message(2, 1100, twist(2)) + message(0, 1101, twist(3))
    start = b"#ROSBAG V2.0\n"
    for name, place_known in (("a.bag", True), ("b.bag", False)):
        with open(tmp_path / name, "wb") as f:
            head_at = f.write(start)
            f.write(record(b" " * 100, op=b"\x03", index_pos=bytes(8), conn_count=struct.pack("<I", 3), chunk_count=struct.pack("<I", 2)))
            places = []
            for data in (one, two):
                places.append(f.tell())
                f.write(record(data, op=b"\x05", compression=b"none", size=struct.pack("<I", len(data))))
                f.write(header(op=b"\x04") + struct.pack("<I", hole // 2))
                f.seek(hole // 2, 1)
            index = f.tell()
            f.write(HEAD + b"".join(record(struct.pack("<II", 0, 1) + (struct.pack("<II", 2, 1) if i else b""), op=b"\x06", chunk_pos=struct.pack("<Q", p), start_time=struct.pack("<II", 1000, 0), end_time=struct.pack("<II", 1101, 0)) for i, p in enumerate(places)))
            f.seek(head_at)
            f.write(record(b" " * 100, op=b"\x03", index_pos=struct.pack("<Q", index * place_known), conn_count=struct.pack("<I", 3), chunk_count=struct.pack("<I", 2)))
        assert (tmp_path / name).stat().st_size > 2**32 - 2**20
    rows = recording.read(spark, str(tmp_path))
    assert {(r.bag, r.number, r.topic) for r in rows.collect()} == {(b, n, t) for b in ("a.bag", "b.bag") for n, t in enumerate(("/chassis_cmd_vel", "/odom", "/chassis_cmd_vel"))}
    assert rows.rdd.getNumPartitions() >= 4


def test_truncation_at_every_byte():
    whole = bag([("none", connection(0, "/t", "std_msgs/Float32", "float32 data") + message(0, 5, struct.pack("<f", 1)))])
    counts = [len(list(recording.messages_of(whole[:n], "x"))) for n in range(len(whole) + 1)]
    assert counts == sorted(counts) and counts[-1] == 1
    assert recording.is_truncated(whole) and not recording.is_truncated(bag([("none", b"")], 50)) and not recording.is_truncated(b"x")


def test_decoding():
    assert messages.numbers(messages.decode(twist(1, 2), TWIST), "geometry_msgs/msg/Twist") == {"linear_x": 1, "linear_y": 0, "linear_z": 0, "angular_x": 0, "angular_y": 0, "angular_z": 2}
    ranges = np.array([0.05, 1, 2, 3, 99, np.nan], dtype="<f4")
    scan = messages.numbers(messages.decode(struct.pack("<ffI", 0.1, 10, 6) + ranges.tobytes(), SCAN), "sensor_msgs/msg/LaserScan")
    assert scan["num_valid_points"] == 3 and scan["num_total_points"] == 6 and scan["range_max_val"] == 3 and math.isclose(scan["range_min_val"], 0.05, rel_tol=1e-6) and math.isclose(scan["range_mean"], 6.05 / 4, rel_tol=1e-6)
    pairs = [("ok", "True"), ("bad", "false"), ("v", "1.5"), ("s", "text")]
    raw = struct.pack("<b", 2) + text("n") + struct.pack("<I", 4) + b"".join(text(k) + text(v) for k, v in pairs)
    assert messages.numbers(messages.decode(raw, STATUS), "diagnostic_msgs/msg/DiagnosticStatus") == {"level": 2, "ok": 1, "bad": 0, "v": 1.5}
    raw = struct.pack("<h?3B", -5, True, 1, 2, 3) + struct.pack("<I", 30) + np.arange(30, dtype="<f4").tobytes() + text("é")
    msg = messages.decode(raw, OTHER)
    assert messages.numbers(msg, "x/msg/Y") == {"a": -5}
    assert messages.shown(msg)["c"] == "<bytes length=3>" and messages.shown(msg)["d"]["length"] == 30 and messages.shown(msg)["e"] == "é" and messages.shown(float("nan")) == "nan"


def test_fields_logs_and_previews(spark, folder):
    rows = recording.read(spark, folder)
    got = messages.signals(rows).where("bag = 'a.bag' and topic = '/chassis_cmd_vel' and field = 'linear_x'").orderBy("seq").collect()
    assert [r.value for r in got[:4]] == [0.5, 1.5, 2.5, 0.5] and got[0].ts_us == 1000 * 10**6
    logs = messages.logs(rows).orderBy("bag", "seq").collect()
    assert [(r.level, r.node, r.raw_message, r.line, r.topics) for r in logs] == [(8, "nav", "navigation module stuck at 35", 7, ["/t"]), (4, "/m", "still_flag: 1", 7, ["/t"])]
    assert json.loads(messages.previews(rows).where("topic = '/odom'").first().data)["linear"]["x"] == 0.0
    source = catalog.open_logs(spark, f"{folder}/a.bag", "WARN")
    rec = source.records().orderBy("seq").collect()
    assert [(r.node, r.level, r.template) for r in rec] == [("/nav", "ERROR", "navigation module stuck at #"), ("/m", "WARN", "still_flag: #")] and rec[0].timestamp_ms == (8 * 3600 + 1010) * 1000
    assert source.metadata().first().total_messages == 3


def test_whole_diagnosis(spark, folder):
    found = analysis.diagnose(spark, folder)
    kinds = {(r.bag, r.category) for r in found["anomalies"].collect()}
    assert {("a.bag", "FROZEN_SENSOR"), ("a.bag", "CMD_ODOM_MISMATCH")} - kinds == {("a.bag", "CMD_ODOM_MISMATCH")} - kinds
    assert ("a.bag", "FROZEN_SENSOR") in kinds
    assert {r.bag: r.mission for r in found["missions"].collect()} == {"a.bag": 0, "b.bag": 1}
    assert {r.bag: r.health for r in found["health"].collect()}["a.bag"] == "UNHEALTHY"
    assert all(r.title and r.incident_id.startswith("INC-") for r in found["incidents"].collect()) and found["summary"].count() == 2


LINES = ["[ INFO][11:59:59.500 PM CST][/chassis]: [CHASSIS] IMU orientation(1802 1775 74)", "broken", "", "[ERROR][12:00:00.100 AM CST][/dl_infer]: [overdark] Time: 12.5", "[DEBUG][0:00:01.000][/x]: no", "[WARN][0:00:02.000][/x]: Error code -5 at 0.134 0x1F and .5"]


def test_text_logs(spark, tmp_path):
    (tmp_path / "run.log").write_text("\n".join(LINES) + "\n")
    source = catalog.open_logs(spark, str(tmp_path / "run.log"))
    got = source.records().orderBy("seq").collect()
    assert [(r.seq, r.level, r.timestamp_ms, r.template, r.values) for r in got] == [
        (1, "INFO", 86_399_500.0, "[CHASSIS] IMU orientation(# # #)", [1802.0, 1775.0, 74.0]), (4, "ERROR", 86_400_100.0, "[overdark] Time: #", [12.5]), (6, "WARN", 86_402_000.0, "Error code # at # # and #", [-5.0, 0.134, 0.5]),
    ]
    meta = source.metadata().first()
    assert (meta.total_lines, meta.parsed_lines, meta.skipped_lines, meta.source_file) == (6, 3, 1, "run.log")
    assert text_log.read(spark, str(tmp_path / "run.log")).count() == 6


def test_text_logs_in_splits(spark, tmp_path):
    """Lines of files split anywhere get the numbers that they have in the whole file."""
    rng = np.random.default_rng(4)
    files = {"a.log": [f"line {i} " + "x" * int(rng.integers(0, 60)) for i in range(400)], "b.log": ["", "", "é" * 50, "one\rtwo", "end\r", ""], "c.log": ["only"], "empty.log": []}
    (tmp_path / "d").mkdir()
    for name, lines in files.items():
        (tmp_path / "d" / name).write_bytes(("\n".join(lines) + "\n" * bool(name != "c.log" and lines)).encode())
    sizes = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "40", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        rows = text_log.read(spark, str(tmp_path / "d"))
        got = {(r.source_file, r.seq): r.line for r in rows.collect()}
        one = {r.seq: r.line for r in text_log.read(spark, str(tmp_path / "d" / "a.log")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {(name, i + 1): line.rstrip("\r") for name, lines in files.items() for i, line in enumerate(lines)}
    assert one == dict(enumerate(files["a.log"], 1))


def test_log_extraction(spark, tmp_path):
    rng = np.random.default_rng(1)
    lines = []
    for s in range(240):
        lines.append(f"[INFO][1:{s // 60:02d}:{s % 60:02d}.000][/chassis]: speed {rng.normal(5, 0.1):.3f}")
        if s >= 120:
            lines.append(f"[WARN][1:{s // 60:02d}:{s % 60:02d}.200][/dl_infer]: lost frame")
            lines.append(f"[WARN][1:{s // 60:02d}:{s % 60:02d}.300][/depthcam_fusion]: fusion late")
    lines[50] = "[INFO][1:00:50.000][/chassis]: speed 99.0"
    (tmp_path / "x.log").write_text("\n".join(lines))
    found = analysis.extract(catalog.open_logs(spark, str(tmp_path / "x.log")), sigmas=1.0, validated=[{"name": "r", "root": ["/dl_infer", "x"], "confidence": 1.0}])
    kinds = {r.kind for r in found["anomalies"].collect()}
    assert "value_deviation" in kinds
    assert {r.node: r.kind for r in found["profiles"].collect()}["/chassis"] == "periodic"
    chains, isolated = found["chains"].collect(), found["isolated"].collect()
    assert len({r.seq for r in found["members"].collect()}) + len(isolated) == found["anomalies"].count() and all(c.severity > 0 for c in chains)
    report = {"metadata": {"source_file": "x"}, "nodes": [r.asDict() for r in found["profiles"].collect()], "regimes": [], "chains": [{"severity": 5.0, "node": "/n", "kind": "k", "template": "t" * 99, "first_ms": 0, "last_ms": 1, "jaccard": 1.0, "members": 2, "types": [{"node": "/n", "kind": "k", "template": "t", "n": 3}] * 30}] * 40, "isolated": [], "total_anomalies": 60}
    for tokens in (3000, 300, 30):
        assert len(reports.prompt(report, tokens)) <= 4 * tokens
    assert reports.prompt(report).count("CHAIN [5.0]") >= 5 and "+20 more anomaly types" in reports.prompt(report)


def test_files_are_extracted_each_by_itself(spark, tmp_path):
    """A folder's result is that of its files, one by one: clocks, windows, regimes, values and chains do not mix."""
    rng = np.random.default_rng(2)
    (tmp_path / "all").mkdir()
    for name, hour, every in (("a.log", 23, 1), ("b.log", 5, 2)):
        lines = []
        for s in range(0, 200 * every, every):
            at = hour * 3600 + 3500 + s
            clock = f"{at // 3600 % 24}:{at // 60 % 60:02d}:{at % 60:02d}"
            lines.append(f"[INFO][{clock}.000][/chassis]: speed {rng.normal(5, 0.1):.3f}")
            if s > 100 * every:
                lines.append(f"[WARN][{clock}.200][/dl_infer]: lost frame {s % 3}")
                lines.append(f"[WARN][{clock}.300][/depthcam_fusion]: fusion late")
        lines.append(f"[INFO][{clock}.900][/chassis]: speed 99.0")
        for place in (tmp_path / name, tmp_path / "all" / name):
            place.write_text("\n".join(lines) + "\n")
    tables = ("profiles", "windows", "regimes", "anomalies", "chains", "isolated")
    rows = lambda found, t: {tuple(r) for r in found[t].select(sorted(found[t].columns)).collect()}
    whole = analysis.extract(catalog.open_logs(spark, str(tmp_path / "all")), sigmas=1.0)
    each = [analysis.extract(catalog.open_logs(spark, str(tmp_path / name)), sigmas=1.0) for name in ("a.log", "b.log")]
    for t in tables:
        assert rows(whole, t) == rows(each[0], t) | rows(each[1], t), t
    assert {r.source_file for r in whole["regimes"].collect()} == {"a.log", "b.log"}
    assert {(r.source_file, r.kind) for r in whole["anomalies"].collect()} >= {("a.log", "value_deviation"), ("b.log", "value_deviation")}
    # values behind the last window have its regime, not one of their own
    assert each[0]["anomalies"].where("kind = 'value_deviation' and score > 20").count() == 1


def test_command_lines(spark, folder, tmp_path, monkeypatch):
    """The commands write their tables, reports, prompts, annotated logs, pages and layouts."""
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    text_of = lambda place: "\n".join(p.read_text() for p in sorted(place.glob("part-*")))
    rng = np.random.default_rng(1)
    (tmp_path / "in").mkdir()
    for name in ("one.log", "two.log"):
        lines = [f"[INFO][1:{s // 60:02d}:{s % 60:02d}.000][/chassis]: speed {99.0 if s == 200 else rng.normal(5, 0.1):.3f}" for s in range(240)]
        lines += [f"[WARN][1:{s // 60:02d}:{s % 60:02d}.200][/dl_infer]: lost frame" for s in range(120, 240)]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
    monkeypatch.setattr(sys, "argv", ["telescribe", "logs", str(tmp_path / "in"), str(tmp_path / "logs"), "--tokens", "500"])
    cli.main()
    for name in ("one.log", "two.log"):
        report = json.loads(text_of(tmp_path / "logs" / "report" / name))
        assert report["metadata"]["source_file"] == name and report["metadata"]["total_lines"] == 360 and {n["node"] for n in report["nodes"]} == {"/chassis", "/dl_infer"}
        assert report["total_anomalies"] > 0 and report["regimes"][0]["end_ms"] > report["regimes"][0]["start_ms"]
        prompt = text_of(tmp_path / "logs" / "prompt" / name)
        assert prompt.startswith("=== ROBOT DIAGNOSTIC SUMMARY ===") and len(prompt) <= 2000 and f"Source: {name}" in prompt
    assert "value_deviation" in text_of(tmp_path / "logs" / "annotated")
    monkeypatch.setattr(sys, "argv", ["telescribe", "diagnose", folder, str(tmp_path / "found")])
    cli.main()
    page = text_of(tmp_path / "found" / "page")
    assert page.startswith("<!DOCTYPE html>") and "INC-001" in page and "Recordings<br><b>2</b>" in page
    assert all("configById" in json.loads(text_of(p)) for p in (tmp_path / "found" / "layouts").iterdir()) and list((tmp_path / "found" / "layouts").iterdir())


def test_values_against_a_plain_tracker(spark):
    """The first 20 values classify a position; then states, counters and deviations are told."""
    steady = [5.0 + 0.01 * math.sin(i) for i in range(80)] + [9.0]
    counter = [float(3 * i + (i % 2)) for i in range(60)] + [1000.0]
    state = [1.0] * 30 + [2.0] * 5 + [1.0]
    rows = [(i, i, "/n", t, 0, [x]) for t, xs in (("steady", steady), ("counter", counter), ("state", state)) for i, x in enumerate(xs)]
    rows += [(i + 500, i + 500, "/n", "state", 1, [3.0]) for i in range(10)] + [(999, 999, "/n", "none", 0, [])]
    got = values.value_anomalies(spark.createDataFrame(rows, "seq long, ts_us long, node string, template string, regime long, values array<double>")).collect()
    seen = {(r.template, r.seq, r.kind) for r in got}
    assert {("steady", 80, "value_deviation"), ("counter", 60, "counter_anomaly")} <= seen and all(s >= 20 for _, s, _ in seen)
    assert {x for x in seen if x[0] == "state"} == {("state", 30, "state_transition"), ("state", 35, "state_transition")}
    assert {k for _, _, k in seen} == {"value_deviation", "counter_anomaly", "state_transition"}
    e = values.Ewma()
    for x in (1.0, float("nan"), 3.0):
        e.add(x)
    assert e.count == 2 and math.isclose(e.mean, 1.02) and math.isclose(e.var, 0.99 * 0.01 * 4)


def test_rules_file():
    content = "# text\nrules:\n  - name: \"cascade\"\n    root: [\"/dl_infer\", \"overdark\"]\n    downstream:\n      - [\"/a\", \"b c\"]\n      - ['/d', 'e']\n    confidence: 0.8\n  - name: other\n    root: [/x, y]\n"
    assert catalog.validated_rules(content) == [{"name": "cascade", "root": ["/dl_infer", "overdark"], "downstream": [["/a", "b c"], ["/d", "e"]], "confidence": 0.8}, {"name": "other", "root": ["/x", "y"]}]
    assert catalog.validated_rules("rules: []") == [] == catalog.validated_rules("")


def test_layouts_and_page(spark):
    rows = spark.createDataFrame([("NAV_STUCK", "WARNING", "UNCHECKED"), ("IMU", "INFO", "UNCHECKED"), ("ERROR", "INFO", "CONFIRMED"), ("nothing", "CRITICAL", "x")], "category string, severity string, verdict string")
    assert sorted(layouts.layouts(rows)) == ["abnormal_stop", "navigation"] and sorted(layouts.layouts(rows.limit(0))) == sorted(layouts.BASE) and len(layouts.layouts(None, every=True)) == 11
    made = layouts.layout("depth_camera")

    def leaves(node):
        return [node] if isinstance(node, str) else leaves(node["first"]) + leaves(node["second"])

    assert sorted(leaves(made["layout"])) == sorted(made["configById"])
    page = reports.page("a<b", {"n": 1}, {"All": [{"severity": "CRITICAL", "title": "<script>", "text": "x & y", "start_us": 1}, {"severity": "INFO", "title": "t", "text": None, "start_us": None}]})
    assert "<script>alert" not in page and "&lt;script&gt;" in page and page.count("<circle") == 1


def test_stillness_rules(spark):
    rows = [("b", "/odom", "twist_linear_x", i, i * 10**6, 0.0) for i in range(11)] + [("b", "/odom", "twist_linear_y", i, i * 10**6, 0.0) for i in range(11)] + [("b", "/odom", "position_x", i, i * 10**6, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "bag string, topic string, field string, seq long, ts_us long, value double")
    assert [(r.category, r.field) for r in diagnose.anomalies(df).collect()] == [("ZERO_FIELD", "twist_linear_x")]
    assert diagnose.anomalies(df.limit(0)).count() == 0


def test_streams(spark, tmp_path):
    rows = [("b", "/t", "x", i, float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "bag string, topic string, field string, s int, value double").select("bag", "topic", "field", F.timestamp_seconds("s").alias("ts"), "value", F.lit("c").alias("category"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("windows", streams.windowed_stats(stream)), ("bins", streams.incident_bins(stream))):
        query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {r.start.second: r.n for r in spark.table("windows").collect()}
    assert set(got.values()) <= {30, 10} and spark.table("bins").count() <= 1
