"""The four tools on a recording made byte by byte."""

import json
import struct
import sys

import pytest

from telescribe import tools

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_recordings import TWIST, bag, connection, message, twist  # noqa: E402


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    out = tmp_path_factory.mktemp("tools") / "x.bag"
    chunk = connection(0, "/odom", "geometry_msgs/Twist", TWIST) + connection(1, "/odom", "geometry_msgs/Twist", TWIST)
    chunk += b"".join(message(i % 2, 1000 + i * 0.5, twist(float(i))) for i in range(160) if not 20 <= i < 30)
    for k in range(35):
        chunk += connection(10 + k, f"/t{k:02d}", "std_msgs/Float32", "float32 data") + message(10 + k, 1001, struct.pack("<f", k) if k else b"")
    out.write_bytes(bag([("none", chunk)]))
    return str(out)


def test_metadata(spark, path):
    found = tools.Bridge(spark).metadata(path)
    assert (found["duration"], found["start_time"], found["total_messages"], found["num_topics"]) == (79.5, 1000.0, 185, 36)
    assert found["topics"][0] == {"name": "/odom", "type": "geometry_msgs/msg/Twist", "message_count": 150, "frequency": 1.89}
    short = json.loads(tools.bag_metadata(tools.Bridge(spark), path))
    assert [t["name"] for t in short["key_topics"]] == ["/odom"] and short["other_topics_summary"]["count"] == 35 and "topics" not in short


def test_statistics(spark, path):
    bridge = tools.Bridge(spark)
    (whole,) = bridge.statistics(path, "/odom")
    assert whole["count"] == 150 and whole["fields"]["linear_x"]["min"] == 0 and whole["fields"]["linear_x"]["max"] == 159 and whole["fields"]["angular_z"] == {"mean": 0, "std": 0, "min": 0, "max": 0, "count": 150}
    parts = bridge.statistics(path, "/odom", start=1008, end=1018, window=2)
    # windows hold their right edge, the first one both
    assert [p["count"] for p in parts] == [4, 0, 0, 3, 4] and [p["window_start"] for p in parts] == [1008, 1010, 1012, 1014, 1016] and parts[1]["fields"] == {}
    assert bridge.statistics(path, "/none") == [{"error": "Topic '/none' not found in bag"}]
    assert json.loads(tools.topic_statistics(bridge, path, "/t05"))[0]["fields"]["data"]["mean"] == 5.0


def test_frequency(spark, path):
    bridge = tools.Bridge(spark)
    found = bridge.frequency(path, "/odom", 1.0)
    assert found["total_messages"] == 150 and found["max_hz"] == 2 and found["min_hz"] == 0 and len(found["frequency_series"]) == 80 and [s["count"] for s in found["frequency_series"][9:16]] == [2, 0, 0, 0, 0, 0, 2]
    assert found["mean_hz"] == round(150 / 80 + 1e-9, 2)
    short = json.loads(tools.topic_frequency(bridge, path, "/odom"))
    assert len(short["anomalous_bins"]) == 5 and short["total_bins"] == 80 and "frequency_series" not in short
    assert bridge.frequency(path, "/none") == {"error": "Topic '/none' not found"}


def test_samples(spark, path):
    bridge = tools.Bridge(spark)
    assert [m["timestamp"] for m in bridge.sample(path, "/odom", count=3)["messages"]] == [1000.0, 1000.5, 1001.0]
    near = bridge.sample(path, "/odom", 1012.3, 3)
    assert [m["timestamp"] for m in near["messages"]] == [1009.5, 1015.0, 1015.5] and near["messages"][0]["data"]["linear"]["x"] == 19.0
    assert json.loads(tools.sample_messages(bridge, path, "/t00"))["messages"][0]["data"] == "<could not deserialize std_msgs/msg/Float32>"
    assert "error" in bridge.sample(path, "/none")


def test_grounding():
    assert tools.grounding(4, 6, [{"supported": True}, {"supported": False}, {}]) == {"grounding_ratio": 1.5, "hallucination_rate": 0.3333, "total_claims": 3, "unsupported_claims": 1}
    assert tools.grounding(0, 0, [])["hallucination_rate"] == 0.0
