"""Four questions about one recording, answered as small dicts or JSON: what it holds, a topic's statistics and rate, and samples.

The work is done by the operators on the recording's rows; answers are bounded, so that a reader of few lines can take them in.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telescribe.operators import telemetry as T
from telescribe.sources import messages, recording

# Beginnings of topics that are named one by one where there are many, and bounds of answers.
KEY_TOPICS = ("/odom", "/cmd_vel", "/chassis_cmd_vel", "/imu", "/scan", "/localization", "/device", "/front_end", "/rosout", "/unbiased_imu", "/pointcloud", "/tf", "/speed", "/navigation", "/protector", "/v5_")
MANY_TOPICS, MANY_BINS, DROPS, ENDS, DROP_SHARE = 30, 60, 20, 10, 0.5


class Bridge:
    """Recordings by path; each is planned once, and its messages are read by topic."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def rows(self, path: str, topic: str | None = None) -> DataFrame:
        return recording.read(self.spark, path, None if topic is None else [topic])

    def metadata(self, path: str) -> dict:
        """Length, ends, and each topic's type, messages and rate, in order of name. A topic's messages count once,
        however many connections carry it."""
        rows = self.rows(path).select("bag", "topic", "msgtype", F.floor(F.col("ts_ns") / 1000).alias("ts_us"))
        kinds = {r["topic"]: r["msgtype"] for r in rows.groupBy("topic").agg(F.min("msgtype").alias("msgtype")).collect()}
        topics = T.bag_metadata(rows).orderBy("topic").collect()
        if not topics:
            return {"duration": 0.0, "start_time": 0.0, "end_time": 0.0, "total_messages": 0, "num_topics": 0, "topics": []}
        one = topics[0]
        return {
            "duration": one["duration_s"], "start_time": round(one["start_us"] / 1e6, 4), "end_time": round(one["end_us"] / 1e6, 4), "total_messages": one["total"], "num_topics": one["topics"],
            "topics": [{"name": r["topic"], "type": kinds[r["topic"]], "message_count": r["n"], "frequency": r["hz"]} for r in topics],
        }

    def statistics(self, path: str, topic: str, start: float | None = None, end: float | None = None, window: float | None = None) -> list[dict]:
        """Statistics of a topic's fields over a stretch, or in its windows, the empty ones, too. Times are in seconds."""
        ends = self.rows(path).agg(F.floor(F.min("ts_ns") / 1000).alias("a"), F.floor(F.max("ts_ns") / 1000).alias("b")).first()
        rows = self.rows(path, topic)
        if not rows.limit(1).count():
            return [{"error": f"Topic '{topic}' not found in bag"}]
        a, b = (own if given is None else round(given * 1e6) for given, own in ((start, ends["a"]), (end, ends["b"])))
        found = T.field_statistics(messages.signals(rows), round(window * 1e6) if window and window > 0 else None, a, b)
        out: dict[int, dict] = {}
        # a row a field of a window
        for r in found.orderBy("w", "field").collect():
            one = out.setdefault(r["w"], {"window_start": round(r["start_us"] / 1e6, 4), "window_end": round(r["end_us"] / 1e6, 4), "count": r["messages"], "fields": {}})
            if r["field"] is not None:
                one["fields"][r["field"]] = {"mean": r["mean"], "std": r["std"], "min": r["low"], "max": r["high"], "count": r["n"]}
        return list(out.values())

    def frequency(self, path: str, topic: str, resolution: float = 1.0) -> dict:
        """A topic's rate in bins from its first message on, the empty ones, too, and its mean, deviation and ends."""
        rows = self.rows(path, topic).select("bag", "topic", F.floor(F.col("ts_ns") / 1000).alias("ts_us"))
        width = round(resolution * 1e6)
        full = T.rate_bins(rows, width)
        whole = T.frequency(full).first()
        if whole is None:
            return {"error": f"Topic '{topic}' not found"}
        held = {r["bin"]: r for r in full.collect()}
        series = [{"time": round((whole["t0"] + i * width) / 1e6, 4), "hz": held[i]["hz"] if i in held else 0.0, "count": held[i]["n"] if i in held else 0} for i in range(whole["bins"])]
        last = rows.agg(F.max("ts_us")).first()[0]
        return {
            "topic": topic, "resolution_sec": resolution, "total_messages": whole["messages"], "duration_sec": round((last - whole["t0"]) / 1e6, 2),
            "mean_hz": whole["mean_hz"], "std_hz": whole["std_hz"], "min_hz": whole["min_hz"], "max_hz": whole["max_hz"], "frequency_series": series,
        }

    def sample(self, path: str, topic: str, timestamp: float | None = None, count: int = 5) -> dict:
        """The first messages of a topic, or those nearest to a time, in order of time; of equally near ones the earlier."""
        rows = self.rows(path, topic)
        kind = rows.select("msgtype").first()
        if kind is None:
            return {"error": f"Topic '{topic}' not found"}
        order = [F.col("number")] if timestamp is None else [F.abs(F.col("ts_ns") - round(timestamp * 1e9)), F.col("number")]
        chosen = rows.orderBy(*order).limit(count)
        # a message that does not fit its definition is told of, not left out
        shown = {r["seq"]: json.loads(r["data"]) for r in messages.previews(chosen).collect()}
        found = [{"timestamp": round(r["ts_ns"] / 1e9, 6), "data": shown.get(r["number"], f"<could not deserialize {r['msgtype']}>")} for r in sorted(chosen.select("ts_ns", "number", "msgtype").collect(), key=lambda r: (r["ts_ns"], r["number"]) if timestamp is not None else r["number"])]
        return {"topic": topic, "type": kind["msgtype"], "num_messages": len(found), "messages": found}


def bag_metadata(bridge: Bridge, path: str) -> str:
    """metadata() as JSON; of many topics the key ones one by one, the others by name only."""
    found = bridge.metadata(path)
    if len(found["topics"]) > MANY_TOPICS:
        topics = found.pop("topics")
        key = [t for t in topics if t["name"].startswith(KEY_TOPICS)]
        others = [t["name"] for t in topics if not t["name"].startswith(KEY_TOPICS)]
        found |= {"key_topics": key, "other_topics_summary": {"count": len(others), "names": others}}
    return json.dumps(found, indent=2)


def topic_statistics(bridge: Bridge, path: str, topic: str, start: float | None = None, end: float | None = None, window: float | None = None) -> str:
    return json.dumps(bridge.statistics(path, topic, start, end, window), indent=2)


def topic_frequency(bridge: Bridge, path: str, topic: str, resolution: float = 1.0) -> str:
    """frequency() as JSON; of a long series its ends, and its first bins below half the mean."""
    found = bridge.frequency(path, topic, resolution)
    series = found.get("frequency_series", [])
    if len(series) > MANY_BINS:
        del found["frequency_series"]
        low = [s for s in series if s["hz"] < DROP_SHARE * found["mean_hz"]]
        found |= {"anomalous_bins": low[:DROPS], "frequency_series_first_10": series[:ENDS], "frequency_series_last_10": series[-ENDS:], "total_bins": len(series)}
    return json.dumps(found, indent=2)


def sample_messages(bridge: Bridge, path: str, topic: str, timestamp: float | None = None, count: int = 5) -> str:
    return json.dumps(bridge.sample(path, topic, timestamp, count), indent=2, default=str)


#: All tools, for an agent to choose from.
TOOLS = (bag_metadata, topic_statistics, topic_frequency, sample_messages)


def grounding(steps: int, calls: int, claims: list[dict]) -> dict:
    """How far a diagnosis rests on evidence: tool calls a step, and the share of its claims that nothing supports."""
    unsupported = sum(not c.get("supported", True) for c in claims)
    return {"grounding_ratio": round(calls / max(steps, 1), 4), "hallucination_rate": round(unsupported / len(claims), 4) if claims else 0.0, "total_claims": len(claims), "unsupported_claims": unsupported}
