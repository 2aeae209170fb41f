"""What lies below a path: recordings and text logs, opened by what they are, and files of validated rules."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telescribe.functions.text import template, template_values
from telescribe.plans import rules
from telescribe.sources import messages, recording, text_log


class LogSource(Protocol):
    """A source of log records: (source_file, seq, timestamp_ms, level, node, raw_message, template, values)."""

    def records(self) -> DataFrame: ...

    def metadata(self) -> DataFrame: ...


def _templated(rows: DataFrame) -> DataFrame:
    m = F.col("raw_message")
    return rows.select("source_file", "seq", "timestamp_ms", "level", "node", "raw_message", template(m).alias("template"), template_values(m).alias("values"))


class TextSource:
    """Text logs; lines of another shape are counted, not read."""

    def __init__(self, spark: SparkSession, path: str, least: str = "INFO"):
        self.lines, self.least = text_log.read(spark, path), least

    def records(self) -> DataFrame:
        rows = text_log.rolled_over(text_log.parsed(self.lines, self.least), "source_file", "seq")
        return _templated(rows)

    def metadata(self) -> DataFrame:
        """(source_file, total_lines, parsed_lines, skipped_lines): empty lines are in the total only."""
        shape = F.col("line").rlike(text_log.LINE)
        kept = text_log.parsed(self.lines, self.least).groupBy("source_file").agg(F.count("*").alias("parsed_lines"))
        out = self.lines.groupBy("source_file").agg(F.count("*").alias("total_lines"), F.count_if(~shape & (F.col("line") != "")).alias("skipped_lines"))
        return out.join(kept, "source_file", "left").withColumn("parsed_lines", F.coalesce("parsed_lines", F.lit(0).cast("bigint")))


class RecordingSource:
    """Log messages of recordings; times are milliseconds from the midnight (at a fixed distance from UTC) before each begins."""

    def __init__(self, spark: SparkSession, path: str, least: str | int = "INFO", hours: int = 8):
        levels = {name: n for n, name in rules.LEVELS.items()}
        self.messages, self.least, self.hours = recording.read(spark, path), levels.get(str(least).upper(), 2) if isinstance(least, str) else int(least), hours

    def records(self) -> DataFrame:
        from telescribe.operators.logs import level_name

        rows = messages.logs(self.messages, self.least)
        start = self.messages.groupBy("bag").agg(F.min("ts_ns").alias("t0"))
        shift, day = self.hours * 3_600_000_000, 86_400_000_000
        rows = rows.join(start, "bag").withColumn("midnight", F.floor((F.col("t0") / 1000 + shift) / day) * day - shift)
        node = F.when(F.col("node").startswith("/"), F.col("node")).otherwise(F.concat(F.lit("/"), F.col("node")))
        return _templated(rows.select(F.col("bag").alias("source_file"), "seq", ((F.col("ts_us") - F.col("midnight")) / 1000.0).alias("timestamp_ms"), level_name(F.col("level")).alias("level"), node.alias("node"), "raw_message"))

    def metadata(self) -> DataFrame:
        own = self.messages.groupBy("bag").agg(F.count_if(F.col("topic").isin("/rosout", "/rosout_agg")).alias("total_messages"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))
        kept = messages.logs(self.messages, self.least).groupBy("bag").agg(F.count("*").alias("parsed_messages"))
        return own.join(kept, "bag", "left").withColumn("parsed_messages", F.coalesce("parsed_messages", F.lit(0).cast("bigint"))).withColumnRenamed("bag", "source_file")


def open_logs(spark: SparkSession, path: str, least: str = "INFO") -> LogSource:
    """The source that a path's ending calls for: .bag is a recording, anything else a text log."""
    return RecordingSource(spark, path, least) if path.lower().endswith(".bag") else TextSource(spark, path, least)


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """(bag, start_us, end_us, n, truncated) of the recordings below a folder, in order of name; unreadable ones are left out."""
    return recording.discovered(spark, folder)


def validated_rules(content: str) -> list[dict]:
    """The rules of a YAML file of the form rules: [- name, root: [node, pattern], downstream: [- [node, pattern]], confidence]."""
    try:
        import yaml

        return (yaml.safe_load(content) or {}).get("rules") or []
    except ImportError:
        pass
    out: list[dict] = []
    pair = lambda s: [x.strip().strip("\"'") for x in re.findall(r"""("[^"]*"|'[^']*'|[^,\[\]]+)""", s) if x.strip()]
    inside = False
    for line in content.split("\n"):
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if re.match(r"rules\s*:", line):
            inside = not line.endswith("[]")
        elif inside and line.strip():
            item = re.match(r"\s*(-\s+)?(name|root|downstream|confidence)\s*:\s*(.*)$", line)
            nested = re.match(r"\s*-\s*(\[.*\])\s*$", line)
            if item and item[1]:
                out.append({})
            if item and out:
                key, value = item[2], item[3].strip()
                out[-1][key] = pair(value) if key == "root" else [pair(x) for x in re.findall(r"\[[^\[\]]+\]", value)] if key == "downstream" else float(value) if key == "confidence" else value.strip("\"'")
            elif nested and out:
                out[-1].setdefault("downstream", []).append(pair(nested[1]))
    return out


def rules_file(spark: SparkSession, path: str) -> list[dict]:
    """The validated rules of a file that Spark can read; a small file, read whole."""
    return validated_rules("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
