"""The batch statistics as streams: windows and incidents of rows that arrive late by a bounded time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telescribe.operators.relational import moments


def windowed_stats(tel: DataFrame, width: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Statistics of (bag, topic, field) in windows that hold their left edge. tel: (bag, topic, field, ts timestamp, value).

    A window is given out once no row that is late by less than the bound can belong to it; later rows are left out.
    """
    rows = tel.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "bag", "topic", "field").agg(*moments(F.col("value"))).select("bag", "topic", "field", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std", "low", "high")


def incident_bins(anomalies: DataFrame, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Anomalies of a recording's category that follow each other within the gap. anomalies: (bag, category, ts timestamp)."""
    rows = anomalies.withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("s"), "bag", "category").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return out.select("bag", "category", "n", "start", "end")
