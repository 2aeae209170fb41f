"""Evidence packets: log events held against sensors, classified, and chosen for a reader of few lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telescribe.operators.logs import routed
from telescribe.operators.relational import numbered
from telescribe.plans import rules

#: Words that make an error critical.
GRAVE = "(?i)fault|disconnect|emergency|critical"


def denoised(logs: DataFrame) -> DataFrame:
    """The rows that are not noise, with dedup_count, first_us and last_us: of a dedup group its first row only, with the
    number of its rows and their ends."""
    rows = routed(logs).where("route <> 'noise'")
    groups = rows.where("route = 'dedup'").groupBy("dedup_key").agg(F.count("*").alias("dedup_count"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.min(F.struct("ts_us", "seq")).alias("_x"))
    once = rows.where("route = 'dedup'").join(groups.select(F.col("_x.seq").alias("seq"), "dedup_count", "first_us", "last_us"), "seq")
    own = rows.where("route <> 'dedup'").withColumns({"dedup_count": F.lit(1).cast("bigint"), "first_us": F.col("ts_us"), "last_us": F.col("ts_us")})
    return own.unionByName(once.select(*rows.columns, "dedup_count", "first_us", "last_us"))


def classified(events: DataFrame) -> DataFrame:
    """Adds severity, category and wants_sensors to denoised rows: an event wants sensors if it is an error or makes a claim."""
    m = F.col("raw_message")
    severity = F.when((F.col("level") >= 8) & m.rlike(GRAVE), "CRITICAL").when(F.col("level") >= 4, "WARNING").otherwise("INFO")
    category = (
        F.when(F.col("log_event") != "UNMATCHED", F.upper("log_event")).when(F.col("level") >= 8, "ERROR").when(m.rlike("(?i)fail"), "FAILURE").when(m.rlike("(?i)stuck|deadlock"), "NAVIGATION_STUCK").otherwise("INFO")
    )
    claims = m.rlike("(?i)" + "|".join(f"(?:{p})" for p, *_ in rules.CHECKS))
    rows = events.withColumns({"severity": severity, "category": category, "wants_sensors": (F.col("level") >= 8) | F.coalesce(claims, F.lit(False))})
    often = (F.col("dedup_count") > 50) & (F.col("severity") == "INFO")
    return rows.withColumns({"category": F.when(often, "HIGH_FREQUENCY_EVENT").otherwise(F.col("category")), "severity": F.when(often, "WARNING").otherwise(F.col("severity"))})


def packets(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(seq, ts_us, severity, category, dedup_count, verdict, confidence, wants_sensors) of denoised, classified log rows.

    verdicts: (seq, verdict, confidence). Events that do not want sensors are UNCHECKED whatever the verdict.
    """
    out = classified(events).join(verdicts.select("seq", F.col("verdict").alias("_v"), F.col("confidence").alias("_c")), "seq", "left")
    checked = F.col("wants_sensors") & F.col("_v").isNotNull()
    return out.select("seq", "ts_us", "severity", "category", "dedup_count", F.when(checked, F.col("_v")).otherwise("UNCHECKED").alias("verdict"), F.when(checked, F.col("_c")).otherwise(0.0).alias("confidence"), "wants_sensors")


def every_nth(packets: DataFrame, n: int) -> DataFrame:
    """Of the packets that want sensors every nth by time, the first included."""
    rows = packets.where("wants_sensors")
    return rows if n == 1 else numbered(rows, ["ts_us", "seq"], "_r").where(F.col("_r") % n == 0).drop("_r")


def selection(packets: DataFrame, most: int = 50) -> DataFrame:
    """(place, seq, why): contradictions, then critical ones, then confirmed ones seen more than ten times, then warnings, up to most."""
    why = F.when(F.col("verdict") == "CONTRADICTED", 0).when(F.col("severity") == "CRITICAL", 1).when((F.col("verdict") == "CONFIRMED") & (F.col("dedup_count") > 10), 2).when(F.col("severity") == "WARNING", 3)
    rows = packets.select("seq", "ts_us", why.alias("why")).where("why is not null").orderBy("why", "ts_us", "seq").limit(most)
    return rows.select(F.row_number().over(Window.orderBy("why", "ts_us", "seq")).alias("place"), "seq", "why")
