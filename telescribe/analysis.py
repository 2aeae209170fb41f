"""Whole analyses: recordings to incidents and missions, and logs to regimes, anomalies and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telescribe.operators import chains as C
from telescribe.operators import diagnose as D
from telescribe.operators import incidents as I
from telescribe.operators import logs as L
from telescribe.operators import sequences as S
from telescribe.operators import validate as X
from telescribe.operators import values as V
from telescribe.operators.scratch import checkpointed, discard
from telescribe.plans import rules
from telescribe.sinks import reports
from telescribe.sources import catalog, messages, recording

#: A pause that parts missions.
MISSION_GAP_US = 300_000_000


def diagnose(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Of the recordings below a folder: bags, missions, logs, changes, anomalies, incidents, health and summary."""
    # files are unpacked and decoded once
    rows = checkpointed(recording.read(spark, folder))
    signals, logs = checkpointed(messages.signals(rows)), checkpointed(L.classified(messages.logs(rows)))
    bags = rows.groupBy("bag").agg(F.floor(F.min("ts_ns") / 1000).alias("start_us"), F.floor(F.max("ts_ns") / 1000).alias("end_us"))
    found = D.described(D.anomalies(signals, messages.texts(rows)))
    # rules give rows without a number; their content orders them
    found = checkpointed(found.withColumn("seq", F.xxhash64("bag", "category", "topic", "field", "ts_us", "value").bitwiseAND(F.lit((1 << 62) - 1))))
    changes = checkpointed(L.state_changes(messages.logs(rows), ("bag",)))
    built = checkpointed(I.incidents(found, logs, changes))
    grouped = missions(bags)
    return {
        "bags": bags, "missions": grouped, "logs": logs, "changes": changes, "anomalies": found, "incidents": built, "health": L.health(found, bags, built),
        "summary": I.mission_summary(grouped, bags, built, found, logs, changes),
    }


def validate(spark: SparkSession, folder: str, sample: int = 1, sensors: bool = True) -> X.Validation:
    """The log texts of the recordings below a folder held against their sensors; see validate.cross_validated()."""
    rows = checkpointed(recording.read(spark, folder))
    signals = checkpointed(messages.signals(rows))
    found = X.cross_validated(signals, messages.logs(rows), sample=sample, sensors=sensors)
    discard(rows, signals)
    return found


def missions(bags: DataFrame, gap_us: int = MISSION_GAP_US) -> DataFrame:
    """(bag, mission): recordings in order of start; see logs.missions()."""
    return L.numbered_missions(bags, gap_us).select("bag", "mission")


def extract(source: catalog.LogSource, sigmas: float = 3.0, validated: list[dict] = ()) -> dict[str, DataFrame]:
    """Of a source's log records: profiles, windows, regimes, anomalies, chains, members and isolated anomalies.

    Every file is analysed by itself, with its own width of windows, regimes and chains; source_file tells them apart.
    """
    k = ["source_file"]
    rows = checkpointed(source.records().withColumn("ts_us", (F.col("timestamp_ms") * 1000).cast("bigint")))
    profiles = checkpointed(L.node_profiles(rows, ("periodic", "quasi_periodic", "event_driven"), keys=k))
    ends = rows.groupBy(*k).agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    widths = L.auto_window_ms(profiles, keys=k)
    # a row a file
    ends = checkpointed(ends.join(widths, k).withColumn("width_us", (F.col("width_ms") * 1000).cast("bigint")))
    prints = checkpointed(L.fingerprints(rows.join(F.broadcast(ends), k), F.col("width_us"), F.col("start_us"), F.col("end_us"), in_order=True, keys=k))
    ratios = L.normalised(prints, profiles.join(F.broadcast(ends.select(*k, "width_ms")), k), F.col("width_ms"), ("periodic", "quasi_periodic"), keys=k)
    regimes = checkpointed(S.log_regimes(L.window_deviation(ratios, "ratio", keys=k), k, sigmas))
    windows = checkpointed(regimes.select(*k, "regime", F.explode(F.sequence("first_w", "last_w")).alias("w")))
    baseline = S.regime_baseline(prints, windows, k)
    weight = rules.importance()
    structural = S.structural_anomalies(prints, windows, baseline, weight, keys=k).unionByName(S.regime_transitions(prints, windows, weight, keys=k), allowMissingColumns=True)
    start = F.broadcast(ends.select(*k, "start_us", "width_us"))
    window = F.floor((F.col("ts_us") - F.col("start_us")) / F.col("width_us"))
    structural = structural.join(start, k).select(*k, "node", "template", "kind", "w", (F.col("start_us") + F.col("w") * F.col("width_us")).alias("ts"), "score")
    # a value behind the last window lies in that one's regime
    last = regimes.groupBy(*k).agg(F.max("last_w").alias("last_w"))
    placed = rows.join(start, k).join(F.broadcast(last), k, "left").withColumn("w", F.least(window, "last_w")).join(windows, [*k, "w"], "left")
    valued = V.value_anomalies(placed, "source_file").join(start, k).select(*k, "node", "template", "kind", window.alias("w"), F.col("ts_us").alias("ts"), "score")
    found = checkpointed(structural.unionByName(valued).withColumn("seq", F.xxhash64(*k, "node", "template", "kind", "w", "ts", "score").bitwiseAND(F.lit((1 << 62) - 1))))
    links = checkpointed(C.chained(found, keys=k))
    members = found.join(links, "seq")
    chains = checkpointed(C.boosted(C.causal_chains(found, keys=k), members.select("chain", "node"), list(validated)))
    discard(rows, windows)
    return {"profiles": profiles, "windows": prints, "regimes": regimes, "anomalies": found, "chains": chains, "members": members, "isolated": C.isolated(found, links), "ends": ends}


def summary(found: dict[str, DataFrame], source_file: str, metadata: dict | None = None) -> dict:
    """What extract() found in one file as a report of bounded size, for reports.prompt() and reports.as_json()."""
    of = {name: df.where(F.col("source_file") == source_file) for name, df in found.items()}
    ends = of["ends"].first()
    ms = lambda w: (ends["start_us"] + w * ends["width_us"]) / 1000.0
    often = of["windows"].groupBy("node", "template").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "template"))  # a row a template
    often = often.withColumn("_r", first).where(F.col("_r") <= reports.MOST_TEMPLATES).groupBy("node").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "template")))).alias("templates"))
    nodes = of["profiles"].select("node", "kind", "rate_hz", "cv").join(often, "node", "left").withColumn("templates", F.coalesce("templates", F.array().cast(often.schema["templates"].dataType)))
    regimes = of["regimes"].select("regime", "windows", ms(F.col("first_w")).alias("start_ms"), ms(F.col("last_w") + 1).alias("end_ms"))
    root = of["anomalies"].select(F.col("seq").alias("root"), "node", "kind", "template")
    chains = of["chains"].join(root, "root").select("chain_id", "severity", "node", "kind", "template", (F.col("first_ts") / 1000).alias("first_ms"), (F.col("last_ts") / 1000).alias("last_ms"), "jaccard", "members")
    rest = of["members"].join(of["chains"].select("chain", "chain_id", "root"), "chain").where("seq <> root")
    types = rest.groupBy("chain_id", "node", "kind", "template").agg(F.count("*").alias("n"))
    alone = of["isolated"].select("seq", "score", "node", "kind", "template", (F.col("ts") / 1000).alias("ms"))
    meta = {"source_file": source_file, "duration_ms": (ends["end_us"] - ends["start_us"]) / 1000.0} | (metadata or {})
    return reports.bounded_report(meta, nodes, regimes, chains, types, alone, of["anomalies"].count())
