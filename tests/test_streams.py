"""Streams with late rows give what the batch operators give of the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from telescribe.operators import logs as L
from telescribe.operators import values as V
from telescribe.streaming import states


def streamed(spark, tmp_path, rows, schema, fn, name):
    """fn of rows that come in files of a few, each batch out of order; a row far ahead lets all timers end."""
    folder = tmp_path / name
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    out = fn(stream)
    query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}_at")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return [tuple(r) for r in spark.table(name).collect()]


def shuffled(rng, rows, late, parts, ahead):
    """rows in order of arrival, each up to late places behind, cut in parts, and one row far ahead."""
    order = np.argsort(np.arange(len(rows)) + rng.uniform(0, late, len(rows)))
    cuts = np.array_split(order, parts)
    return [[rows[i] for i in cut] for cut in cuts] + [[ahead]]


def test_state_changes(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        text = [f"still_flag: {rng.integers(0, 2)}", f"localization_status {rng.integers(0, 3)}", "heartbeat ok", "battery level: 57"][int(rng.integers(0, 4))]
        rows.append((int(i % 2), i, i * 1_000_000 + 10**15, text))
    schema = "bag long, seq long, ts_us long, raw_message string"
    want = {tuple(r) for r in L.state_changes(spark.createDataFrame(rows, schema), ("bag",)).select("bag", "state", "seq", "ts_us", "old_value", "new_value").collect()}
    got = streamed(spark, tmp_path, shuffled(rng, rows, 20, 4, (9, 999, 10**15 + 10**12, "heartbeat ok")), schema, lambda s: states.state_changes(s, "30 seconds"), "changes")
    assert len(got) == len(want) > 20 and set(got) == want


def test_value_anomalies(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(150):
        steady = 5 + 0.01 * math.sin(i) if i % 60 != 50 else 9.0
        rows += [(2 * i, i * 1_000_000 + 10**15, "/n", "steady #", i // 100, [steady, float(3 * i + (500 if i == 70 else 0))]), (2 * i + 1, i * 1_000_000 + 10**15, "/m", "state #", 0, [float(i // 40 % 2), None])]
    schema = "seq long, ts_us long, node string, template string, regime long, values array<double>"
    names = ["node", "template", "regime", "seq", "ts_us", "position", "kind", "score", "expected", "got"]
    want = {tuple(r) for r in V.value_anomalies(spark.createDataFrame(rows, schema)).select(names).collect()}
    ahead = (10**6, 10**15 + 10**12, "/z", "last", 0, [1.0])
    got = streamed(spark, tmp_path, shuffled(rng, rows, 20, 4, ahead), schema, lambda s: states.value_anomalies(s, "30 seconds"), "departures")
    assert {k[6] for k in want} == {"value_deviation", "counter_anomaly", "state_transition"}
    assert len(got) == len(want) and set(got) == want


def test_rows_beyond_the_bound_are_left_out(spark, tmp_path):
    schema = "bag long, seq long, ts_us long, raw_message string"
    at = lambda s: 10**15 + s * 1_000_000
    rows = [[(0, 1, at(0), "still_flag: 0"), (0, 2, at(100), "still_flag: 1")], [(9, 8, at(101), "heartbeat")], [(0, 3, at(5), "still_flag: 1"), (0, 4, at(95), "still_flag: 0")], [(9, 9, at(10**6), "heartbeat")]]
    got = streamed(spark, tmp_path, rows, schema, lambda s: states.state_changes(s, "10 seconds"), "late")
    # the row of 5 s is far behind, the one of 95 s is not
    assert sorted(r[2] for r in got) == [1, 2]


@pytest.mark.parametrize("n", [0, 1, 40])
def test_positions_are_kept(n):
    """A position restored from what it kept goes on as if nothing had happened."""
    xs = [float(i % 7) if i < 25 else 50.0 + i for i in range(80)]
    one, two = V.Position(), V.Position()
    for i, x in enumerate(xs, 1):
        a, b = one.add(x, i), two.add(x, i)
        assert a == b
        if n and i % n == 0:
            two = V.Position.restored(two.kept())


def test_windows_and_bins(spark, tmp_path):
    """Windows and sessions of a stream against the same groups of a table."""
    from telescribe.streaming import telemetry

    rows = [("b", "/t", "x", float(i % 7), "c", 10**15 + 1_000_000 * (i if i < 60 else i + 40)) for i in range(100)]
    schema = "bag string, topic string, field string, value double, category string, ts_us long"
    timed = lambda df: df.withColumn("ts", F.timestamp_micros("ts_us"))
    ahead = ("z", "/z", "z", 0.0, "z", 10**15 + 10**12)
    got = streamed(spark, tmp_path, [rows[:50], rows[50:], [ahead]], schema, lambda s: telemetry.windowed_stats(timed(s)), "windows_of")
    batch = timed(spark.createDataFrame(rows, schema))
    want = batch.groupBy(F.window("ts", "30 seconds").alias("w"), "bag", "topic", "field").agg(F.count("*").alias("n"), F.round(F.avg("value") + 1e-9, 6).alias("mean")).collect()
    assert {(r[3], r[5], r[6]) for r in got} == {(r.w.start, r.n, r["mean"]) for r in want} and len(got) == len(want) > 3
    bins = streamed(spark, tmp_path, [rows[:50], rows[50:], [ahead]], schema, lambda s: telemetry.incident_bins(timed(s)), "bins_of")
    assert sorted(r[2] for r in bins) == [40, 60]
