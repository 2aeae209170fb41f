"""Baselines of regimes, departures from them, and importance, on small series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telescribe.operators import sequences as S
from telescribe.plans import rules


def series(spark):
    counts = {"a": {1: 1, 2: 2, 3: 4}, "b": {2: 3, 3: 2, 5: 4}, "c": {4: 7, 5: 1}}
    prints = spark.createDataFrame([(w, "/x", t, n) for t, at in counts.items() for w, n in at.items()], "w long, node string, template string, n long")
    return prints, spark.createDataFrame([(0, w) for w in range(1, 6)], "regime long, w long")


def test_baseline_counts_missing_windows_from_the_first_on(spark):
    got = {r.template: r.expected for r in S.regime_baseline(*series(spark)).collect()}
    assert got == {"a": 1, "b": 2}


def test_only_the_most_unusual_window_is_reported(spark):
    prints, windows = series(spark)
    got = S.structural_anomalies(prints, windows, S.regime_baseline(prints, windows), F.lit(1.0)).collect()
    assert {(r.w, r.template, r.kind, r.expected, r.observed, r.score) for r in got} == {
        (4, "a", "missing_template", 1, 0, 1.0), (4, "b", "missing_template", 2, 0, 2.0), (4, "c", "new_template", 0, 7, 14.0),
    }


def test_transitions_compare_two_windows_on_each_side(spark):
    prints, _ = series(spark)
    windows = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4), (1, 5)], "regime long, w long")
    got = {(r.regime, r.w, r.template, r.kind.rsplit("_", 1)[1], r.score) for r in S.regime_transitions(prints, windows, F.lit(3.0)).collect()}
    assert got == {(1, 4, "a", "disappeared", 3.0), (1, 4, "c", "appeared", 6.0)}


def test_empty_tables(spark):
    prints, windows = (df.limit(0) for df in series(spark))
    baseline = S.regime_baseline(prints, windows)
    assert not baseline.count() and not S.structural_anomalies(prints, windows, baseline, F.lit(1.0)).count() and not S.regime_transitions(prints, windows, F.lit(1.0)).count()


def test_importance(spark):
    df = spark.createDataFrame([("/gs_console",), ("/other",), (None,)], "node string")
    assert [r[0] for r in df.select(rules.importance()).collect()] == [9, 4, 4]


def plain_changes(xs, sigmas):
    """(place, value) pairs in order: the places where the sum passes its limit."""
    if len(xs) < 3:
        return []
    values = [x for _, x in xs]
    mean = round(sum(values) / len(values), 9)
    std = round((sum((x - sum(values) / len(values)) ** 2 for x in values) / len(values)) ** 0.5, 9)
    out, total = [], 0.0
    for at, x in xs:
        total = max(0.0, total + x - mean)
        if total > mean + sigmas * (std if std > 0 else 1.0):
            out.append(at)
            total = 0.0
    return out


def plain_regimes(places, changes, least, begins):
    runs = [[]]
    for at in places:
        if begins and at in changes and runs[-1]:
            runs.append([])
        runs[-1].append(at)
        if not begins and at in changes:
            runs.append([])
    merged = []
    for run in filter(None, runs):
        if merged and len(run) < least:
            merged[-1] += run
        else:
            merged.append(run)
    return [(i, run[0], run[-1], len(run)) for i, run in enumerate(merged)]


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_change_points_in_blocks(spark, block):
    """Blocks that carry their sum on give what one run over the whole series gives; sources do not mix."""
    rng = np.random.default_rng(8)
    data = {"short": [(0, 1.0), (5, 9.0)], "flat": [(i, 2.0) for i in range(20)]}
    data |= {f"s{k}": [(i * (1 + k % 2), round(float(abs(rng.normal(1, 0.7)) + (2.5 if i % 40 > 30 else 0)), 4)) for i in range(150)] for k in range(4)}
    # a ramp whose sum goes on through many blocks
    data["ramp"] = [(i, round(0.001 * i * i, 4)) for i in range(60)]
    series = spark.createDataFrame([(s, at, x) for s, xs in data.items() for at, x in xs], "source string, w long, x double")
    changes = S.change_points(series, ["source"], "w", "x", sigmas=1.0, block=block)
    got = {(r.source, r.w) for r in changes.collect()}
    want = {s: plain_changes(xs, 1.0) for s, xs in data.items()}
    assert got == {(s, at) for s, found in want.items() for at in found} and len(want["s0"]) > 2 and want["ramp"]
    for begins in (False, True):
        found = S.regimes(series, changes, ["source"], "w", 3, begins, block)
        assert {(r.source, r.regime, r.first_w, r.last_w, r.windows) for r in found.collect()} == {(s, *x) for s, xs in data.items() for x in plain_regimes([at for at, _ in xs], set(want[s]), 3, begins)}
    whole = S.change_points(series.where("source = 's1'").select("w", "x"), [], "w", "x", sigmas=1.0, block=block)
    assert sorted(r.w for r in whole.collect()) == want["s1"]


def test_change_points_of_nothing(spark):
    none = spark.createDataFrame([], "source string, w long, x double")
    assert S.change_points(none, ["source"], "w", "x").count() == 0 and S.regimes(none, S.change_points(none, ["source"], "w", "x"), ["source"], "w").count() == 0
