"""The Jaccard join against all pairs compared one by one."""

import itertools
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

from telescribe.llm import jaccard_join, queries
from telescribe.llm.jaccard_join import Params

SF = "/root/testdata/sf0.001"
#: Small bounds, so that lists become regions, regions are dealt out, and some are compared in blocks.
TIGHT = Params(long_list=3, region=6, pivots=4, depth=3)


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain(texts, percent=80, size=5):
    sets = {d: shingles(t, size) for d, t in texts.items()}
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def got(df, params=Params()):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(df, params=params).collect()}


def table(spark, texts):
    return spark.createDataFrame([(d, t, 0) for d, t in texts.items()], "doc_id long, text string, component_id int")


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = plain(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op13_jaccard_join(spark, SF).collect()} == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{Path(SF) / 'documents.parquet'}'")
    rows = con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({queries.SQL['op13_jaccard_join']})").fetchall()
    assert {d: (n, c) for d, n, c in rows} == want


def changed(rng, words, share):
    """The words, a share of them replaced by words of their own."""
    out = list(words)
    for i in rng.choice(len(out), int(share * len(out)), replace=False):
        out[i] = f"n{rng.integers(10**9)}"
    return out


def crowd(seed):
    """Groups of copies at all distances, texts of shared passages in many mixtures, and others alone."""
    rng = np.random.default_rng(seed)
    own = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    rows = []
    for _ in range(4):
        base = own(int(rng.integers(60, 160)))
        rows += [changed(rng, base, x) for x in rng.uniform(0, 0.06, 14)]
        # a chain: each a little further from the first
        for _ in range(6):
            base = changed(rng, base, 0.02)
            rows.append(base)
    passages = [own(20) for _ in range(6)]
    for _ in range(60):
        rows.append([w for k in rng.choice(6, 4, replace=False) for w in passages[k]] + own(int(rng.integers(0, 12))))
    hot = own(100)
    for i in range(40):
        rows.append(hot + own(7 + i % 9))
    rows += [own(int(rng.integers(1, 40))) for _ in range(10)]
    return {int(d): " ".join(w) for d, w in zip(rng.permutation(3 * len(rows))[: len(rows)], rows)}


@pytest.mark.parametrize("params", [Params(), TIGHT, Params(long_list=2, region=2, hashes=64, pivots=4, depth=1)], ids=["usual", "regions", "blocks"])
def test_crowd(spark, params):
    texts = crowd(1)
    assert got(table(spark, texts), params) == plain(texts)


def test_other_thresholds(spark):
    texts = crowd(2)
    for percent, size in ((60, 2), (90, 3)):
        assert got(table(spark, texts), Params(percent=percent, shingle=size, long_list=5, region=10)) == plain(texts, percent, size)


def test_odd_rows(spark):
    """Nulls, empty and very long texts, ties at the threshold, repeated rows, null ids and clashing columns."""
    nine = "a b c d e f g h i j k l m"
    texts = [None, "", " \n\t ", "one", "ONE", "one two", "one two three four five", "One two\nthree four  five", nine, nine + " n n2", nine + " n", "long text " * 20_000, "long text " * 20_001, "é É ß ǅ İ x y", "é É ß ǅ İ x y"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, nine, 0), (3, "zz one", 1), (3, "one", 1)], "doc_id long, text string, digest int")
    assert got(df) == plain(dict(enumerate(texts)))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert got(none) == {}
    assert got(spark.createDataFrame([(4, None), (2, "")], "doc_id long, text string")) == {4: (0, 4), 2: (0, 2)}


def test_regions_are_dealt_out(spark, monkeypatch):
    """The crowd's lists do become regions, and some of these are dealt out to pivots."""
    seen = []
    real = jaccard_join.join_regions
    monkeypatch.setattr(jaccard_join, "join_regions", lambda items, *rest: seen.append(items.groupBy("region").count().agg({"count": "max"}).first()[0]) or real(items, *rest))
    got(table(spark, crowd(1)), TIGHT)
    assert max(seen) > 4 * TIGHT.region
