"""Components against a plain search."""

import numpy as np
import pytest

from telescribe.operators import graph, logs


def plain(nodes, edges):
    top = {}

    def root(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("hub", [4096, 2])
def test_components(spark, monkeypatch, hub):
    """Paths, stars, rings, repeated edges, loops and lone nodes, with hubs joined apart or not."""
    monkeypatch.setattr(graph, "HUB", hub)
    rng = np.random.default_rng(3)
    edges = [(f"p{i:03d}", f"p{i + 1:03d}") for i in rng.permutation(60)] + [("s", f"s{i}") for i in range(30)] + [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] * 2 + [("x", "x")]
    edges += [(f"t{a}", f"t{b}") for a, b in rng.integers(0, 80, (60, 2))]
    nodes = sorted({x for e in edges for x in e}) + ["alone"]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame([tuple(map(str, e)) for e in edges], "a string, b string")).collect()}
    assert got == plain(nodes, edges)


def test_without_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    assert {tuple(r) for r in graph.components(nodes, spark.createDataFrame([], "a string, b string")).collect()} == {("a", "a"), ("b", "b")}
    assert graph.components(nodes.limit(0), spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("group", [None, lambda kind: kind.substr(1, 1)])
def test_edges_of_pairs_without_union(spark, group):
    """Types of two adjacent windows, one each: both meet twice, so that the union is 0; the pair is skipped, not divided by."""
    active = spark.createDataFrame([(1, "a1"), (2, "b1"), (5, "a2"), (5, "b2"), (9, "b2")], "w long, type string")
    for _ in range(2):
        got = logs.similarity_edges(active, 0.3, 0.2, group)
        assert [tuple(r) for r in got.collect()] == [("a2", "b2", 0.5)]
        active = active.repartition(3)


def test_components_of_larger_tables(spark):
    """components gives as many rows as types on a table where some pairs of types have no union; it failed there by a division."""
    from telescribe.plans import registry

    assert registry.QUERIES["components"](spark, "/root/testdata/sf0.1").count() > 12
