"""Causal chains: log anomalies whose types occur together, or that stand at one change of regime.

Anomalies: (seq, w, ts, node, template, kind, score). A type is node, template and kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telescribe.operators.graph import components
from telescribe.operators.scratch import checkpointed, discard
from telescribe.operators.logs import cooccurrence, similarity_edges
from telescribe.plans import rules

#: Kinds that stand at a change of regime.
TRANSITIONS = ("regime_transition_appeared", "regime_transition_disappeared")
MARK = "\x1f"


def type_of(keys: Sequence[str] = ()) -> Column:
    return F.concat_ws(MARK, "node", "template", "kind", *keys)


def subsystem(kind: Column) -> Column:
    """The subsystem of a type's node; null for none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in rules.SUBSYSTEMS.items() for x in pair]), F.split(kind, MARK)[0])


def roots(members: DataFrame, importance: Column) -> DataFrame:
    """(chain, root): of each chain's members the one of most important node, then the earliest, then the smallest seq."""
    return members.groupBy("chain").agg(F.max_by("seq", F.struct(importance.alias("i"), (-F.col("ts")).alias("t"), (-F.col("seq")).alias("s"))).alias("root"))


def chained(anomalies: DataFrame, importance: Column | None = None, least: float = 0.5, kin: float = 0.3, keys: Sequence[str] = ()) -> DataFrame:
    """(seq, chain, how): the anomalies that belong to a chain. how: transition (two or more at one time) or together.

    keys: columns that keep sources apart.
    """
    moves = anomalies.where(F.col("kind").isin(*TRANSITIONS))
    many = moves.groupBy(*keys, "ts").agg(F.count("*").alias("_n")).where("_n >= 2").select(*keys, "ts")
    at_once = moves.join(many, [*keys, "ts"], "left_semi").select("seq", F.concat_ws(MARK, F.concat(F.lit("at "), F.col("ts").cast("string")), *keys).alias("chain"), F.lit("transition").alias("how"))
    rest = anomalies.join(at_once.select("seq"), "seq", "left_anti").withColumn("type", type_of(keys))
    edges = checkpointed(similarity_edges(rest.select(*keys, "w", "type"), least, kin, subsystem, keys).select(F.col("type_a").alias("a"), F.col("type_b").alias("b")))
    comp = components(rest.select(F.col("type").alias("node")), edges)
    # types that no other goes with are no chain
    comp = comp.join(comp.groupBy("component").agg(F.count("*").alias("_n")).where("_n >= 2").select("component"), "component", "left_semi")
    together = rest.join(comp.select(F.col("node").alias("type"), F.concat(F.lit("of "), F.col("component")).alias("chain")), "type").select("seq", "chain", F.lit("together").alias("how"))
    return at_once.unionByName(together)


def causal_chains(anomalies: DataFrame, importance: Column | None = None, least: float = 0.5, kin: float = 0.3, keys: Sequence[str] = ()) -> DataFrame:
    """(chain_id, how, root, severity, types, members, first_ts, last_ts, jaccard), the most severe first, from 0.

    Severity of what occurs together: the root's importance, times types, times log2 of 1 + windows; of a change of regime:
    importance times members times 2. jaccard: the mean over all pairs of the chain's types; 1 for a change of regime.
    keys: columns that keep sources apart; they come first, and each source's chains have numbers of their own.
    """
    importance = rules.importance() if importance is None else importance
    anomalies = checkpointed(anomalies)
    members = checkpointed(anomalies.join(chained(anomalies, importance, least, kin, keys), "seq").withColumn("type", type_of(keys)))
    root = roots(members, importance)
    weight = members.select(F.col("seq").alias("root"), importance.alias("weight"))
    own = members.groupBy(*keys, "chain", "how").agg(F.countDistinct("type").alias("types"), F.count("*").alias("members"), F.countDistinct("w").alias("windows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    own = own.join(root, "chain").join(weight, "root")
    severity = F.when(F.col("how") == "transition", F.col("weight") * F.col("members") * 2.0).otherwise(F.col("weight") * F.col("types") * F.log2(F.lit(1.0) + F.col("windows")))
    # similarity of all pairs of a chain's types: of those that never meet it is 0
    kinds = members.where("how = 'together'").select("chain", "type").distinct()
    rest = anomalies.withColumn("type", type_of(keys)).join(members.where("how = 'transition'").select("seq"), "seq", "left_anti")
    sizes = rest.select(*keys, "w", "type").distinct().groupBy("type").agg(F.count("*").alias("s"))
    pairs = cooccurrence(rest, keys)
    pairs = pairs.join(kinds.select(F.col("type").alias("type_a"), "chain"), "type_a").join(kinds.select(F.col("type").alias("type_b"), F.col("chain").alias("c")), "type_b").where("chain = c")
    pairs = pairs.join(sizes.select(F.col("type").alias("type_a"), F.col("s").alias("s_a")), "type_a").join(sizes.select(F.col("type").alias("type_b"), F.col("s").alias("s_b")), "type_b")
    union = F.col("s_a") + F.col("s_b") - F.col("n")
    # pairs without a positive union are no part of the mean
    alike = pairs.groupBy("chain").agg(F.sum(F.when(union > 0, F.col("n") / union)).alias("sum"), F.sum((union <= 0).cast("int")).alias("out"))
    own = own.join(alike, "chain", "left")
    every = F.col("types") * (F.col("types") - 1) / 2 - F.coalesce("out", F.lit(0))
    jaccard = F.when(F.col("how") == "transition", 1.0).when(every > 0, F.coalesce("sum", F.lit(0.0)) / every).otherwise(0.0)
    out = own.select(*keys, "chain", "how", "root", F.round(severity + 1e-9, 2).alias("severity"), "types", "members", "first_ts", "last_ts", F.round(jaccard + 1e-9, 3).alias("jaccard"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("severity"), "first_ts", "root")) - 1  # chains are few: one row each
    out = checkpointed(out.withColumn("chain_id", number))
    discard(anomalies, members)
    return out


def isolated(anomalies: DataFrame, links: DataFrame) -> DataFrame:
    """The anomalies of no chain. links: chained()."""
    return anomalies.join(links.select("seq"), "seq", "left_anti")


def boosted(chains: DataFrame, members: DataFrame, validated: list[dict]) -> DataFrame:
    """chains with severity raised by 1 + confidence of the first validated rule whose root node is among the members' nodes.

    members: (chain, node). Adds rule, null for none. The rules' template patterns are not looked at.
    """
    usable = [(i, r["root"][0], float(r.get("confidence", 0.5)), r.get("name", "unnamed_rule")) for i, r in enumerate(validated) if r.get("root") and r["root"][0]]
    if not usable:
        return chains.withColumn("rule", F.lit(None).cast("string"))
    table = chains.sparkSession.createDataFrame(usable, "i int, node string, confidence double, rule string")
    hit = members.select("chain", "node").distinct().join(F.broadcast(table), "node").groupBy("chain").agg(F.min(F.struct("i", "confidence", "rule")).alias("r"))
    out = chains.join(hit, "chain", "left")
    return out.withColumns({"severity": F.col("severity") * (1 + F.coalesce("r.confidence", F.lit(0.0))), "rule": F.col("r.rule")}).drop("r")


def annotated(anomalies: DataFrame, chains: DataFrame, links: DataFrame) -> DataFrame:
    """(seq, ts, line): one line an anomaly with its chain's number and severity, or ISOLATED."""
    tag = links.join(chains.select("chain", "chain_id", "severity"), "chain").select("seq", F.concat(F.lit("CHAIN["), F.col("chain_id").cast("string"), F.lit("]")).alias("tag"))
    rows = anomalies.join(tag, "seq", "left").withColumn("tag", F.coalesce("tag", F.lit("ISOLATED")))
    line = F.concat_ws(" ", F.rpad("kind", 25, " "), F.rpad("node", 35, " "), F.concat(F.lit("["), F.rpad(F.substring("template", 1, 50), 50, " "), F.lit("]")), "tag")
    return rows.select("seq", "ts", line.alias("line"))
