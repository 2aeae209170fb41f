"""Joins and window helpers that the analytics share, as compositions of built-in operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telescribe.operators.scratch import checkpointed


#: Added before rounding, so that exact halves round alike whatever the order of summing.
TIE = 1e-9


#: Width of the spans of time that a key's rows are dealt out by.
SPAN_US = 3_600_000_000


def neighbour(df: DataFrame, keys: list[str], on: str, seq: str, names: dict[str, str], after: bool = False, span: int = SPAN_US) -> DataFrame:
    """Adds, by new name, columns of the row before (or after) a row of the same keys, in order of on and seq.

    Rows are dealt out by keys and span, so that a key of any size is many tasks; what a span needs of others is one row
    a span, the only ones that are put in order key by key.
    """
    by = [F.col(c).desc() if after else F.col(c).asc() for c in (on, seq)]
    value = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    rows = df.withColumn("_span", F.floor(F.col(on) / span))
    edge = (F.min_by if after else F.max_by)(value, F.struct(on, seq)).alias("_edge")
    turn = Window.partitionBy(*keys).orderBy(F.col("_span").desc() if after else F.col("_span").asc())
    edges = rows.groupBy(*keys, "_span").agg(edge).withColumn("_edge", F.lag("_edge").over(turn))
    near = F.coalesce(F.lag(value).over(Window.partitionBy(*keys, "_span").orderBy(*by)), "_edge")
    out = rows.join(edges, [*keys, "_span"], "left").withColumn("_near", near)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_near.{n}").alias(n) for n in names])


def asof(probes: DataFrame, changes: DataFrame, keys: list[str], value: str, on: str = "ts_us", span: int = SPAN_US) -> DataFrame:
    """Backward inclusive as-of join: to each probe the last non-null value of its keys at or before its time.

    A change at the probe's very time counts. changes: (keys, on, seq, value), worked out once. Work is dealt out by keys
    and span; the last value of each span, one row, is carried into those behind it.
    """
    name = f"{value}_asof"
    c = checkpointed(changes.select(*keys, on, "seq", value)).select(*keys, on, F.lit(0).alias("_kind"), "seq", F.col(value).alias(name))
    rows = probes.withColumn("_kind", F.lit(1)).unionByName(c, allowMissingColumns=True).withColumn("_span", F.floor(F.col(on) / span))
    # probes have no value of their own, so they leave a span's last one alone
    ends = rows.groupBy(*keys, "_span").agg(F.max_by(F.when(F.col(name).isNotNull(), F.col(name)), F.when(F.col(name).isNotNull(), F.struct(on, "seq"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_end", F.last("_end", True).over(before))
    w = Window.partitionBy(*keys, "_span").orderBy(on, "_kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(ends, [*keys, "_span"], "left").withColumn(name, F.coalesce(F.last(name, True).over(w), "_end"))
    return out.where("_kind = 1").select(*probes.columns, name)


def near(left: DataFrame, right: DataFrame, reach: int, l_on: str, r_on: str, keys: list[str] = ()) -> DataFrame:
    """Pairs whose times lie at most reach apart: an equi-join on time buckets, the right side in three of them."""
    a = left.withColumn("_b", F.floor(F.col(l_on) / reach))
    b = right.withColumn("_b", F.explode(F.array(*[F.floor(F.col(r_on) / reach) + i for i in (-1, 0, 1)])))
    return a.join(b, [*keys, "_b"]).where(F.abs(F.col(l_on) - F.col(r_on)) <= reach).drop("_b")


def sessions(df: DataFrame, keys: list[str], on: str, gap: int, seq: str = "seq", end: str | None = None, span: int = SPAN_US) -> DataFrame:
    """Adds session: a new one begins where a row lies more than gap after the (end of the) row before it.

    Each span counts its own breaks; of a span the others need one row, its first time, last end and breaks.
    """
    turn = Window.partitionBy(*keys, "_span").orderBy(on, seq)
    rows = df.withColumns({"_span": F.floor(F.col(on) / span), "_end": F.col(end or on)})
    rows = rows.withColumn("_new", F.coalesce((F.col(on) - F.lag("_end").over(turn) > gap).cast("int"), F.lit(0))).withColumn("_local", F.sum("_new").over(turn))
    order = Window.partitionBy(*keys).orderBy("_span")
    edges = rows.groupBy(*keys, "_span").agg(F.min(on).alias("_first"), F.max_by("_end", F.struct(on, seq)).alias("_last"), F.sum("_new").alias("_breaks"))
    edges = edges.withColumn("_opens", F.coalesce((F.col("_first") - F.lag("_last").over(order) > gap).cast("int"), F.lit(0)))
    before = F.sum(F.col("_opens") + F.col("_breaks")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_breaks")
    edges = edges.withColumn("_before", before).select(*keys, "_span", "_before")
    return rows.join(edges, [*keys, "_span"]).withColumn("session", F.col("_before") + F.col("_local")).select(*[F.col(f"`{c}`") for c in df.columns], "session")


def ranked(df: DataFrame, keys: list[str], on: str, seq: str, name: str, span: int = SPAN_US) -> DataFrame:
    """Adds the place of each row among those of its keys, from 1, in order of on and seq; a span needs one number of those before it."""
    rows = df.withColumn("_span", F.floor(F.col(on) / span))
    past = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    counts = rows.groupBy(*keys, "_span").agg(F.count("*").alias("_n")).withColumn("_past", F.coalesce(F.sum("_n").over(past), F.lit(0))).drop("_n")
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(on, seq)))
    return own.join(counts, [*keys, "_span"]).withColumn(name, F.col("_past") + F.col("_own")).drop("_span", "_own", "_past")


def running_max(df: DataFrame, keys: list[str], seq: str, value: Column, name: str, block: int = 1 << 20) -> DataFrame:
    """Adds the largest value so far in order of seq; blocks of seq are tasks of their own, and carry one number on."""
    rows = df.withColumns({name: value, "_block": F.floor(F.col(seq) / block)})
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "_block").agg(F.max(name).alias("_top")).withColumn("_top", F.max("_top").over(before))
    so_far = F.max(name).over(Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(tops, [*keys, "_block"]).withColumn(name, F.greatest(so_far, "_top")).drop("_block", "_top")


def window_index(ts: Column, start: Column, width: int) -> Column:
    """Windows from start on that hold their right edge; the start itself lies in the first."""
    return F.greatest(F.ceil((ts - start) / width) - 1, F.lit(0)).cast("bigint")


def moments(value: Column) -> list[Column]:
    """Count, mean, sample deviation (0 for one row), minimum and maximum; NaN and infinities are left out."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return [F.count(v).alias("n"), F.round(F.avg(v) + TIE, 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std"), F.min(v).alias("low"), F.max(v).alias("high")]


def numbered(df: DataFrame, by: Sequence[str | Column], name: str) -> DataFrame:
    """Adds the place of each row, from 0, in the order of by; equal rows stand in any order.

    Rows are dealt out by ranges and sorted within each; a range needs of those before it their number of rows, one number
    a range, so that no task sees all rows.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in by]
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = placed.groupBy(part).agg(F.count("*").alias("_n")).withColumn("_past", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    out = placed.withColumn("_part", part).join(F.broadcast(counts.select("_part", "_past")), "_part")
    return out.withColumn(name, F.col("_past") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_past", "_at")
