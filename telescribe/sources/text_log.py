"""Text logs of the form [LEVEL][H:MM:SS.mmm AM ZONE][/node]: message."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telescribe.functions.text import clock_ms
from telescribe.operators.relational import neighbour

# The shape of a line, and the ranks of levels (others rank as INFO).
LINE = r"(?s)^\s*\[\s*(\w+)\s*\]\[(\d{1,2}:\d{2}:\d{2}\.\d{3})(?:\s*(AM|PM))?(?:\s+\w+)?\]\[(/[^\]]+)\]:\s*(.*)"
RANKS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3, "FATAL": 4}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, seq, line) of text files: lines in order of seq, from 1 in each file; an empty file has none.

    Files are split like any text source's. A first pass counts the lines of each split, whose running sums, a row a
    split, say how many lines come before it; a second pass numbers the lines from there on, as they are read. Only line
    feeds end lines, and carriage returns before them go; compressed files are one split.
    """
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_from")]
    rows = spark.read.option("lineSep", "\n").text(path).select(*place, "value")
    before = Window.partitionBy("_path").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("_path", "_from").agg(F.count("*").alias("_lines")).withColumn("_past", F.coalesce(F.sum("_lines").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of each line in its split; a task reads the lines of a split one after the other."""
        split, n = None, 0
        for batch in batches:
            own = batch.column(1).to_numpy()
            # a split begins where the place changes, or at the same place of another file
            paths = batch.column(0)
            for at, to in runs(paths, own):
                now = (paths[at].as_py(), int(own[at]))
                split, n = now, (n if now == split else 0)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.arange(n + 1, n + 1 + to - at))], names=["_path", "_from", "value", "_at"])
                n += to - at

    numbered = rows.mapInArrow(run, "_path string, _from bigint, value string, _at bigint")
    out = numbered.join(F.broadcast(splits.select("_path", "_from", "_past")), ["_path", "_from"])
    return out.select(F.element_at(F.split("_path", "/"), -1).alias("source_file"), (F.col("_past") + F.col("_at")).alias("seq"), F.regexp_replace("value", r"\r+$", "").alias("line"))


def runs(paths: pa.Array, places: np.ndarray) -> list[tuple[int, int]]:
    """(first, past the last) of the runs of rows of one path and place."""
    if not len(places):
        return []
    codes = paths.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((places[1:] != places[:-1]) | (codes[1:] != codes[:-1])) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]))


def parsed(lines: DataFrame, least: str = "DEBUG") -> DataFrame:
    """level, clock_ms, node and raw_message of the lines of that shape from a level on; other lines go. lines: (.., line)."""
    part = lambda i: F.regexp_extract("line", LINE, i)
    rank = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in RANKS.items()], F.lit(RANKS["INFO"]))
    out = lines.where(F.col("line").rlike(LINE)).withColumns(
        {"level": F.upper(part(1)), "clock_ms": clock_ms(part(2), F.nullif(part(3), F.lit(""))), "node": part(4), "raw_message": part(5)}
    )
    return out.where(rank >= RANKS[least]).drop("line")


def rolled_over(rows: DataFrame, file: str, line: str, drop_ms: int = 3_600_000, block: int = 1 << 18) -> DataFrame:
    """Adds timestamp_ms: clock_ms, with a day more from each line on whose clock lies over drop_ms behind the line before.

    Lines are dealt out by file and block of line numbers; what a block needs of those before is one row a block.
    """
    keys = [file]
    own = neighbour(rows.withColumn("_seq", F.col(line)), keys, line, "_seq", {"_before": "clock_ms"}, span=block).drop("_seq")
    own = own.withColumns({"_behind": F.coalesce((F.col("_before") - F.col("clock_ms") > drop_ms).cast("bigint"), F.lit(0).cast("bigint")), "_block": F.floor(F.col(line) / block)})
    # days so far: the number of drops, which only grows
    return days(own, keys, line).withColumn("timestamp_ms", F.col("clock_ms") + F.col("_days") * 86_400_000).drop("_behind", "_before", "_block", "_days")


def days(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_behind").alias("_sum")).withColumn("_past", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    own = F.sum("_behind").over(Window.partitionBy(*keys, "_block").orderBy(line))
    return rows.join(sums, [*keys, "_block"]).withColumn("_days", own + F.col("_past")).drop("_past")
