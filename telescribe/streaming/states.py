"""Changes of state and departures of values as streams, with the state of each key kept between batches.

Rows may come late and out of order. Each key holds them until the watermark has passed, so that no earlier one can come,
and a timer then takes them in order. So a stream gives the rows that the batch operators give of the same input.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from telescribe.operators import logs as L
from telescribe.operators.values import Position

#: Timed states need a store that is not held in the executors' memory.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds that a key's rows are waited for at least beyond the watermark.
SPAN_MS = 1000


class InOrder(StatefulProcessor):
    """Holds a key's rows (ts_us, seq, ..) until the watermark has passed them, and hands them on in order.

    waiting: the columns of held rows; memory: what a key remembers, as the columns of one row.
    """

    waiting: str
    memory: str
    names: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.waiting)
        self.known = handle.getValueState("known", self.memory)

    def taken(self, key: tuple, rows: list[tuple], known: tuple | None) -> tuple[list[tuple], tuple]:
        """What rows in order give, and what the key remembers after them."""
        raise NotImplementedError

    def wake(self, ts_us: int) -> None:
        """Asks for a timer at the end of a row's span."""
        self.handle.registerTimer((-(-ts_us // 1000) // SPAN_MS + 1) * SPAN_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        columns = [c.split()[0] for c in self.waiting.split(", ")]
        for batch in rows:
            new = [tuple(x.item() if hasattr(x, "item") else x for x in row) for row in batch[columns].itertuples(index=False)]
            if new:
                self.held.appendList(new)
                low = min(row[0] for row in new)
                first = low if first is None else min(first, low)
        if first is not None:
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(row) for row in self.held.get()), key=lambda row: row[:2]) if self.held.exists() else []
        due, rest = [row for row in rows if row[0] <= passed], [row for row in rows if row[0] > passed]
        if rest:
            self.wake(rest[0][0])
        if not due:
            return
        self.held.put(rest) if rest else self.held.clear()
        found, known = self.taken(key, due, self.known.get() if self.known.exists() else None)
        self.known.update(known)
        if found:
            yield pd.DataFrame([(*key, *row) for row in found], columns=self.names)

    def close(self) -> None:
        pass


class Changes(InOrder):
    """Rows at which a state takes another value than before."""

    waiting, memory = "ts_us bigint, seq bigint, new_value string", "value string"
    names = ["bag", "state", "seq", "ts_us", "old_value", "new_value"]

    def taken(self, key: tuple, rows: list[tuple], known: tuple | None) -> tuple[list[tuple], tuple]:
        value, out = "<unknown>" if known is None else known[0], []
        for ts, seq, now in rows:
            if now != value:
                out.append((seq, ts, value, now))
            value = now
        return out, (value,)


class Departures(InOrder):
    """Values of a template in a regime that depart from those before."""

    waiting, memory = "ts_us bigint, seq bigint, values string", "updates bigint, positions string"
    names = ["node", "template", "regime", "seq", "ts_us", "position", "kind", "score", "expected", "got"]

    def taken(self, key: tuple, rows: list[tuple], known: tuple | None) -> tuple[list[tuple], tuple]:
        updates, held = (0, "{}") if known is None else known
        positions = {int(i): Position.restored(x) for i, x in json.loads(held).items()}
        out = []
        for ts, seq, values in rows:
            updates += 1
            # values travel as JSON, which tells null from NaN
            for i, x in enumerate(json.loads(values)):
                if x is None:
                    continue
                hit = positions.setdefault(i, Position()).add(float(x), updates)
                if hit:
                    out.append((seq, ts, i, hit[0], round(hit[1], 6), round(hit[2], 6), round(hit[3], 6)))
        return out, (updates, json.dumps({i: p.kept() for i, p in positions.items()}))


def _timed(rows: DataFrame, late: str) -> DataFrame:
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    return rows.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)


def state_changes(logs: DataFrame, late: str = "1 minute") -> DataFrame:
    """(bag, state, seq, ts_us, old_value, new_value) of a stream of log rows (bag, seq, ts_us, raw_message); see logs.state_changes().

    Rows that come later than the bound are left out, as are null times.
    """
    # every row moves the watermark, those without a state, too
    rows = L.state_values(_timed(logs, late), ("bag", "ts"))
    kind = dict(rows.dtypes)["bag"]
    schema = f"bag {kind}, state string, seq bigint, ts_us bigint, old_value string, new_value string"
    return rows.groupBy("bag", "state").transformWithStateInPandas(Changes(), schema, "Append", "EventTime")


def value_anomalies(rows: DataFrame, late: str = "1 minute") -> DataFrame:
    """(node, template, regime, seq, ts_us, position, kind, score, expected, got) of a stream of rows (seq, ts_us, node,
    template, regime, values array<double>); see values.value_anomalies()."""
    own = _timed(rows, late).where("size(values) > 0").withColumns({"regime": F.col("regime").cast("bigint"), "values": F.to_json("values")})
    schema = "node string, template string, regime bigint, seq bigint, ts_us bigint, position int, kind string, score double, expected double, got double"
    return own.groupBy("node", "template", "regime").transformWithStateInPandas(Departures(), schema, "Append", "EventTime")
