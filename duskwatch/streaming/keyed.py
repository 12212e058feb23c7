"""Streams that keep something for each key: repeats within seconds of a first sight, the newest events, freshness.

State is keyed and lives in the store of the checkpoint, so a restarted stream goes on where it stopped. Each state
is bounded: one time and a count, or the newest few events. A timer drops what can't matter any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that keyed state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEWEST, STALE_SECONDS = 100, 900


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _FirstSight(StatefulProcessor):
    """Opens a window at the first event of a key; events before its end are repeats of it."""

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        first, kept = self.first.get()[0] if self.first.exists() else None, []
        for at, number in zip(events["at"].tolist(), events["id"].tolist()):
            if first is None or at >= first + self.micros:
                first = at
                kept.append((key[0], number, at))
        self.first.update((first,))
        self.handle.registerTimer((first + self.micros) // 1000)
        yield pd.DataFrame(kept, columns=["key", "id", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.first.exists() and (self.first.get()[0] + self.micros) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.first.clear()
        yield pd.DataFrame({"key": [], "id": [], "at": []})

    def close(self) -> None:
        pass


class _Newest(StatefulProcessor):
    """The newest events of a key, handed on as a whole whenever some come."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(x) for x in self.held.get()]
        for part in rows:
            held = sorted([*held, *zip(part["at"].tolist(), part["id"].tolist())], key=lambda x: (-x[0], x[1]))[: self.most]
        self.held.put(held)
        yield pd.DataFrame([(key[0], i, n, at) for i, (at, n) in enumerate(held, 1)], columns=["key", "place", "id", "at"])

    def close(self) -> None:
        pass


def _slim(stream: DataFrame, key: str, ts: str, number: str) -> DataFrame:
    return stream.filter(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(number).cast("long").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(ts).cast("timestamp").alias("time"))


def first_sights(stream: DataFrame, key: str, ts: str, number: str, seconds: float = 5.0, late: str = "1 hour") -> DataFrame:
    """(key, id, at): of each key the events that are no repeats: the first, and each that comes ``seconds`` or more after the last one kept.

    Events of a batch count in order of time, then number; events without a time are left out, those later than ``late``
    too. ``at`` is in microseconds.
    """
    use_keyed_state(stream.sparkSession)
    slim = _slim(stream, key, ts, number).withWatermark("time", late)
    kind = dict(slim.dtypes)["key"]
    return slim.groupBy("key").transformWithStateInPandas(_FirstSight(int(seconds * 1_000_000)), f"key {kind}, id long, at long", "Append", "EventTime")


def newest(stream: DataFrame, key: str, ts: str, number: str, most: int = NEWEST) -> DataFrame:
    """(key, place, id, at): the newest ``most`` events of each key that got some, newest first, ties by number."""
    use_keyed_state(stream.sparkSession)
    slim = _slim(stream, key, ts, number)
    kind = dict(slim.dtypes)["key"]
    return slim.drop("time").groupBy("key").transformWithStateInPandas(_Newest(most), f"key {kind}, place int, id long, at long", "Update", "None")


def freshness(rows: DataFrame, now_micros: int, seconds: int = STALE_SECONDS) -> DataFrame:
    """(key, fresh): whether the newest event of a key is less than ``seconds`` old."""
    return rows.groupBy("key").agg((F.lit(now_micros) - F.max("at") < seconds * 1_000_000).alias("fresh"))
