"""Streaming twins of the session operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def sessions(events: DataFrame, user: str, time: str, gap: str, late: str) -> DataFrame:
    """user, started_at, last_seen, n per session; rows later than ``late`` behind the newest are dropped."""
    found = events.withWatermark(time, late).groupBy(user, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("last_seen"))
    return found.select(user, F.col("w.start").alias("started_at"), "last_seen", "n")


def usage(events: DataFrame) -> DataFrame:
    """Running calls and value per user and event type."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("total"))


def windows(events: DataFrame, time: str, size: str, slide: str, late: str) -> DataFrame:
    """event_type, from, n per sliding window."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("from"), "event_type", "n")


class _Feedback(StatefulProcessor):
    """An element's weight and count, and one state row for each turn it has counted."""

    def __init__(self, rate: float, start: float, remember: int | None) -> None:
        self.rate, self.start, self.remember = rate, start, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weight = handle.getValueState("weight", "weight double, n long")
        self.seen = handle.getMapState("seen", "qa_id string", "counted boolean", self.remember)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        weight, n = self.weight.get() if self.weight.exists() else (self.start, 0)
        for row in pd.concat(list(rows)).sort_values(["position", "qa_id"]).itertuples():
            turn = (str(row.qa_id),)
            if 1 <= row.score <= 5 and not self.seen.containsKey(turn):
                self.seen.updateValue(turn, (True,))
                weight, n = round(min(1.0, max(0.0, weight + self.rate * ((row.score - 1) / 4 - weight))), 4), n + 1
        self.weight.update((weight, n))
        yield pd.DataFrame({"element_id": [key[0]], "weight": [weight], "n": [n]})

    def close(self) -> None:
        pass


def feedback(rated: DataFrame, rate: float = 0.1, start: float = 0.5, remember: int | None = None) -> DataFrame:
    """element_id, weight, n after each batch, from rated uses (element_id, qa_id, score, position).

    The state of an element is its weight, and a row of its own for each turn that it has
    counted, so a batch reads and writes the rows of its own turns only. Within a batch uses
    apply in order of position, and a turn counts once. ``remember``: milliseconds after which a turn's row goes;
    a turn that is rated again later than that counts again. Without it rows stay. Needs the RocksDB state store.
    """
    kind = rated.schema["element_id"].dataType.simpleString()
    return rated.groupBy("element_id").transformWithStateInPandas(_Feedback(rate, start, remember), f"element_id {kind}, weight double, n long", "Update", "None" if remember is None else "ProcessingTime")


class _Value(StatefulProcessor):
    """A key's last value and when it ends, with a timer for that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "value string, at long, ends long")

    def _told(self, key: tuple, value: str | None, at: int, ends: int | None, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "value": [value], "set_at": [at], "ends_at": pd.array([ends], dtype="Int64"), "expired": [expired]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "value"], na_position="first")
        last = frame.iloc[-1]
        if self.value.exists() and self.value.get()[1] > int(last["at"]):
            return
        at, ends = int(last["at"]), None if pd.isna(last["ttl"]) else int(last["at"]) + int(last["ttl"])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        value = None if pd.isna(last["value"]) else str(last["value"])
        self.value.update((value, at, -1 if ends is None else ends))
        if ends is not None:
            self.handle.registerTimer(max(ends, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._told(key, value, at, ends, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            value, at, ends = self.value.get()
            self.value.clear()
            yield self._told(key, value, at, ends, True)

    def close(self) -> None:
        pass


def values(sets: DataFrame, time: str, late: str) -> DataFrame:
    """key, value, set_at, ends_at (milliseconds), expired: values as they are set (key, value, ttl, time) and as they end.

    A later set replaces an earlier one and its end; ``ttl`` is in milliseconds, and without it a value stays.
    An ended value's state is gone, so the state is that of the keys that live. Time is that of the
    events: ends come with the watermark, ``late`` behind the newest. Rows without a key or time are left out.
    """
    rows = sets.where(F.col("key").isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    keyed = rows.select("key", F.col("value").cast("string").alias("value"), F.col("ttl").cast("long").alias("ttl"), F.unix_millis(time).alias("at"), F.col(time).alias("time"))
    return keyed.groupBy("key").transformWithStateInPandas(_Value(), f"key {keyed.schema['key'].dataType.simpleString()}, value string, set_at long, ends_at long, expired boolean", "Update", "EventTime")


def once_each(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows with their first occurrence of a key inside the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def persisted(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Writes each batch under its number: ``write`` has to be idempotent in that; the checkpoint is the watermark of what is done."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
