"""Observation of changing tables on Structured Streaming: a query runs again when rows arrive, and event-time windows."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


@dataclass(frozen=True)
class Region:
    """Tables, and of each the columns and the keys (None: all) that a query reads or a change touches."""

    columns: dict[str, frozenset[str] | None] = field(default_factory=dict)
    keys: dict[str, frozenset | None] = field(default_factory=dict)

    def union(self, other: Region) -> Region:
        tables = {*self.columns, *other.columns}
        both = lambda a, b, t: b.get(t) if t not in mine else a.get(t) if t not in theirs else (None if a.get(t) is None or b.get(t) is None else a[t] | b[t])
        mine, theirs = self.columns, other.columns
        return Region({t: both(self.columns, other.columns, t) for t in tables}, {t: both(self.keys, other.keys, t) for t in tables})

    def intersection(self, other: Region) -> Region:
        """What both hold; tables of which nothing is left go."""
        both = lambda a, b: b if a is None else a if b is None else a & b
        out = {t: (both(self.columns[t], other.columns[t]), both(self.keys.get(t), other.keys.get(t))) for t in self.columns if t in other.columns}
        out = {t: (c, k) for t, (c, k) in out.items() if (c is None or c) and (k is None or k)}
        return Region({t: c for t, (c, _) in out.items()}, {t: k for t, (_, k) in out.items()})

    def meets(self, other: Region) -> bool:
        return bool(self.intersection(other).columns)


def region_of(table: str, key: str | None = None, most: int = 1000) -> Callable[[DataFrame], Region]:
    """What a batch of arriving rows of a table touches: all its columns, and its keys if they are at most `most`."""

    def touched(batch: DataFrame) -> Region:
        rows = batch.select(key).distinct().limit(most + 1).collect() if key else batch.limit(1).collect()
        if not rows:
            return Region()
        return Region({table: frozenset(batch.columns)}, {table: frozenset(r[0] for r in rows) if key and len(rows) <= most else None})

    return touched


def observe(arrivals: DataFrame, fetch: Callable[[], Any], on_change: Callable[[Any], None], checkpoint: str, remove_duplicates: bool = True, region: Region | None = None, touched: Callable[[DataFrame], Region] | None = None, **trigger) -> StreamingQuery:
    """Calls on_change with the first value, then with each new value after a micro-batch of arrivals.

    With the region that fetch reads, and what a batch touches, only batches that meet the region are fetched for.
    """
    last: list[Any] = []

    def again(batch: DataFrame, _number: int) -> None:
        if region is not None and touched is not None and not region.meets(touched(batch)):
            return
        value = fetch()
        if not last or not remove_duplicates or value != last[0]:
            last[:] = [value]
            on_change(value)

    value = fetch()
    last[:] = [value]
    on_change(value)
    writer = arrivals.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


class Shared:
    """One observation for many subscribers: the query runs once per change whoever listens. Newcomers first get the last value."""

    def __init__(self, arrivals: DataFrame, fetch: Callable[[], Any], checkpoint: str, **trigger) -> None:
        self._listeners: list[Callable[[Any], None]] = []
        self._last: Any = None
        self._lock = threading.RLock()
        self.query = observe(arrivals, fetch, self._tell, checkpoint, **trigger)

    def _tell(self, value: Any) -> None:
        with self._lock:
            self._last = value
            for listener in list(self._listeners):
                listener(value)

    def subscribe(self, listener: Callable[[Any], None]) -> Callable[[], None]:
        """Returns a function that ends the subscription."""
        with self._lock:
            self._listeners.append(listener)
            listener(self._last)
        return lambda: self._listeners.remove(listener)

    def announce(self, value: Any) -> None:
        """Tells the listeners of a value that came about by a change the stream does not see."""
        self._tell(value)

    def values(self, limit: int) -> Iterator[Any]:
        """The last value and those that follow, so many in all."""
        arrived: queue.Queue = queue.Queue()
        end = self.subscribe(arrived.put)
        try:
            for _ in range(limit):
                yield arrived.get()
        finally:
            end()

    def stop(self) -> None:
        self.query.stop()


def on_arrival(arrivals: DataFrame, notify: Callable[[int], None], checkpoint: str, region: Region | None = None, touched: Callable[[DataFrame], Region] | None = None, **trigger) -> StreamingQuery:
    """Calls notify with the batch's number for each micro-batch that brings rows (of the region, if there is one); nothing is fetched."""

    def tell(batch: DataFrame, number: int) -> None:
        if region is not None and touched is not None:
            if region.meets(touched(batch)):
                notify(number)
        elif not batch.isEmpty():
            notify(number)

    writer = arrivals.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _marked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """late: how long after the latest time seen a row may come. A stream then forgets closed windows, and can append them to a sink."""
    if late is None:
        return events
    kind = events.schema[time].dataType.simpleString()
    rows = events.withColumn(time, F.col(time).cast("timestamp")) if kind == "timestamp_ntz" else events  # watermarks are of instants
    return rows.withWatermark(time, late)


def tumbling(events: DataFrame, time: str, length: str, *keys: str, late: str | None = None) -> DataFrame:
    events = _marked(events, time, late)
    w = F.window(F.col(time), length)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, time: str, length: str, step: str, *keys: str, late: str | None = None) -> DataFrame:
    events = _marked(events, time, late)
    w = F.window(F.col(time), length, step)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    events = _marked(events, time, late)
    w = F.session_window(F.col(time), gap)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
