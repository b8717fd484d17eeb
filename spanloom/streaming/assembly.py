"""Traces put together from a stream of spans, within a bound on all open traces."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


class _Lists:
    """Lists of trace ids by time, of which the state has one row each; those touched are held until save()."""

    def __init__(self, state: Any, times: list[int]):
        self.state, self.times, self.held = state, times, {}

    def at(self, time: int) -> deque:
        if time not in self.held:
            found = self.state.getValue((time,)) if time in self.times else None
            self.held[time] = deque(found[0] if found else ())
            if time not in self.times:
                self.times.append(time)
                self.times.sort()
        return self.held[time]

    def drop(self, time: int) -> None:
        self.held[time] = deque()

    def save(self) -> list[int]:
        """Writes what was touched; the times that still have ids, in order."""
        for time, ids in self.held.items():
            if ids:
                self.state.updateValue((time,), (list(ids),))
            else:
                if self.state.containsKey((time,)):
                    self.state.removeKey((time,))
                self.times.remove(time)
        return self.times


class _Assemble(StatefulProcessor):
    """All open traces of a shard: their spans, and two indexes ordered by time, of first arrivals and of when a trace with a root may close."""

    def __init__(self, schema: StructType, wait_ms: int, most_ms: int, most_spans: int, most_open: int):
        self.names = [f.name for f in schema.fields]
        self.wait_ms, self.most_ms, self.most_spans, self.most_open = wait_ms, most_ms, most_spans, most_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "trace_id string", "born long, n int, rooted boolean, parts int")
        self.spans = handle.getMapState("spans", "trace_id string, part int", "rows binary")
        self.born = handle.getMapState("born", "at long", "ids array<string>")
        self.ready = handle.getMapState("ready", "at long", "ids array<string>")
        self.index = handle.getValueState("index", "born array<long>, ready array<long>, n int")

    def _load(self) -> None:
        born, ready, self.n = self.index.get() if self.index.exists() else ([], [], 0)
        self.by_birth, self.by_ready = _Lists(self.born, list(born)), _Lists(self.ready, list(ready))
        self.out: list[tuple] = []

    def _save(self) -> pd.DataFrame:
        self.index.update((self.by_birth.save(), self.by_ready.save(), self.n))
        columns = zip(*self.out) if self.out else [[] for _ in self.names]
        return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(self.names, columns)})

    def _release(self, trace: str, parts: int) -> None:
        for part in range(parts):
            self.out += pickle.loads(self.spans.getValue((trace, part))[0])
            self.spans.removeKey((trace, part))
        self.open.removeKey((trace,))
        self.n -= 1

    def _release_oldest(self) -> None:
        for time in list(self.by_birth.times):
            ids = self.by_birth.at(time)
            while ids:
                trace = ids.popleft()
                found = self.open.getValue((trace,))
                if found and found[0] == time:  # else it was closed before
                    return self._release(trace, found[3])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self._load()
        for batch in rows:
            # by place: names that Python couldn't have come under others
            batch = batch.iloc[:, : len(self.names)].set_axis(self.names, axis=1).astype(object)
            batch = batch.where(batch.notna(), None)
            for trace, part in batch.groupby("trace_id", sort=False, dropna=False):
                found = self.open.getValue((trace,))
                if found is None:
                    found = (now, 0, False, 0)
                    self.open.updateValue((trace,), found)
                    self.by_birth.at(now).append(trace)
                    self.handle.registerTimer(now + self.most_ms)
                    self.n += 1
                    if self.n > self.most_open:
                        self._release_oldest()
                born, n, rooted, parts = found
                self.spans.updateValue((trace, parts), (pickle.dumps(list(part.itertuples(index=False, name=None))),))
                n, parts = n + len(part), parts + 1
                if not rooted and (part["parent_span_id"] == "").any():
                    rooted, due = True, max(born + self.wait_ms, now + 1)
                    self.by_ready.at(due).append(trace)
                    self.handle.registerTimer(due)
                self.open.updateValue((trace,), (born, n, rooted, parts))
                if n >= self.most_spans:
                    self._release(trace, parts)
        yield self._save()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self._load()
        for time in [t for t in self.by_ready.times if t <= now]:
            for trace in self.by_ready.at(time):
                found = self.open.getValue((trace,))
                if found and found[2] and found[0] + self.wait_ms <= now:
                    self._release(trace, found[3])
            self.by_ready.drop(time)
        for time in [t for t in self.by_birth.times if t + self.most_ms <= now]:
            for trace in self.by_birth.at(time):
                found = self.open.getValue((trace,))
                if found and found[0] == time:
                    self._release(trace, found[3])
            self.by_birth.drop(time)
        yield self._save()

    def close(self) -> None:
        pass


def assemble_traces(stream: DataFrame, wait_ms: int = 100, most_ms: int = 30_000, most_spans: int = 50_000, most_open: int = 50_000, shards: int = 64) -> DataFrame:
    """The stream's spans, released trace by trace: at least ``wait_ms`` after a trace's first span once its root
    is there, or after ``most_ms``, or when it has very many spans, or, when more than ``most_open`` traces are open, the oldest.
    A late span begins its trace anew, so a sampler decides on it a second time.

    Traces are dealt over ``shards`` by their ids, each with its part of the bound (at least one): the oldest is that of its
    shard.  Needs the RocksDB state store.
    """
    schema = stream.schema
    keyed = stream.withColumn("_shard", F.pmod(F.xxhash64("trace_id"), F.lit(shards)).cast("int"))
    processor = _Assemble(schema, wait_ms, most_ms, most_spans, max(1, most_open // shards))
    return keyed.groupBy("_shard").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
