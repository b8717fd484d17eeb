"""The latest runtime values of each service, told again at every flush whether there is news or not."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.functions.core import attribute
from spanloom.operators.metrics import GC, GC_NAME, JVM_FIELDS

#: The eleven fields: those of scalars, then count, time in ms and name of collections.
FIELDS = (*JVM_FIELDS, "gc_count_delta", "gc_pause_ms_total_delta", "gc_collection_name")


class _Snapshot(StatefulProcessor):
    """A service's fields with the time of each, and a timer that registers itself again."""

    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "field string", "timestamp_nano long, event_id long, value double, name string")
        self.newest = handle.getValueState("newest", "timestamp_nano long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if not self.newest.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)
        newest = self.newest.get()[0] if self.newest.exists() else None
        for batch in rows:
            batch = batch.sort_values(["timestamp_nano", "event_id"])
            newest = max(int(batch["timestamp_nano"].iloc[-1]), newest if newest is not None else -(2**63))
            for field, r in batch.groupby("field", sort=False).tail(1).set_index("field").iterrows():
                at = (int(r["timestamp_nano"]), int(r["event_id"]))
                known = self.fields.getValue((field,))
                if known is None or at > (known[0], known[1]):
                    value = None if r["value"] is None or r["value"] != r["value"] else float(r["value"])
                    self.fields.updateValue((field,), (*at, value, r["name"]))
        if newest is not None:
            self.newest.update((newest,))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.handle.registerTimer(max(expiredTimerInfo.getExpiryTimeInMs() + self.every_ms, timerValues.getCurrentProcessingTimeInMs()))
        known = {k[0]: v for k, v in self.fields.iterator()}
        value = lambda f: known[f][2] if f in known else None
        row = {"service_name": key[0], "timestamp_nano": self.newest.get()[0], "flushed_at_ms": expiredTimerInfo.getExpiryTimeInMs()}
        row |= {f: value(f) for f in FIELDS[:-1]} | {FIELDS[-1]: known[FIELDS[-1]][3] if FIELDS[-1] in known else None}
        yield pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in row.items()})

    def close(self) -> None:
        pass


def runtime_points(scalars: DataFrame, histograms: DataFrame) -> DataFrame:
    """Points of runtime metrics as (service_name, field, timestamp_nano, event_id, value, name), for snapshots()."""
    names = {n: f for f, ns in JVM_FIELDS.items() for n in ns}
    field = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("name"))
    a = scalars.filter(F.col("name").isin(*names)).select("service_name", field.alias("field"), "timestamp_nano", "event_id", F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("name"))
    gc = attribute("attributes", GC_NAME)
    none = F.lit(None).cast("double")
    parts = [
        F.struct(F.lit(FIELDS[-3]).alias("field"), F.col("total_count").cast("double").alias("value"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit(FIELDS[-2]).alias("field"), (F.col("total_sum") * 1000).alias("value"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit(FIELDS[-1]).alias("field"), none.alias("value"), gc.alias("name")),
    ]
    b = histograms.filter(F.col("metric_name") == GC).select("service_name", "timestamp_nano", "event_id", F.explode(F.array(*parts)).alias("p"))
    b = b.select("service_name", "p.field", "timestamp_nano", "event_id", "p.value", "p.name").filter(f"field <> '{FIELDS[-1]}' or name <> ''")
    return a.unionByName(b)


def snapshots(points: DataFrame, every_ms: int = 5000) -> DataFrame:
    """From a stream of runtime_points() a row for each known service at each flush: the last value of every field, the time of the
    newest point, and ``flushed_at_ms``.  Needs the RocksDB state store."""
    kinds = ["service_name string", "timestamp_nano long", "flushed_at_ms long", *[f"{f} double" for f in FIELDS[:-1]], f"{FIELDS[-1]} string"]
    return points.groupBy("service_name").transformWithStateInPandas(_Snapshot(every_ms), outputStructType=", ".join(kinds), outputMode="Append", timeMode="ProcessingTime")
