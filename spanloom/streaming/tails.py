"""Tails: what is newest since the last poll, for every subscription."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROW = "subscription_id string, at_ms long, id string, row string"


def _newest(most: int):
    """Of a task's part of a trigger no more than ``most`` rows of a subscription can be among its newest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values(["at_ms", "id"], ascending=[False, True], kind="stable").groupby("subscription_id", sort=False).head(most)

    return run


class _Tail(StatefulProcessor):
    """A subscription's newest rows since its last poll, and its cursor: when that was, and how many polls there were."""

    def __init__(self, every_ms: int, most: int):
        self.every_ms, self.most = every_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "polls long, due long, rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        polls, due, kept = self.cursor.get() if self.cursor.exists() else (0, 0, None)
        held = pickle.loads(kept) if kept else []
        for b in rows:
            held += zip(b["at_ms"].tolist(), b["id"].tolist(), b["row"].tolist())
            held = sorted(held, key=lambda r: (-r[0], r[1]))[: self.most]
        if not due:
            # polls are at whole multiples, so a subscription without rows needs no timer
            due = (timerValues.getCurrentProcessingTimeInMs() // self.every_ms + 1) * self.every_ms
            self.handle.registerTimer(due)
        self.cursor.update((polls, due, pickle.dumps(held)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        polls, due, kept = self.cursor.get()
        held = pickle.loads(kept)
        self.cursor.update((polls + 1, 0, pickle.dumps([])))
        yield pd.DataFrame({"subscription_id": key[0], "poll": polls + 1, "polled_at_ms": due, "position": range(1, len(held) + 1), "at_ms": [r[0] for r in held], "row": [r[2] for r in held]})

    def close(self) -> None:
        pass


def tails(stream: DataFrame, subscriptions: DataFrame, time: str = "received_at_ms", id: str = "event_id", every_ms: int = 3000, most: int = 50, service: str = "service_name", severity: str = "severity_text") -> DataFrame:
    """For each subscription (subscription_id, service, severity; blank takes any) the ``most`` newest rows of the stream since its last
    poll, at each poll that has any: ``subscription_id, poll, polled_at_ms, position, at_ms, row`` (as JSON), newest first.

    A row is told once: what comes while a poll is due belongs to the next one, whatever its time, so rows of one
    time on both sides of a poll are neither lost nor doubled.  The subscriptions are joined by equality with the row's service and
    severity, or blank.  Needs the RocksDB state store.
    """
    either = lambda c: F.explode(F.array_distinct(F.array(F.coalesce(F.col(c), F.lit("")), F.lit(""))))
    rows = stream.select(F.col(time).cast("long").alias("at_ms"), F.col(id).cast("string").alias("id"), F.to_json(F.struct(*stream.columns)).alias("row"), either(service).alias("service"), F.col(severity).alias("_severity"))
    rows = rows.withColumn("severity", either("_severity"))
    wanted = subscriptions.select(F.col("subscription_id").cast("string"), F.coalesce("service", F.lit("")).alias("service"), F.coalesce("severity", F.lit("")).alias("severity"))
    matched = rows.join(wanted, ["service", "severity"]).select("subscription_id", "at_ms", "id", "row")
    few = matched.mapInPandas(_newest(most), _ROW)
    return few.groupBy("subscription_id").transformWithStateInPandas(_Tail(every_ms, most), outputStructType="subscription_id string, poll long, polled_at_ms long, position int, at_ms long, row string", outputMode="Append", timeMode="ProcessingTime")
