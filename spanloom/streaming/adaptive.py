"""The adaptive sampling rate as a stream: counts by tick, and one small controller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.operators.sampling import CRITICAL, every_kth


class _Controller(StatefulProcessor):
    """The smoothed traffic and the rate, moved on by the counts of closed ticks, one row each."""

    def __init__(self, target_tps: float, least: float, most: float, alpha: float, tick_ms: int):
        self.target, self.least, self.most, self.alpha, self.tick_ms = target_tps, least, most, alpha, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "tick long, n long, ewma double, rate double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before, n, ewma, rate = self.state.get() if self.state.exists() else (None, 0, -1.0, self.least)
        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values("tick").itertuples():
            if before is not None:
                seen = n / ((r.tick - before) * self.tick_ms / 1000)
                ewma = seen if ewma < 0 else self.alpha * seen + (1 - self.alpha) * ewma
                rate = min(max(rate * self.target / ewma, self.least), self.most)
            out.append((int(r.tick), int(r.n), float(rate)))
            before, n = int(r.tick), int(r.n)
        self.state.update((before, n, float(ewma), float(rate)))
        yield pd.DataFrame(out, columns=["tick", "n", "rate"])

    def close(self) -> None:
        pass


def rates_stream(traces: DataFrame, target_tps: float, least: float = 0.01, most: float = 1.0, alpha: float = 0.3, tick_ms: int = 1000, late: str = "10 seconds") -> DataFrame:
    """``tick, n, rate`` for each closed tick of a stream of traces (first_ms, reason), as adaptive_rates() has them; critical traces
    aren't counted, and none that comes more than ``late`` after its tick.

    Counts are partial before the exchange, so the controller, which is one state for all, is sent one row for each tick.
    """
    offered = traces.filter(~F.col("reason").isin(*CRITICAL)).withColumn("at", F.timestamp_millis("first_ms")).withWatermark("at", late)
    counts = offered.groupBy(F.window("at", f"{tick_ms} milliseconds")).agg(F.count("*").alias("n"))
    ticks = counts.select(F.lit(0).alias("one"), F.floor(F.unix_millis("window.start") / tick_ms).alias("tick"), "n")
    controller = _Controller(target_tps, least if least > 0 else 0.01, most, alpha, tick_ms)
    return ticks.groupBy("one").transformWithStateInPandas(controller, outputStructType="tick long, n long, rate double", outputMode="Append", timeMode="None")


def gate_sink(traces: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], tick_ms: int = 1000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for rates_stream(): of the traces that aren't critical, those of the closed ticks that pass.

    traces: the landed traces of some ticks, from their (tick, rate) rows; a table partitioned by time reads just these.  A
    batch that runs again writes the same rows.
    """

    def run(rates: DataFrame, batch: int) -> None:
        rates = rates.select("tick", "rate").persist()
        try:
            landed = traces(rates).filter(~F.col("reason").isin(*CRITICAL))
            write(every_kth(landed, rates, tick_ms), batch)
        finally:
            rates.unpersist()

    return run
