"""Streams: rollups by micro-batch, windows, sampled batches, tails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from spanloom.operators.sampling import Sampling, decision

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rollup_sink(path: str, rollups: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each rollup's partial aggregates of the batch under path/name/batch=N.

    Nothing is ever too late: a late row adds a partial row to its old bucket, and readers merge.  A
    batch that is run again replaces its own folder, so it counts once.
    """

    def run(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            for name, f in rollups.items():
                f(df).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        finally:
            df.unpersist()

    return run


def start_rollups(stream: DataFrame, path: str, rollups: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str, every: str = "2 seconds") -> DataStreamWriter:
    return stream.writeStream.foreachBatch(rollup_sink(path, rollups)).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], length: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window with bounded state; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide), *keys).agg(F.count("*").alias("n"))


def sample_batch(config: Sampling, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the spans of whole traces by the sampling policy."""
    from spanloom.operators.sampling import trace_facts

    def run(df: DataFrame, batch: int) -> None:
        kept = trace_facts(df).withColumn("reason", decision(config)).filter("reason is not null").select("trace_id")
        write(df.join(kept, "trace_id", "left_semi"), batch)

    return run
