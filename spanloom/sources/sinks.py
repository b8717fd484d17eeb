"""Rows as they are stored and as they are published."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.traces import promote_attributes


def span_rows(spans: DataFrame) -> DataFrame:
    """Spans as stored: promoted attributes, duration, receive date."""
    return promote_attributes(spans).withColumn("duration_nano", F.col("end_time_nano") - F.col("start_time_nano")).withColumn("dt", F.to_date(F.timestamp_millis("received_at_ms")))


def write_table(df: DataFrame, path: str, *order: str) -> None:
    """Rows appended by receive date, sorted inside files so that row groups can be skipped."""
    if "dt" not in df.columns:
        df = df.withColumn("dt", F.to_date(F.timestamp_millis("received_at_ms")))
    df.sortWithinPartitions("dt", *order).write.partitionBy("dt").mode("append").parquet(path)


def metric_rows(metrics: DataFrame) -> DataFrame:
    """A scalar row for each point of any type; a histogram's value is its sum."""
    p = metrics.select("name", "type", "service_name", "received_at_ms", F.explode("data_points").alias("p"))
    return p.select("name", "type", F.when(F.col("type") == "HISTOGRAM", F.col("p.sum")).otherwise(F.col("p.value")).alias("value"), "service_name", F.col("p.attributes").alias("attributes"), F.col("p.timestamp_nano").alias("timestamp_nano"), "received_at_ms")


def histogram_rows(metrics: DataFrame) -> DataFrame:
    """A row for each histogram point, exemplars as parallel arrays and their attributes as JSON."""
    p = metrics.filter("type = 'HISTOGRAM'").select(F.col("name").alias("metric_name"), "service_name", "received_at_ms", F.explode("data_points").alias("p"))
    of = lambda f: F.transform("p.exemplars", f)
    return p.select(
        "service_name", "metric_name", F.col("p.timestamp_nano").alias("timestamp_nano"), F.col("p.bounds").alias("bounds"), F.col("p.bucket_counts").alias("bucket_counts"), F.col("p.count").alias("total_count"), F.col("p.sum").alias("total_sum"), F.col("p.attributes").alias("attributes"),
        of(lambda e: e.timestamp_nano).alias("exemplar_times"), of(lambda e: e.value).alias("exemplar_values"), of(lambda e: e.trace_id).alias("exemplar_trace_ids"), of(lambda e: e.span_id).alias("exemplar_span_ids"), of(lambda e: F.to_json(e.attributes)).alias("exemplar_attributes"), "received_at_ms",
    )


def log_rows(logs: DataFrame) -> DataFrame:
    """Logs as stored: exception and logger promoted."""
    get = lambda k: F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit(""))
    return logs.withColumn("exception_type", get("exception.type")).withColumn("logger_name", get("logger.name"))


def _event(key: Column, **fields: Column | str) -> list[Column]:
    """A message's key and its value as JSON: the fields in this order, blank optional ones (a name that ends in _) left out."""
    each = []
    for name, c in fields.items():
        c = F.col(c) if isinstance(c, str) else c
        if name == "attributes_":
            c = F.when(F.size(c) > 0, c)
        elif name.endswith("_"):
            c = F.nullif(c, F.lit(""))
        each.append(c.alias(name.rstrip("_")))
    return [key.alias("key"), F.to_json(F.struct(*each)).alias("value")]


def span_events(spans: DataFrame) -> DataFrame:
    """Key and JSON value of each span as published, by service; what only the store needs (receive time) stays out."""
    return spans.select(
        *_event(
            F.col("service_name"), trace_id="trace_id", span_id="span_id", parent_span_id_="parent_span_id", name="name", kind="kind", start_time_nano="start_time_nano", end_time_nano="end_time_nano",
            attributes_="attributes", status_code="status_code", status_message_="status_message", service_name="service_name", scope_name_="scope_name",
        )
    )


def metric_events(points: DataFrame) -> DataFrame:
    """Key and JSON value of each point (service_name, name, type, unit, value, count, sum, timestamp_nano, attributes); a
    histogram's value is its mean, or its sum where it has no count."""
    value = F.when(F.col("type") == "HISTOGRAM", F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(F.col("sum"))).otherwise(F.col("value"))
    at = F.floor(F.col("timestamp_nano") / 1_000_000)
    return points.select(*_event(F.concat_ws(".", "service_name", "name"), service_name="service_name", metric_name="name", metric_type="type", unit_="unit", value=value, timestamp_ms=at, attributes_="attributes"))


def log_events(logs: DataFrame) -> DataFrame:
    """Key and JSON value of each log as published, by service; its severity is the text."""
    at = F.floor(F.col("timestamp_nano") / 1_000_000)
    return logs.select(*_event(F.col("service_name"), service_name="service_name", severity="severity_text", body="body", timestamp_ms=at, trace_id_="trace_id", span_id_="span_id", attributes_="attributes"))


def received_deployments(df: DataFrame, now_ms: int) -> DataFrame:
    """Deployments with a service and a version; the time of receipt where none is given, production where no environment is."""
    df = df.filter("coalesce(service_name, '') <> '' and coalesce(version, '') <> ''")
    return df.withColumn("deployed_at_ms", F.coalesce(F.nullif("deployed_at_ms", F.lit(0)), F.lit(now_ms))).withColumn("environment", F.coalesce(F.nullif("environment", F.lit("")), F.lit("production")))


def deploy_rows(df: DataFrame, now_ms: int) -> DataFrame:
    """Deployments as stored, without metadata and description."""
    return received_deployments(df, now_ms).drop("metadata", "description")


def deploy_events(df: DataFrame, now_ms: int) -> DataFrame:
    """Key and JSON value of each deployment as published, by service."""
    df = received_deployments(df, now_ms)
    more = {"metadata": "metadata"} if "metadata" in df.columns else {}
    return df.select(*_event(F.col("service_name"), service_name="service_name", version="version", environment="environment", deployed_by_="deployed_by", timestamp_ms="deployed_at_ms", **more))


def guarded(write: Callable[[DataFrame, int], None], failed: Callable[[DataFrame, int, str], None], waits: tuple[float, ...] = (1, 2, 4)) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that tries a write, again after each of ``waits`` seconds, and hands the batch and the
    reason on when it keeps failing."""

    def run(df: DataFrame, batch: int) -> None:
        for wait in (*waits, None):
            try:
                return write(df, batch)
            except Exception as e:  # the sink may be down; the rows must not be lost
                if wait is None:
                    failed(df, batch, f"{type(e).__name__}: {e}"[:500])
                else:
                    time.sleep(wait)

    return run


def both_ways(write: Callable[[DataFrame, int], None], backup: Callable[[DataFrame, int], None], failed: Callable[[int, str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes, and backs up beside it: a failing backup is told, and stops nothing."""

    def run(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            try:
                backup(df, batch)
            except Exception as e:  # the main write must go on
                failed(batch, f"{type(e).__name__}: {e}"[:500])
            write(df, batch)
        finally:
            df.unpersist()

    return run
