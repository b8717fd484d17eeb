"""Logs: lists, search, context, volume, patterns, fields, error documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.core import NANO, TIERS, bucket, buckets_between, choose_error_tier, equals, nanos_between, page, received_between
from spanloom.functions.ranking import first_within

ERROR = 17


def logs(df: DataFrame, limit: int | None = 100, offset: int = 0, from_ms: int | None = None, to_ms: int | None = None, service: str = "", severity: str = "", trace_id: str = "") -> DataFrame:
    """Logs received in a range, the last received first."""
    df = equals(received_between(df, from_ms, to_ms), service_name=service, severity_text=severity, trace_id=trace_id)
    return page(df, [F.col("received_at_ms").desc(), F.col("event_id")], limit, offset)


def log_search(df: DataFrame, service: str = "", severity: str = "", keyword: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Logs whose body holds a keyword in either case, newest first."""
    df = equals(df.filter(nanos_between("timestamp_nano", from_ms, to_ms)), service_name=service, severity_text=severity.upper())
    if keyword:
        df = df.filter(F.contains(F.lower("body"), F.lit(keyword.lower())))
    return page(df, [F.col("timestamp_nano").desc(), F.col("event_id")], limit, offset)


def log_context(df: DataFrame, service: str, at_nano: int, window_sec: int = 30, limit: int | None = 50) -> DataFrame:
    """Logs of a service around a time, oldest first."""
    df = df.filter((F.col("service_name") == service) & F.col("timestamp_nano").between(at_nano - window_sec * NANO, at_nano + window_sec * NANO))
    return page(df, [F.col("timestamp_nano"), F.col("event_id")], limit)


def log_context_join(points: DataFrame, df: DataFrame, window_sec: int = 30, limit: int = 50) -> DataFrame:
    """The same for many points (point_id, service_name, at_nano), with ``position``; see first_within()."""
    w = window_sec * NANO
    ranges = points.withColumns({"range_from": F.col("at_nano") - w, "range_to": F.col("at_nano") + w})
    return first_within(ranges, df, "service_name", "timestamp_nano", ["event_id"], limit)


def error_log_rollup(df: DataFrame, tier: str) -> DataFrame:
    df = df.filter(F.col("severity_number") >= ERROR)
    return df.groupBy("service_name", "exception_type", bucket("timestamp_nano", TIERS[tier]).alias("minute")).agg(F.count("*").alias("n"))


def error_logs(rollup: DataFrame, service: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 500) -> DataFrame:
    df = equals(rollup.filter(buckets_between("minute", from_ms, to_ms)), service_name=service)
    df = df.groupBy("service_name", "exception_type", "minute").agg(F.sum("n").alias("n"))
    return page(df, [F.col("minute").desc(), F.col("n").desc(), F.col("service_name"), F.col("exception_type")], limit)


def error_logs_tiered(rollups: dict[str, DataFrame], service: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 500) -> DataFrame:
    """error_logs() of the rollup (1m, 1h) that the range asks for."""
    return error_logs(rollups[choose_error_tier(from_ms, to_ms)], service, from_ms, to_ms, limit)


def log_volume_rollup(df: DataFrame) -> DataFrame:
    return df.groupBy("service_name", bucket("timestamp_nano", 60).alias("minute"), "severity_text").agg(F.count("*").alias("n"))


def log_volume(df: DataFrame, rollup: DataFrame | None = None, service: str = "", from_ms: int | None = None, to_ms: int | None = None, interval: int = 60, limit: int | None = 2000) -> DataFrame:
    """Logs by severity and interval, oldest first; the interval of a minute reads the rollup if there is one."""
    if interval == 60 and rollup is not None:
        g = equals(rollup.filter(buckets_between("minute", from_ms, to_ms)), service_name=service).select("severity_text", F.col("minute").alias("b"), "n")
    else:
        g = equals(df.filter(nanos_between("timestamp_nano", from_ms, to_ms)), service_name=service).select("severity_text", bucket("timestamp_nano", interval).alias("b"), F.lit(1).alias("n"))
    g = g.groupBy((F.col("b") / 1_000_000).cast("long").alias("bucket_ms"), "severity_text").agg(F.sum("n").alias("n"))
    return page(g, [F.col("bucket_ms"), F.col("severity_text")], limit)


def log_patterns(df: DataFrame, service: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 20) -> DataFrame:
    """Beginnings of bodies with long numbers blanked, by severity and service, most frequent first."""
    df = equals(df.filter(nanos_between("timestamp_nano", from_ms, to_ms)), service_name=service)
    g = df.groupBy(F.regexp_replace(F.left("body", F.lit(120)), "[0-9]{4,}", "N").alias("pattern"), "severity_text", "service_name").agg(F.count("*").alias("n"), F.min("timestamp_nano").alias("first_seen"), F.max("timestamp_nano").alias("last_seen"))
    return page(g, [F.col("n").desc(), F.col("pattern"), F.col("severity_text"), F.col("service_name")], limit)


def log_fields(df: DataFrame, service: str = "", from_ms: int | None = None, to_ms: int | None = None, top: int = 10) -> DataFrame:
    """Severities, the top loggers and exceptions, and the total, in one pass over grouping sets."""
    df = equals(df.filter(nanos_between("timestamp_nano", from_ms, to_ms)), service_name=service)
    field = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in (("severity", F.col("severity_text")), ("logger", F.col("logger_name")), ("exception", F.col("exception_type")), ("total", F.lit("all")))]))
    g = df.select(field.alias("f")).select("f.*").filter("field in ('severity', 'total') or value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "value"))
    return g.withColumn("rank", rank).filter((F.col("rank") <= top) | (F.col("field") == "severity"))


def error_documents_from_logs(df: DataFrame) -> DataFrame:
    """A text for each error log: service, exception where there is one, body."""
    df = df.filter(F.col("severity_number") >= ERROR)
    exception = F.when(F.col("exception_type") != "", F.concat(F.lit("["), F.col("exception_type"), F.lit("] "))).otherwise("")
    at = F.col("timestamp_nano").cast("string")
    return df.select(
        F.sha2(F.concat_ws("|", F.lit("log_error"), "service_name", at, "span_id", "body"), 256).alias("id"),
        F.lit("log_error").alias("source_type"),
        at.alias("source_id"),
        "service_name",
        "trace_id",
        "span_id",
        F.floor(F.col("timestamp_nano") / 1_000_000).alias("occurred_ms"),
        F.concat(F.lit("["), F.col("service_name"), F.lit("] "), exception, F.col("body")).alias("document"),
    )
