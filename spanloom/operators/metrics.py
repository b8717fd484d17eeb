"""Metrics: lists, histogram rollups and percentiles, minutes, snapshots, overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.core import TIERS, at_between, attribute, bucket, buckets_between, choose_tier, equals, histogram_percentiles, nanos_between, page, received_between

#: Fields of the runtime snapshot and the metrics each reads, the last value of any of them (fixed names).
JVM_FIELDS = {
    "heap_used_bytes": ("jvm.memory.heap.used",),
    "heap_committed_bytes": ("jvm.memory.heap.committed",),
    "heap_max_bytes": ("jvm.memory.heap.max",),
    "thread_count": ("jvm.thread.count", "jvm.threads.count", "process.runtime.jvm.threads.count"),
    "thread_peak": ("jvm.thread.peak",),
    "thread_daemon": ("jvm.thread.daemon.count",),
    "process_cpu_utilization": ("jvm.process.cpu.utilization", "process.runtime.jvm.cpu.utilization", "jvm.cpu.utilization"),
    "system_cpu_utilization": ("system.cpu.utilization",),
}
#: The histogram of collections: seconds in its sum.
GC, GC_NAME = "jvm.gc.duration", "jvm.gc.name"
#: Runtime metrics beside those of the prefixes jvm., process. and system. (fixed names).
NAMED = ("runtime.jvm.gc.duration", "runtime.jvm.memory.used", "runtime.jvm.memory.limit", "runtime.jvm.thread.count")
HISTOGRAM_KEYS = ["service_name", "metric_name", "minute"]


def metrics(scalars: DataFrame, histograms: DataFrame, limit: int | None = 100, offset: int = 0, from_ms: int | None = None, to_ms: int | None = None, service: str = "", name: str = "") -> DataFrame:
    """Scalar rows and then histogram rows (value: their sum), the last received first, each limited; the offset is for scalars.
    Scalars have no count, bounds or bucket counts."""
    point = ["event_id", "name", "type", "value", "service_name", "timestamp_nano", "received_at_ms", "attributes"]
    a = equals(received_between(scalars, from_ms, to_ms), service_name=service, name=name).select(*point)
    h = histograms.select("event_id", F.col("metric_name").alias("name"), F.lit("HISTOGRAM").alias("type"), F.col("total_sum").alias("value"), "service_name", "timestamp_nano", "received_at_ms", "attributes", F.col("total_count").alias("count"), "bounds", "bucket_counts")
    h = equals(received_between(h, from_ms, to_ms), service_name=service, name=name)
    order = [F.col("received_at_ms").desc(), F.col("event_id")]
    return page(a, order, limit, offset).unionByName(page(h, order, limit), allowMissingColumns=True)


def histogram_rollup(df: DataFrame, tier: str) -> DataFrame:
    """Partial sums by service, metric and bucket of time: counts, sums, element-wise bucket counts; the earliest
    bounds.  Points without buckets count too.  Rows of several runs or batches can be appended."""
    at = F.when(F.size("bounds") > 0, F.struct("timestamp_nano", "event_id"))
    return _summed(df.withColumn("minute", bucket("timestamp_nano", TIERS[tier])).withColumn("bounds_at", at))


def _summed(df: DataFrame) -> DataFrame:
    """Histograms by HISTOGRAM_KEYS as one, the bounds with the least ``bounds_at``; one row per element crosses the exchange."""
    each = df.select(*HISTOGRAM_KEYS, "total_count", "total_sum", "bounds", "bounds_at", F.posexplode_outer("bucket_counts").alias("p", "c"))
    first = F.coalesce("p", F.lit(0)) == 0
    each = each.groupBy(*HISTOGRAM_KEYS, "p").agg(
        F.sum("c").alias("c"),
        F.sum(F.when(first, F.col("total_count"))).alias("total_count"),
        F.sum(F.when(first, F.col("total_sum"))).alias("total_sum"),
        F.min_by("bounds", "bounds_at").alias("bounds"),
        F.min("bounds_at").alias("bounds_at"),
    )
    counts = F.transform(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "c")))), lambda x: x.c)
    return each.groupBy(*HISTOGRAM_KEYS).agg(
        F.sum("total_count").alias("total_count"),
        F.sum("total_sum").alias("total_sum"),
        F.coalesce(F.min_by("bounds", "bounds_at"), F.array().cast("array<double>")).alias("bounds"),
        F.min("bounds_at").alias("bounds_at"),
        counts.alias("bucket_counts"),
    )


def histograms(rollup: DataFrame, service: str = "", name: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 100) -> DataFrame:
    """Counts, sums, averages (0 without a count) and interpolated percentiles from a rollup, whose partial rows are
    merged; newest first."""
    df = _summed(equals(rollup.filter(buckets_between("minute", from_ms, to_ms)), service_name=service, metric_name=name))
    df = histogram_percentiles(df, {"p50": 50, "p95": 95, "p99": 99})
    average = F.coalesce(F.try_divide("total_sum", "total_count"), F.lit(0.0))
    df = df.select(*HISTOGRAM_KEYS, "total_count", F.round("total_sum", 4).alias("total_sum"), F.round(average, 7).alias("average"), *[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")])
    return page(df, [F.col("minute").desc(), F.col("service_name"), F.col("metric_name")], limit)


def histograms_tiered(rollups: dict[str, DataFrame], service: str = "", name: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 100) -> DataFrame:
    """histograms() of the rollup (1m, 5m, 1h) that the range asks for."""
    return histograms(rollups[choose_tier(from_ms, to_ms)], service, name, from_ms, to_ms, limit)


def metric_minutes(df: DataFrame, service: str = "", from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Average, greatest and least value of runtime metrics by minute."""
    df = equals(df.filter(nanos_between("timestamp_nano", from_ms, to_ms)), service_name=service)
    wanted = F.col("name").like("jvm.%") | F.col("name").like("process.%") | F.col("name").like("system.%") | F.col("name").isin(*NAMED)
    return df.filter(wanted).groupBy("service_name", "name", bucket("timestamp_nano", 60).alias("minute")).agg(F.round(F.avg("value"), 4).alias("avg_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))


def jvm_snapshot(scalars: DataFrame, histograms: DataFrame) -> DataFrame:
    """The last value of each runtime field per service, of collections the last count, time in ms and name that
    isn't blank, and the time of the newest point of any."""
    names = {n: f for f, ns in JVM_FIELDS.items() for n in ns}
    field = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("name"))
    a = scalars.filter(F.col("name").isin(*names)).select("service_name", "timestamp_nano", "event_id", field.alias("field"), "value")
    gc = histograms.filter(F.col("metric_name") == GC).select("service_name", "timestamp_nano", "event_id", F.lit("gc").alias("field"), F.col("total_sum").alias("value"), "total_count", attribute("attributes", GC_NAME).alias("gc_name"))
    df = a.unionByName(gc, allowMissingColumns=True)
    at = F.struct("timestamp_nano", "event_id")
    last = lambda c, test: F.max_by(F.when(test, F.col(c)), F.when(test, at))
    return df.groupBy("service_name").agg(
        F.max("timestamp_nano").alias("timestamp_nano"),
        *[last("value", F.col("field") == f).alias(f) for f in JVM_FIELDS],
        last("total_count", F.col("field") == "gc").cast("double").alias("gc_count_delta"),
        (last("value", F.col("field") == "gc") * 1000).alias("gc_pause_ms_total_delta"),
        last("gc_name", F.col("gc_name") != "").alias("gc_collection_name"),
    )


def service_overview(spans: DataFrame, scalars: DataFrame, logs: DataFrame) -> DataFrame:
    """Spans and errors, distinct metrics and points, top metrics, and logs by severity, as (what, service, item, n, m)."""
    a = spans.groupBy("service_name").agg(F.count("*").alias("n"), F.sum((F.col("status_code") == 2).cast("long")).alias("m")).select(F.lit("spans").alias("what"), "service_name", F.lit("").alias("item"), "n", "m")
    b = scalars.groupBy("service_name").agg(F.count("*").alias("n"), F.countDistinct("name").alias("m")).select(F.lit("metrics").alias("what"), "service_name", F.lit("").alias("item"), "n", "m")
    c = scalars.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(10).select(F.lit("top metric").alias("what"), F.lit("").alias("service_name"), F.col("name").alias("item"), "n", F.lit(0).cast("long").alias("m"))
    d = logs.groupBy("service_name", "severity_text").agg(F.count("*").alias("n")).select(F.lit("logs").alias("what"), "service_name", F.col("severity_text").alias("item"), "n", F.lit(0).cast("long").alias("m"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def ingest_stats(**tables: DataFrame) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("received")).select(F.lit(name).alias("signal"), "received")
        out = row if out is None else out.unionByName(row)
    return out


def ingest_summary(spans: DataFrame) -> DataFrame:
    """Spans and errors of each service."""
    return spans.groupBy("service_name").agg(F.count("*").alias("spans"), F.sum((F.col("status_code") == 2).cast("long")).alias("errors"))


def pod_contexts(spans: DataFrame, service: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 20) -> DataFrame:
    """The pods, nodes, namespaces and hosts of spans that name a pod or a host, most frequent first."""
    df = equals(spans.filter(nanos_between("start_time_nano", from_ms, to_ms)), service_name=service)
    keys = {"pod": "k8s.pod.name", "node": "k8s.node.name", "namespace": "k8s.namespace.name", "host": "host.name"}
    df = df.select("service_name", *[attribute("attributes", k).alias(c) for c, k in keys.items()])
    g = df.filter("pod <> '' or host <> ''").groupBy("service_name", *keys).agg(F.count("*").alias("span_count"))
    return page(g, [F.col("span_count").desc(), *map(F.col, ("service_name", *keys))], limit)


def infra_correlation(spans: DataFrame, scalars: DataFrame, from_ms: int | None = None, to_ms: int | None = None, service: str = "", most: int = 20) -> DataFrame:
    """For each service whose spans name a pod or host: its ``most`` most frequent contexts (what: context) and its metric
    minutes (what: minute).  A service without a context has no rows."""
    places = pod_contexts(spans, service, from_ms, to_ms, None)
    rank = F.row_number().over(Window.partitionBy("service_name").orderBy(F.col("span_count").desc(), "pod", "node", "namespace", "host"))
    contexts = places.withColumn("position", rank).filter(F.col("position") <= most)
    minutes = metric_minutes(scalars, service, from_ms, to_ms).join(contexts.select("service_name").distinct(), "service_name", "left_semi")
    return contexts.withColumn("what", F.lit("context")).unionByName(minutes.withColumn("what", F.lit("minute")), allowMissingColumns=True)


def pod_summary(df: DataFrame, service: str = "", from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Average and greatest use of each pod, its latest limits and time."""
    df = equals(at_between(df, "sampled_at_ms", from_ms, to_ms), service_name=service)
    at = F.struct("sampled_at_ms", "event_id")
    return df.groupBy("service_name", "pod_name", "node_name", "namespace").agg(
        F.round(F.avg("cpu_usage_millicore"), 4).alias("avg_cpu"), F.max("cpu_usage_millicore").alias("max_cpu"), F.round(F.avg("memory_usage_bytes"), 2).alias("avg_memory"), F.max("memory_usage_bytes").alias("max_memory"),
        F.max_by("cpu_limit_millicore", at).alias("cpu_limit"), F.max_by("memory_limit_bytes", at).alias("memory_limit"), F.max("sampled_at_ms").alias("last_seen_ms"),
    )


def profile_summary(df: DataFrame, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    df = at_between(df, "sampled_at_ms", from_ms, to_ms)
    return df.groupBy("service_name", "profile_type").agg(F.count("*").alias("n"), F.max("sampled_at_ms").alias("last_ms"), F.round(F.avg("duration_ms"), 4).alias("avg_duration_ms"))


def profiles(df: DataFrame, service: str = "", profile_type: str = "", limit: int = 50, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Profiles without their payload, newest first; a limit outside 1-200 means 50."""
    df = equals(at_between(df.drop("payload"), "sampled_at_ms", from_ms, to_ms), service_name=service, profile_type=profile_type)
    return page(df, [F.col("sampled_at_ms").desc(), F.col("id")], limit if 1 <= limit <= 200 else 50)


def profile_payload(df: DataFrame, profile_id: str) -> DataFrame:
    return df.filter(F.col("id") == profile_id).select("id", "format", "payload").limit(1)


def pod_metrics(df: DataFrame, service: str = "", pod: str = "", limit: int = 200, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """A pod's samples, newest first; a limit outside 1-1000 means 200."""
    df = equals(at_between(df, "sampled_at_ms", from_ms, to_ms), service_name=service, pod_name=pod)
    return page(df, [F.col("sampled_at_ms").desc(), F.col("event_id")], limit if 1 <= limit <= 1000 else 200)
