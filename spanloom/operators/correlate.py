"""Joins across signals, and the detectors built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.core import NANO, bucket, latest, nanos_between
from spanloom.functions.ranking import first_within
from spanloom.plans.tables import cut

MINUTE_MS = 60_000


#: Lengths of buckets in minutes: a range of any length is a few buckets of one of them.
SPREAD, SCALES = 16, tuple(16**k for k in range(8))


def minutes_within(ranges: DataFrame, minutes: DataFrame) -> DataFrame:
    """ranges (service_name, from_min, to_min) joined with the rows of minutes (service_name, minute) inside.

    Joined by service and bucket: a range takes the shortest buckets of which it meets at most
    SPREAD + 1, so that a trace with a wrong clock costs no more rows than another.
    """
    scale = F.lit(SCALES[-1]).cast("long")
    for x in SCALES[-2::-1]:
        scale = F.when(F.col("to_min") - F.col("from_min") < x * SPREAD, F.lit(x).cast("long")).otherwise(scale)
    buckets = F.sequence(F.floor(F.col("from_min") / F.col("_scale")), F.floor(F.col("to_min") / F.col("_scale")))
    r = ranges.filter("from_min <= to_min").withColumn("_scale", scale).withColumn("_b", F.explode(buckets))
    each = F.explode(F.array(*[F.lit(x).cast("long") for x in SCALES]))
    m = minutes.withColumn("_scale", each).withColumn("_b", F.floor(F.col("minute") / F.col("_scale")))
    return r.join(m, ["service_name", "_scale", "_b"]).filter("minute between from_min and to_min").drop("_scale", "_b")


def trace_heads(spans: DataFrame) -> DataFrame:
    """``trace_id, service_name, from_ms, to_ms`` of traces from their spans (position, at_ms, duration_ms): the first service that isn't
    blank, the first start that isn't 0, the last end.  Traces without such a service or a positive start have no row."""
    named = F.col("service_name") != ""
    g = spans.groupBy("trace_id").agg(
        F.min_by(F.when(named, F.col("service_name")), F.when(named, F.col("position"))).alias("service_name"),
        F.min(F.when(F.col("at_ms") != 0, F.col("at_ms"))).alias("from_ms"),
        F.greatest(F.max(F.col("at_ms") + F.col("duration_ms")), F.lit(0)).alias("to_ms"),
    )
    return g.filter("service_name is not null and from_ms > 0")


def trace_context(spans: DataFrame, logs: DataFrame, most_spans: int = 500, most_logs: int = 200) -> DataFrame:
    """For every trace its spans by start, the logs that name it or fall in its time at its service, and that service's
    rates per minute around it: a row each, by ``trace_id, what, position``.

    item, name: a span's id and name, a log's id and severity, a service; a log's own trace and span are ``log_trace_id`` and
    ``log_span_id``.  Logs by time lie between the first and last millisecond of the trace, bounds included; rates are those of minutes
    that begin from a minute before to a minute after it, in whole seconds.  A trace's logs by time are found by their places in
    their service's order, the first ``most_logs`` only, so a crowded minute costs a trace no more than that.
    """
    by_start = Window.partitionBy("trace_id").orderBy("start_time_nano", "span_id")
    s = spans.withColumn("position", F.row_number().over(by_start)).filter(F.col("position") <= most_spans)
    s = s.select(
        "trace_id", F.lit("span").alias("what"), "position", F.col("span_id").alias("item"), "name", "service_name", "parent_span_id",
        F.expr("start_time_nano div 1000000").alias("at_ms"), F.expr("(end_time_nano - start_time_nano) div 1000000").alias("duration_ms"),
        "status_code", "exception_type", "exception_message", "http_status_code",
    )
    head = trace_heads(s)
    # logs: by id, and by service and time
    l = logs.select(
        F.col("trace_id").alias("log_trace_id"), F.col("span_id").alias("log_span_id"), F.col("event_id").alias("log_id"), F.col("severity_text").alias("name"),
        "service_name", "timestamp_nano", "exception_type", "body",
    )
    own = l.join(s.select(F.col("trace_id").alias("log_trace_id")).distinct(), "log_trace_id", "left_semi").withColumn("trace_id", F.col("log_trace_id"))
    ranges = head.select("trace_id", "service_name", (F.col("from_ms") * 1_000_000).alias("range_from"), (F.col("to_ms") * 1_000_000).alias("range_to"))
    near = first_within(ranges, l, "service_name", "timestamp_nano", ["log_id"], most_logs).drop("position")
    log_order = Window.partitionBy("trace_id").orderBy("timestamp_nano", "log_id")
    both = own.unionByName(near).distinct().withColumn("position", F.row_number().over(log_order)).filter(F.col("position") <= most_logs)
    both = both.withColumns({"what": F.lit("log"), "item": F.col("log_id").cast("string"), "at_ms": F.expr("timestamp_nano div 1000000")})
    rows = s.unionByName(both.drop("log_id", "timestamp_nano"), allowMissingColumns=True)
    # rates of the service in the minutes around
    red = spans.filter(F.col("kind").isin(2, 5)).groupBy("service_name", (bucket("start_time_nano", 60) / (60 * NANO)).cast("long").alias("minute"))
    red = red.agg(F.count("*").alias("n"), F.sum((F.col("status_code") == 2).cast("long")).alias("errors"), F.round(F.percentile("duration_nano", F.lit(0.95)) / 1e6, 6).alias("p95_ms"))
    second = lambda c: F.expr(f"{c} div 1000")
    around = head.select("trace_id", "service_name", F.ceil((second("from_ms") - 60) / 60).alias("from_min"), F.floor((second("to_ms") + 60) / 60).alias("to_min"))
    red = minutes_within(around, red).withColumn("position", F.row_number().over(Window.partitionBy("trace_id").orderBy("minute")))
    red = red.select("trace_id", F.lit("red").alias("what"), "position", F.col("service_name").alias("item"), "service_name", (F.col("minute") * MINUTE_MS).alias("at_ms"), "n", "errors", "p95_ms")
    return rows.unionByName(red, allowMissingColumns=True)


def nearby_deployments(anomalies: DataFrame, deployments: DataFrame, window_ms: int = 300_000, most: int = 10) -> DataFrame:
    """For each anomaly the deployments of its service within the window, newest first; times count backwards, so the newest
    are the first of a range."""
    at = -F.col("detected_at_ms")
    a = anomalies.select(F.col("id").alias("anomaly_id"), "service_name", (at - window_ms).alias("range_from"), (at + window_ms).alias("range_to"))
    d = deployments.select(F.col("id").alias("deployment_id"), "service_name", "version", "deployed_at_ms", (-F.col("deployed_at_ms")).alias("_back"))
    found = first_within(a, d, "service_name", "_back", ["deployment_id"], most)
    return found.select("anomaly_id", "service_name", "deployment_id", "version", "deployed_at_ms", "position")


def red_baseline(spans: DataFrame, now_ms: int | None = None, days: int = 28) -> DataFrame:
    """By service, span, route, weekday (1 is Monday) and hour: percentiles, error rate, requests per second, and
    the mean and deviation of per-minute counts, error rates and p95.  With ``now_ms``, of the ``days`` before it only,
    and with the time of computing as ``computed_at_ms``."""
    if now_ms is not None:
        whole = red_baseline(spans.filter(nanos_between("start_time_nano", now_ms - days * 86_400_000, now_ms)))
        return whole.withColumn("computed_at_ms", F.lit(now_ms).cast("long"))
    df = spans.filter(F.col("kind").isin(2, 5)).select("service_name", F.col("name").alias("span_name"), "http_route", bucket("start_time_nano", 60).alias("minute"), "status_code", "duration_nano")
    keys = ["service_name", "span_name", "http_route", "dow", "hour"]
    hours = F.floor(F.col("minute") / (3600 * NANO))
    timed = lambda d: d.withColumn("hour", F.pmod(hours, F.lit(24)).cast("int")).withColumn("dow", (F.pmod(F.floor(hours / 24) + 3, F.lit(7)) + 1).cast("int"))
    whole = timed(df).groupBy(*keys).agg(F.percentile("duration_nano", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.avg((F.col("status_code") == 2).cast("double")).alias("error_rate"), F.count("*").alias("sample_count"))
    minute = df.groupBy("service_name", "span_name", "http_route", "minute").agg(F.count("*").alias("n"), F.avg((F.col("status_code") == 2).cast("double")).alias("e"), F.percentile("duration_nano", F.lit(0.95)).alias("d"))
    each = timed(minute).groupBy(*keys).agg(F.count("*").alias("minutes"), *[x.alias(a) for c, n in (("n", "count"), ("e", "error"), ("d", "p95")) for x, a in ((F.avg(c), f"{n}_mean"), (F.stddev_pop(c), f"{n}_dev"))])
    r = lambda c, k: F.round(c, k)
    return whole.join(each, keys).select(*keys, *[r(F.get("p", F.lit(i)) / 1e6, 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], r(F.col("error_rate"), 6).alias("error_rate"), r(F.col("sample_count") / (F.col("minutes") * 60), 6).alias("avg_rps"), "sample_count",
                                         r(F.col("count_mean"), 6).alias("count_mean"), r(F.col("count_dev"), 6).alias("count_dev"), r(F.col("error_mean"), 6).alias("error_mean"), r(F.col("error_dev"), 6).alias("error_dev"), r(F.col("p95_mean") / 1e6, 6).alias("p95_mean"), r(F.col("p95_dev") / 1e6, 6).alias("p95_dev"))


def baseline_in_force(computed: DataFrame) -> DataFrame:
    """Of baselines computed at several times the newest of each place and hour."""
    return latest(computed, ["service_name", "span_name", "http_route", "dow", "hour"], F.col("computed_at_ms"))


def alerting(candidates: DataFrame, place: list[str], time: str, quiet: int) -> DataFrame:
    """The candidates that alert: of each place the first, and then each first one that comes ``quiet`` or more after the last
    that alerted; so what lasts alerts again.  A candidate's time is its own within its place.

    Each candidate points to the first one ``quiet`` on.  One that comes ``quiet`` or more after the candidate before it alerts
    whatever went before; from these the alerts are reached along the pointers, which double their length in each round,
    so a place with n alerts in a row takes log n rounds of joins and no walk.
    """
    end = 2**63 - 1
    by_time = Window.partitionBy("_place").orderBy(time)
    c = candidates.withColumn("_place", F.to_json(F.struct(*place)))
    after, before = F.coalesce(F.lead(time).over(by_time), F.lit(end)), F.lag(time).over(by_time)
    c = c.withColumns({"_after": after, "_starts": before.isNull() | (F.col(time) - before >= quiet)})
    # the candidate after the last one within ``quiet``
    c = cut(c.withColumn("_next", F.max("_after").over(by_time.rangeBetween(0, quiet - 1))))
    reached = c.filter("_starts").select("_place", F.col(time).alias("_at"))
    # a pointer to a start leads to what is reached already
    starts = reached.withColumnRenamed("_at", "_to")
    pointers = cut(c.filter(F.col("_next") < end).select("_place", F.col(time).alias("_at"), F.col("_next").alias("_to")).join(starts, ["_place", "_to"], "left_anti"))
    while not pointers.isEmpty():
        more = reached.join(pointers, ["_place", "_at"]).select("_place", F.col("_to").alias("_at"))
        reached = cut(reached.unionByName(more).distinct())
        far = pointers.select("_place", F.col("_at").alias("_to"), F.col("_to").alias("_far"))
        pointers = cut(pointers.join(far, ["_place", "_to"]).select("_place", "_at", F.col("_far").alias("_to")))
    reached = reached.withColumnRenamed("_at", time)
    return c.join(reached, ["_place", time], "left_semi").select(candidates.columns)


def _zscore_kinds() -> Column:
    """The three measures of a minute against its baseline, each with its z-score upwards of trouble."""
    of = {"latency_p95_spike": ("p95_mean", "p95_dev", 1), "error_rate_spike": ("error_mean", "error_dev", 1), "traffic_drop": ("count_mean", "count_dev", -1)}
    each = []
    for k, (mean, dev, sign) in of.items():
        z = F.try_divide((F.col(k) - F.col(mean)) * sign, F.col(dev))
        each.append(F.struct(F.lit(k).alias("anomaly_type"), F.col(k).alias("current_value"), F.col(mean).alias("baseline_value"), z.alias("z_score")))
    return F.explode(F.array(*each))


def detect_anomalies(spans: DataFrame, baseline: DataFrame, warning: float = 2.0, critical: float = 3.0, quiet_min: int = 10) -> DataFrame:
    """Minutes that lie off their baseline by z-score: p95 and error rate above, traffic below.  After an alert, the
    same kind at the same place is silent for ``quiet_min`` minutes; see alerting()."""
    place = ["service_name", "span_name", "http_route"]
    m = spans.filter(F.col("kind").isin(2, 5)).groupBy("service_name", F.col("name").alias("span_name"), "http_route", bucket("start_time_nano", 60).alias("minute"))
    m = m.agg(
        F.count("*").cast("double").alias("traffic_drop"),
        F.avg((F.col("status_code") == 2).cast("double")).alias("error_rate_spike"),
        (F.percentile("duration_nano", F.lit(0.95)) / 1e6).alias("latency_p95_spike"),
    )
    hours = F.floor(F.col("minute") / (3600 * NANO))
    m = m.withColumn("hour", F.pmod(hours, F.lit(24)).cast("int")).withColumn("dow", (F.pmod(F.floor(hours / 24) + 3, F.lit(7)) + 1).cast("int")).join(baseline, [*place, "dow", "hour"])
    c = m.select(*place, "minute", _zscore_kinds().alias("k")).select(*place, "minute", "k.*").filter(F.col("z_score") >= warning)
    c = alerting(c, [*place, "anomaly_type"], "minute", quiet_min * 60 * NANO)
    key = F.concat_ws("|", *place, "anomaly_type", F.col("minute").cast("string"))
    return c.select(
        F.sha2(key, 256).alias("id"), "service_name", "span_name", "anomaly_type", (F.col("minute") / 1_000_000).cast("long").alias("detected_at_ms"),
        F.round("current_value", 4).alias("current_value"), F.round("baseline_value", 4).alias("baseline_value"), F.round("z_score", 3).alias("z_score"),
        F.when(F.col("z_score") >= critical, "critical").otherwise("warning").alias("severity"),
    )


def rca_rows(anomalies: DataFrame, spans: DataFrame, deployments: DataFrame, most: int = 10) -> DataFrame:
    """Anomalies with the first failed spans of their service and minute and the deployments nearby, as JSON lists."""
    listed = lambda position, item: F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(position, item))), lambda x: x[item]))
    errors = spans.filter("status_code = 2").select("service_name", "span_id", "start_time_nano")
    start = F.floor(F.col("detected_at_ms") / MINUTE_MS) * (60 * NANO)
    ranges = anomalies.select("id", "service_name", start.alias("range_from"), (start + (60 * NANO - 1)).alias("range_to"))
    near = first_within(ranges, errors, "service_name", "start_time_nano", ["span_id"], most)
    near = near.groupBy("id").agg(listed("position", "span_id").alias("correlated_spans"))
    deployed = nearby_deployments(anomalies, deployments).groupBy(F.col("anomaly_id").alias("id")).agg(listed("position", "deployment_id").alias("nearby_deployments"))
    out = anomalies.join(near, "id", "left").join(deployed, "id", "left")
    lists = [F.coalesce(c, F.lit("[]")).alias(c) for c in ("correlated_spans", "nearby_deployments")]
    return out.select("id", "service_name", "span_name", "anomaly_type", "severity", "detected_at_ms", *lists)
