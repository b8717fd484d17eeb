"""All telemetry queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.core import latest, severity_label
from spanloom.operators import alerts, correlate, logs, metrics, sampling, traces
from spanloom.plans import alerting, events, trees  # noqa: F401  their queries are registered on import
from spanloom.plans.base import DAY, GLOBS, ORACLES, QUERIES, SAMPLING, T0, Query, add, bucket_sql, on

# traces
for _tier, _seconds in (("1m", 60), ("5m", 300), ("1h", 3600)):
    add(
        f"red_{_tier}", on("spans")(lambda s, t=_tier: traces.red(s, t, limit=None)),
        f"""select service_name, name as span_name, http_route, {bucket_sql('start_time_nano', _seconds)} as minute, count(*) as rps,
    cast(sum(case when status_code = 2 then 1 else 0 end) as bigint) as error_count,
        round(sum(case when status_code = 2 then 1 else 0 end) / count(*) * 100, 4) as error_rate, round(quantile_cont(duration_nano, 0.5) / 1e6,
    4) as p50, round(quantile_cont(duration_nano, 0.95) / 1e6, 4) as p95, round(quantile_cont(duration_nano, 0.99) / 1e6, 4) as p99
        from spans where kind in (2, 5) group by 1, 2, 3, 4""", "spans",
    )
add("red_top", on("spans")(lambda s: traces.red(s, "1m", "svc-3", T0 + 5 * DAY, T0 + 9 * DAY, 50)),
    f"""select service_name, name as span_name, http_route, {bucket_sql('start_time_nano', 60)} as minute, count(*) as rps,
    cast(sum(case when status_code = 2 then 1 else 0 end) as bigint) as error_count,
    round(sum(case when status_code = 2 then 1 else 0 end) / count(*) * 100, 4) as error_rate,
    round(quantile_cont(duration_nano, 0.5) / 1e6, 4) as p50, round(quantile_cont(duration_nano, 0.95) / 1e6, 4) as p95,
    round(quantile_cont(duration_nano, 0.99) / 1e6, 4) as p99 from spans where kind in (2, 5) and service_name = 'svc-3'
    and {bucket_sql('start_time_nano', 60)} between {(T0 + 5 * DAY) * 10**6} and {(T0 + 9 * DAY) * 10**6} group by 1, 2, 3, 4 order by minute desc, 1,
    2, 3 limit 50""", "spans")  # fmt: skip
_span = ["trace_id", "span_id", "service_name", "name", "start_time_nano", "duration_nano", "status_code"]
add("spans_filter", on("spans")(lambda s: traces.spans(s, None, 0, T0 + DAY, T0 + 25 * DAY, "svc-2", min_duration_ms=10).select(*_span)),
    f"select {', '.join(_span)} from spans where received_at_ms between {T0 + DAY} and {T0 + 25 * DAY} and service_name = 'svc-2' and duration_nano >= 10000000", "spans")
add("spans_page", on("spans")(lambda s: traces.spans(s, 100, 50, status=2).select(*_span)), f"select {', '.join(_span)} from spans where status_code = 2 order by received_at_ms desc, span_id limit 100 offset 50", "spans")
add("promoted_attributes", on("spans")(lambda s: traces.promote_attributes(s.withColumn("attributes", F.create_map(F.lit("http.route"), "http_route", F.lit("db.system"), "db_system", F.lit("http.response.status_code"), F.concat(F.col("event_id").cast("string"), F.lit(" ok"))))).select("span_id", "http_route", "db_system", "http_status_code", "rpc_method")),
    "select span_id, http_route, db_system, cast(event_id % 65536 as int) as http_status_code, '' as rpc_method from spans", "spans")
add("derived_columns", on("spans")(lambda s: traces.derived_columns(s).select("span_id", F.round("duration_ms", 4).alias("duration_ms"), "is_error", "span_kind_str")),
    """select span_id, round(duration_nano / 1e6, 4) as duration_ms, status_code = 2 as is_error,
    case kind when 1 then 'INTERNAL' when 2 then 'SERVER' when 3 then 'CLIENT' when 4 then 'PRODUCER' when 5 then 'CONSUMER' else 'UNSPECIFIED' end as
    span_kind_str from spans""", "spans")  # fmt: skip
add("exclude_spans", on("spans")(lambda s: traces.exclude_spans(s.withColumn("attributes", F.create_map(F.lit("url.path"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/x"), "http_route")).otherwise(F.col("http_route")))), GLOBS).select("span_id", "name")),
    "select span_id, name from spans where event_id % 3 = 0 and not regexp_matches(name, '^clic[^/]$') and not regexp_matches(name, '^v[^/]*w$')", "spans")
add("topology", on("spans")(lambda s: traces.topology(traces.topology_rollup(s))),
    """select service_name as caller, peer_service as callee, count(*) as calls, cast(sum(case when status_code = 2 then 1 else 0 end) as bigint) as errors,
    round(sum(case when status_code = 2 then 1 else 0 end) / count(*) * 100, 4) as error_rate, round(sum(duration_nano) / count(*) / 1e6, 4) as avg_ms
    from spans where kind = 3 and peer_service <> '' group by 1, 2""", "spans")  # fmt: skip
# logs
_log = ["event_id", "timestamp_nano", "severity_text", "body", "service_name"]
add("logs_filter", on("logs")(lambda l: logs.logs(l, None, 0, T0 + DAY, T0 + 20 * DAY, "svc-4", "INFO").select(*_log)), f"select {', '.join(_log)} from logs where received_at_ms between {T0 + DAY} and {T0 + 20 * DAY} and service_name = 'svc-4' and severity_text = 'INFO'", "logs")
add("logs_page", on("logs")(lambda l: logs.logs(l, 100, 20, T0 + DAY, T0 + 20 * DAY, severity="WARN").select(*_log)),
    f"""select {', '.join(_log)} from logs where received_at_ms between {T0 + DAY} and {T0 + 20 * DAY}
    and severity_text = 'WARN' order by received_at_ms desc, event_id limit 100 offset 20""", "logs")  # fmt: skip
add("severity_labels", on("logs")(lambda l: l.select("event_id", severity_label((F.col("event_id") % 27 - 2).cast("int")).alias("label"))),
    """select event_id, case when n <= 0 then 'UNSPECIFIED' when n <= 4 then 'TRACE' when n <= 8 then 'DEBUG' when n <= 12 then 'INFO' when n <= 16 then
    'WARN' when n <= 20 then 'ERROR' else 'FATAL' end as label from (select event_id, event_id % 27 - 2 as n from logs)""", "logs")  # fmt: skip
add("log_search", on("logs")(lambda l: logs.log_search(l, severity="error", keyword="USER 1", limit=None).select(*_log)), f"select {', '.join(_log)} from logs where severity_text = 'ERROR' and contains(lower(body), 'user 1')", "logs")
add("log_context", on("logs")(lambda l: logs.log_context(l, "svc-5", (T0 + 3 * DAY) * 10**6, 3600, None).select(*_log)), f"select {', '.join(_log)} from logs where service_name = 'svc-5' and timestamp_nano between {(T0 + 3 * DAY - 3_600_000) * 10**6} and {(T0 + 3 * DAY + 3_600_000) * 10**6}", "logs")
add("log_context_join", on("logs")(lambda l: logs.log_context_join(l.filter("severity_number >= 17").select(F.col("event_id").alias("point_id"), "service_name", F.col("timestamp_nano").alias("at_nano")), l, 120, 20).select("point_id", "event_id", "position")),
    """select point_id, event_id, position from (select p.event_id as point_id, l.event_id,
    cast(row_number() over (partition by p.event_id order by l.timestamp_nano, l.event_id) as int) as position from logs p
    join logs l on l.service_name = p.service_name and abs(l.timestamp_nano - p.timestamp_nano) <= 120000000000 where p.severity_number >= 17)
    where position <= 20""", "logs")  # fmt: skip
for _tier, _seconds in (("1m", 60), ("1h", 3600)):
    add(f"error_logs_{_tier}", on("logs")(lambda l, t=_tier: logs.error_logs(logs.error_log_rollup(l, t), limit=None)), f"select service_name, exception_type, {bucket_sql('timestamp_nano', _seconds)} as minute, count(*) as n from logs where severity_number >= 17 group by 1, 2, 3", "logs")
for _seconds in (60, 300):
    add(f"log_volume_{_seconds}", on("logs")(lambda l, n=_seconds: logs.log_volume(l, logs.log_volume_rollup(l), interval=n, limit=None)), f"select cast({bucket_sql('timestamp_nano', _seconds)} / 1000000 as bigint) as bucket_ms, severity_text, count(*) as n from logs group by 1, 2", "logs")
add("log_patterns", on("logs")(lambda l: logs.log_patterns(l, limit=None)), """select regexp_replace(left(body, 120), '[0-9]{4,}', 'N', 'g') as pattern, severity_text, service_name, count(*) as n,
    min(timestamp_nano) as first_seen, max(timestamp_nano) as last_seen from logs group by 1, 2, 3""", "logs")
add("log_patterns_top", on("logs")(lambda l: logs.log_patterns(l, "svc-1", T0 + DAY, T0 + 20 * DAY, 20)),
    f"""select regexp_replace(left(body, 120), '[0-9]{{4,}}', 'N', 'g') as pattern, severity_text, service_name, count(*) as n, min(timestamp_nano) as first_seen, max(timestamp_nano) as last_seen from logs
    where service_name = 'svc-1' and timestamp_nano between {(T0 + DAY) * 10**6} and {(T0 + 20 * DAY) * 10**6} group by 1, 2, 3 order by n desc, pattern, severity_text, service_name limit 20""", "logs")  # fmt: skip
add("log_fields", on("logs")(lambda l: logs.log_fields(l)),
    """, f as (select 'severity' as field, severity_text as value from logs union all select 'logger', logger_name from logs where logger_name <> ''
    union all select 'exception', exception_type from logs where exception_type <> '' union all select 'total', 'all' from logs)
    select * from (select field, value, count(*) as n, cast(row_number() over (partition by field order by count(*) desc, value) as int) as rank
    from f group by 1, 2) where rank <= 10 or field = 'severity'""", "logs")  # fmt: skip

# metrics
add("service_overview", on("spans", "metrics", "logs")(metrics.service_overview),
    """select 'spans' as what, service_name, '' as item, count(*) as n, cast(sum(case when status_code = 2 then 1 else 0 end) as bigint) as m from spans
    group by 2 union all select 'metrics', service_name, '', count(*), count(distinct name) from metrics group by 2
    union all select * from (select 'top metric', '', name, count(*), 0 from metrics group by 3 order by 4 desc, 3 limit 10) union all select 'logs',
    service_name, severity_text, count(*), 0 from logs group by 2, 3""", "spans", "metrics", "logs")  # fmt: skip
add("ingest_stats", on("spans", "metrics", "logs")(lambda s, m, l: metrics.ingest_stats(spans=s, metrics=m, logs=l)), "select 'spans' as signal, count(*) as received from spans union all select 'metrics', count(*) from metrics union all select 'logs', count(*) from logs", "spans", "metrics", "logs")
add("ingest_summary", on("spans")(metrics.ingest_summary), "select service_name, count(*) as spans, cast(sum(case when status_code = 2 then 1 else 0 end) as bigint) as errors from spans group by 1", "spans")
add("pod_summary", on("pod_metrics")(lambda p: metrics.pod_summary(p)),
    """select service_name, pod_name, node_name, namespace, round(avg(cpu_usage_millicore), 4) as avg_cpu, max(cpu_usage_millicore) as max_cpu,
    round(avg(memory_usage_bytes), 2) as avg_memory, max(memory_usage_bytes) as max_memory, arg_max(cpu_limit_millicore, (sampled_at_ms,
    event_id)) as cpu_limit, arg_max(memory_limit_bytes, (sampled_at_ms, event_id)) as memory_limit, max(sampled_at_ms) as last_seen_ms
    from pod_metrics group by 1, 2, 3, 4""", "pod_metrics")  # fmt: skip
add("profile_summary", on("profiles")(lambda p: metrics.profile_summary(p)), "select service_name, profile_type, count(*) as n, max(sampled_at_ms) as last_ms, round(avg(duration_ms), 4) as avg_duration_ms from profiles group by 1, 2", "profiles")
add("profile_payload", on("profiles")(lambda p: metrics.profile_payload(p, "p77")), "select id, format, payload from profiles where id = 'p77'", "profiles")
# across signals
add("nearby_deployments", on("anomalies", "deployments")(lambda a, d: correlate.nearby_deployments(a, d, 3_600_000)),
    """select * from (select a.id as anomaly_id, a.service_name, d.id as deployment_id, version, deployed_at_ms,
    cast(row_number() over (partition by a.id order by deployed_at_ms desc, d.id) as int) as position from anomalies a
    join deployments d on a.service_name = d.service_name and abs(detected_at_ms - deployed_at_ms) <= 3600000) where position <= 10""", "anomalies", "deployments")  # fmt: skip
_zone = f"""select service_name, name as span_name, http_route, {bucket_sql('start_time_nano', 60)} as minute, status_code, duration_nano,
    cast(floor(start_time_nano / 3600000000000) as bigint) as h from spans where kind in (2, 5)"""
_base = f""", z as ({_zone}), k as (select *, cast(h % 24 as int) as hour, cast((cast(floor(h / 24) as bigint) + 3) % 7 + 1 as int) as dow from z),
    x as (select service_name, span_name, http_route, dow, hour, quantile_cont(duration_nano, 0.5) as a, quantile_cont(duration_nano, 0.95) as b,
    quantile_cont(duration_nano, 0.99) as c, avg(case when status_code = 2 then 1e0 else 0e0 end) as er, count(*) as sc from k group by 1, 2, 3, 4,
    5),
    mm as (select service_name, span_name, http_route, dow, hour, minute, count(*) as n, avg(case when status_code = 2 then 1e0 else 0e0 end) as e,
    quantile_cont(duration_nano, 0.95) as d from k group by 1, 2, 3, 4, 5, 6),
    y as (select service_name, span_name, http_route, dow, hour, count(*) as minutes, avg(n) as nm, stddev_pop(n) as nd, avg(e) as em,
    stddev_pop(e) as ed, avg(d) as dm, stddev_pop(d) as dd from mm group by 1, 2, 3, 4, 5)"""
add("red_baseline", on("spans")(correlate.red_baseline),
    _base + """ select service_name, span_name, http_route, dow, hour, round(a / 1e6, 6) as p50, round(b / 1e6, 6) as p95, round(c / 1e6, 6) as p99, round(er,
    6) as error_rate, round(sc / (minutes * 60), 6) as avg_rps, sc as sample_count, round(nm, 6) as count_mean, round(nd, 6) as count_dev, round(em,
    6) as error_mean, round(ed, 6) as error_dev, round(dm / 1e6, 6) as p95_mean, round(dd / 1e6, 6) as p95_dev from x join y using (service_name,
    span_name, http_route, dow, hour)""", "spans")  # fmt: skip
_zscores = _base + """, q as (select service_name, span_name, http_route, dow, hour, round(nm, 6) as nm, round(nd, 6) as nd, round(em, 6) as em, round(ed, 6) as ed,
    round(dm / 1e6, 6) as dm, round(dd / 1e6, 6) as dd from y),
    v as (select mm.*, q.nm, q.nd, q.em, q.ed, q.dm, q.dd from mm join q using (service_name, span_name, http_route, dow, hour)),
    u as (select service_name, span_name, http_route, minute, 'latency_p95_spike' as anomaly_type, (d / 1e6 - dm) / nullif(dd, 0) as z from v
    union all select service_name, span_name, http_route, minute, 'error_rate_spike', (e - em) / nullif(ed, 0) from v union all select service_name,
    span_name, http_route, minute, 'traffic_drop', (nm - n) / nullif(nd, 0) from v),
    g as (select * from u where z >= 1.2),
    a as (with recursive t as (select service_name, span_name, http_route, anomaly_type, min(minute) as minute from g group by 1, 2, 3, 4
      union all select service_name, span_name, http_route, anomaly_type, min(g.minute) from t join g using (service_name, span_name, http_route,
    anomaly_type) where g.minute >= t.minute + {quiet} group by service_name, span_name, http_route, anomaly_type) select * from t)
    select service_name, span_name, anomaly_type, cast(minute / 1000000 as bigint) as detected_at_ms,
    case when z >= 2.0 then 'critical' else 'warning' end as severity from g join a using (service_name, span_name, http_route, anomaly_type, minute)"""
_columns = ["service_name", "span_name", "anomaly_type", "detected_at_ms", "severity"]
add("zscore_anomalies", on("spans")(lambda s: correlate.detect_anomalies(s, correlate.red_baseline(s), 1.2, 2.0).select(*_columns)), _zscores.replace("{quiet}", str(10 * 60 * 10**9)), "spans")
# so long a silence that alerts follow one another in long rows
add("zscore_anomalies_quiet", on("spans")(lambda s: correlate.detect_anomalies(s, correlate.red_baseline(s), 0.5, 2.0, 1440).select(*_columns)), _zscores.replace("{quiet}", str(1440 * 60 * 10**9)).replace("z >= 1.2", "z >= 0.5"), "spans")
add("rca_rows", on("anomalies", "spans", "deployments")(lambda a, s, d: correlate.rca_rows(a, s, d)),
    """, e as (select a.id, span_id, row_number() over (partition by a.id order by start_time_nano, span_id) as r from anomalies a
    join spans s on s.service_name = a.service_name and s.status_code = 2
    and floor(s.start_time_nano / 60000000000) = floor(a.detected_at_ms / 60000)),
    c as (select id, concat('["', string_agg(span_id, '","' order by r), '"]') as spans from e where r <= 10 group by 1),
    d as (select a.id, d.id as deployment_id, row_number() over (partition by a.id order by deployed_at_ms desc, d.id) as r from anomalies a
    join deployments d on a.service_name = d.service_name and abs(detected_at_ms - deployed_at_ms) <= 300000),
    f as (select id, concat('["', string_agg(deployment_id, '","' order by r), '"]') as deps from d where r <= 10 group by 1)
    select a.id, service_name, span_name, anomaly_type, severity, detected_at_ms, coalesce(spans, '[]') as correlated_spans, coalesce(deps,
    '[]') as nearby_deployments from anomalies a left join c on c.id = a.id left join f on f.id = a.id""", "anomalies", "spans", "deployments")  # fmt: skip

# objectives, alerts, versioned tables
add("latest_versions", lambda spark, sf: latest(spark.read.parquet(f"{sf}/orders.parquet"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice"),
    """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n
    from orders) where n = 1""")  # fmt: skip
add("retention", on("spans")(lambda s: alerts.apply_retention(s, 10, "2024-01-25").groupBy("dt").count().select(F.col("dt").cast("string").alias("dt"), F.col("count").alias("n"))),
    """select cast(cast(make_timestamp(received_at_ms * 1000) as date) as string) as dt, count(*) as n from spans
    where cast(make_timestamp(received_at_ms * 1000) as date) >= date '2024-01-15' group by 1""", "spans")  # fmt: skip
add("schema_evolution", on("spans", "logs")(lambda s, l: alerts.evolve([s.select("span_id", "service_name"), l.select("span_id", "severity_text")], {"service_name": "unknown", "severity_text": "NONE"})),
    "select span_id, service_name, 'NONE' as severity_text from spans union all select span_id, 'unknown', severity_text from logs", "spans", "logs")

# sampling and cardinality
_hash = "case when length(trace_id) >= 32 then cast(concat('0x', right(trace_id, 16)) as ubigint) else 0 end"
add("trace_hash", on("spans")(lambda s: s.select("trace_id").distinct().select("trace_id", sampling.trace_hash(F.col("trace_id")).cast("string").alias("hash"))), f"select distinct trace_id, cast({_hash} as string) as hash from spans", "spans")
_kept = f"""f as (select trace_id, bool_or(status_code = 2) as failed, coalesce(arg_min(duration_nano, (received_at_ms, span_id)) filter (parent_span_id = ''),
    max(duration_nano)) as ms, coalesce(arg_min(service_name, (received_at_ms, span_id)) filter (parent_span_id = ''), arg_min(service_name,
    (received_at_ms, span_id))) as service_name from spans group by 1),
    k as (select trace_id, case when service_name in ('svc-0',
    'svc-1') then case when {_hash} < {2**63} then 'probabilistic' end when service_name = 'svc-7' then null when failed then 'error' when ms >
    150000000 then 'latency' when {_hash} < {2**62} then 'probabilistic' end as reason from f)"""
add("tail_sample", on("spans")(lambda s: sampling.tail_sample(s, SAMPLING).select("trace_id", "span_id")), f", {_kept} select trace_id, span_id from spans where trace_id in (select trace_id from k where reason is not null)", "spans")
add("sampling_reasons", on("spans")(lambda s: sampling.sampled_traces(s, SAMPLING).select("trace_id", "reason")), f", {_kept} select trace_id, reason from k where reason is not null", "spans")
add("cardinality_limit", on("spans")(lambda s: sampling.limit_cardinality(s.withColumn("attributes", F.create_map(F.lit("user"), F.col("duration_nano").cast("string"), F.lit("pod"), "pod_name")), "attributes", ["start_time_nano", "span_id"], 100).select("span_id", F.element_at("attributes", "user").alias("user"), F.element_at("attributes", "pod").alias("pod"))),
    f""", v as (select service_name, duration_nano as d, row_number() over (partition by service_name order by min((start_time_nano, span_id)),
    cast(duration_nano as string)) as r from spans group by service_name, duration_nano)
    select span_id, case when r <= 100 then cast(duration_nano as string) else '{sampling.HIGH_CARDINALITY}' end as user, pod_name as pod from spans s
    join v on v.service_name = s.service_name and v.d = s.duration_nano""", "spans")  # fmt: skip


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
