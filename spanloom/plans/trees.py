"""Queries of rollups, histograms, runtime metrics, broken traces, waterfalls and trace contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import correlate, logs, metrics, sampling, traces
from spanloom.plans.base import DAY, FAILED, T0, add, bucket_sql, on

# rates from rollups: below 200 rows a sketch holds every value, so its percentiles are those of the ranks
_sketch = """
select service_name, name as span_name, http_route, {bucket} as minute, count(*) as rps, {failed} as error_count,
  round({failed} / count(*) * 100, 4) as error_rate, round(quantile_disc(duration_nano, 0.5) / 1e6, 4) as p50,
  round(quantile_disc(duration_nano, 0.95) / 1e6, 4) as p95, round(quantile_disc(duration_nano, 0.99) / 1e6, 4) as p99
from spans where kind in (2, 5) and {where} group by 1, 2, 3, 4
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("error_rate", "p50", "p95", "p99")})


def _between(seconds: int, column: str, days: tuple[int, int]) -> str:
    return f"{bucket_sql(column, seconds)} between {(T0 + days[0] * DAY) * 10**6} and {(T0 + days[1] * DAY) * 10**6}"


add("red_sketch", on("spans")(lambda s: _rounded(traces.red_from_rollup(traces.red_rollup(s, "1h"), limit=None))),
    _sketch.format(bucket=bucket_sql("start_time_nano", 3600), failed=FAILED, where="true"), "spans")


def _tiers(df: DataFrame, rollup, tiers: str = "1m 5m 1h") -> dict[str, DataFrame]:
    return {t: rollup(df, t) for t in tiers.split()}


for _name, _days, _seconds in (("red_tiered", (3, 4), 300), ("red_tiered_long", (3, 9), 3600)):
    add(_name, on("spans")(lambda s, d=_days: _rounded(traces.red_tiered(_tiers(s, traces.red_rollup), "svc-2", T0 + d[0] * DAY, T0 + d[1] * DAY, None))),
        _sketch.format(bucket=bucket_sql("start_time_nano", _seconds), failed=FAILED, where="service_name = 'svc-2' and " + _between(_seconds, "start_time_nano", _days)), "spans")

add(
    "error_logs_tiered", on("logs")(lambda l: logs.error_logs_tiered(_tiers(l, logs.error_log_rollup, "1m 1h"), "", T0 + 2 * DAY, T0 + 9 * DAY, None)),
    f"""select service_name, exception_type, {bucket_sql('timestamp_nano', 3600)} as minute, count(*) as n
    from logs where severity_number >= 17 and {_between(3600, 'timestamp_nano', (2, 9))} group by 1, 2, 3""", "logs",
)

# histograms: bucket counts add up element by element; rows without buckets count too
_hist = """, r as (
  select service_name, metric_name, {bucket} as minute, cast(sum(total_count) as bigint) as total_count, sum(total_sum) as total_sum,

    cast(sum(bucket_counts[1]) as bigint) as b1, cast(sum(bucket_counts[2]) as bigint) as b2, cast(sum(bucket_counts[3]) as bigint) as b3,
    cast(sum(bucket_counts[4]) as bigint) as b4, cast(sum(bucket_counts[5]) as bigint) as b5, cast(sum(bucket_counts[6]) as bigint) as b6
  from histograms where {where} group by 1, 2, 3)"""


def _counted(df: DataFrame) -> DataFrame:
    return df.select("service_name", "metric_name", "minute", "total_count", F.round("total_sum", 4).alias("total_sum"), F.array_join(F.transform("bucket_counts", lambda x: x.cast("string")), ",").alias("counts"))


add("histogram_rollup", on("histograms")(lambda h: _counted(metrics.histogram_rollup(h, "1h"))),
    _hist.format(bucket=bucket_sql("timestamp_nano", 3600), where="true")
    + """ select service_name, metric_name, minute, total_count, round(total_sum, 4) as total_sum, case when b1 is null then '' else concat_ws(',', b1, b2, b3,
    b4, b5, b6) end as counts from r""", "histograms")  # fmt: skip

_percentile = """round(case when t is null or t = 0 then 0.0 when q{p} <= c1 then 0 + 5.0 * q{p} / c1 when q{p} <= c2 then 5 + 5.0 * (q{p} - c1) / (c2 - c1)
    when q{p} <= c3 then 10 + 15.0 * (q{p} - c2) / (c3 - c2) when q{p} <= c4 then 25 + 25.0 * (q{p} - c3) / (c4 - c3)
    when q{p} <= c5 then 50 + 50.0 * (q{p} - c4) / (c5 - c4) else 100.0 end, 4) as p{p}"""
_percentiles = _hist + """,
a as (select *, b1 as c1, b1 + b2 as c2, b1 + b2 + b3 as c3, b1 + b2 + b3 + b4 as c4, b1 + b2 + b3 + b4 + b5 as c5, b1 + b2 + b3 + b4 + b5 + b6 as t from r),
b as (select *, t * 50 / 100e0 as q50, t * 95 / 100e0 as q95, t * 99 / 100e0 as q99 from a)
select service_name, metric_name, minute, total_count, round(total_sum, 4) as total_sum, round(case when total_count = 0 then 0 else total_sum / total_count end, 7) as average, """ + ", ".join(_percentile.format(p=p) for p in (50, 95, 99)) + " from b"  # fmt: skip


def _two_batches(df: DataFrame) -> dict[str, DataFrame]:
    """Rollups as two micro-batches leave them: two partial rows for most buckets."""
    one, two = df.filter("event_id % 2 = 0"), df.filter("event_id % 2 = 1")
    return {t: metrics.histogram_rollup(one, t).unionByName(metrics.histogram_rollup(two, t)) for t in ("1m", "5m", "1h")}


add("histogram_percentiles", on("histograms")(lambda h: metrics.histograms(metrics.histogram_rollup(h, "5m"), limit=None)),
    _percentiles.format(bucket=bucket_sql("timestamp_nano", 300), where="true"), "histograms")
add("histograms_tiered", on("histograms")(lambda h: metrics.histograms_tiered(_two_batches(h), "", "", T0 + 3 * DAY, T0 + 9 * DAY, None)),
    _percentiles.format(bucket=bucket_sql("timestamp_nano", 3600), where=_between(3600, "timestamp_nano", (3, 9))), "histograms")

# scalar and runtime metrics
def _listed(df: DataFrame) -> DataFrame:
    """A page of points with their attributes and buckets as text."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    names = F.concat_ws(",", F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e.key, F.lit("="), e.value))))
    return df.select("event_id", "name", "type", "value", "service_name", "timestamp_nano", "received_at_ms", names.alias("attributes"), "count", text("bucket_counts"), F.size("bounds").alias("bounds"))


_scalars = """select event_id, name, type, value, service_name, timestamp_nano, received_at_ms, case when event_id % 3 = 0 then concat('pool=p', event_id % 4) else '' end as attributes,
  cast(null as bigint) as count, cast(null as varchar) as bucket_counts, cast(null as int) as bounds from metrics"""
_buckets = """select event_id, metric_name, 'HISTOGRAM', total_sum, service_name, timestamp_nano, received_at_ms, concat('jvm.gc.name=', gc_name), total_count,
    array_to_string(bucket_counts, ','), len(bounds) from histograms"""
_wanted = f"where service_name = 'svc-3' and received_at_ms between {T0 + DAY} and {T0 + 9 * DAY} order by received_at_ms desc, event_id limit 20"
add("metrics_union", on("metrics", "histograms")(lambda m, h: _listed(metrics.metrics(m, h, None))), f"{_scalars} union all {_buckets}", "metrics", "histograms")
add("metrics_page", on("metrics", "histograms")(lambda m, h: _listed(metrics.metrics(m, h, 20, 10, T0 + DAY, T0 + 9 * DAY, "svc-3"))),
    f"select * from ({_scalars} {_wanted} offset 10) union all select * from ({_buckets} {_wanted})", "metrics", "histograms")
_minutes = f"""
select service_name, name, {bucket_sql('timestamp_nano', 60)} as minute, round(avg(value), 4) as avg_value, max(value) as max_value,
    min(value) as min_value from metrics
where (name like 'jvm.%' or name like 'process.%' or name like 'system.%' or name in ('runtime.jvm.gc.duration', 'runtime.jvm.memory.used',
    'runtime.jvm.memory.limit', 'runtime.jvm.thread.count')) {{}}
group by 1, 2, 3"""
add("metric_minutes", on("metrics")(lambda m: metrics.metric_minutes(m)), _minutes.format(""), "metrics")
_fields = {
    "heap_used_bytes": "'jvm.memory.heap.used'", "heap_committed_bytes": "'jvm.memory.heap.committed'", "heap_max_bytes": "'jvm.memory.heap.max'",
    "thread_count": "'jvm.thread.count', 'jvm.threads.count', 'process.runtime.jvm.threads.count'", "thread_peak": "'jvm.thread.peak'", "thread_daemon": "'jvm.thread.daemon.count'",
    "process_cpu_utilization": "'jvm.process.cpu.utilization', 'process.runtime.jvm.cpu.utilization', 'jvm.cpu.utilization'", "system_cpu_utilization": "'system.cpu.utilization'",
}
add(
    "jvm_snapshot", on("metrics", "histograms")(lambda m, h: metrics.jvm_snapshot(m, h).withColumn("gc_pause_ms_total_delta", F.round("gc_pause_ms_total_delta", 4))),
    """, v as (select service_name, name, value, null as n, '' as gc_name, timestamp_nano, event_id from metrics
      where name like 'jvm.%' or name in ('process.runtime.jvm.threads.count', 'process.runtime.jvm.cpu.utilization', 'system.cpu.utilization')
      union all select service_name, metric_name, total_sum, total_count, gc_name, timestamp_nano, event_id from histograms where metric_name = 'jvm.gc.duration')
    select service_name, max(timestamp_nano) as timestamp_nano, """
    + ", ".join(f"arg_max(value, (timestamp_nano, event_id)) filter (name in ({n})) as {f}" for f, n in _fields.items())
    + """, cast(arg_max(n, (timestamp_nano, event_id)) filter (name = 'jvm.gc.duration') as double) as gc_count_delta,
    round(arg_max(value, (timestamp_nano, event_id)) filter (name = 'jvm.gc.duration') * 1000, 4) as gc_pause_ms_total_delta,
    arg_max(gc_name, (timestamp_nano, event_id)) filter (gc_name <> '') as gc_collection_name from v group by 1""", "metrics", "histograms",
)
_placed = "spans where pod_name <> '' or host_name <> ''"
add("pod_contexts", on("spans")(lambda s: metrics.pod_contexts(s, limit=None)),
    f"select service_name, pod_name as pod, node_name as node, '' as namespace, host_name as host, count(*) as span_count from {_placed} group by 1, 2, 3, 5", "spans")
_contexts = f"""select service_name, pod_name as pod, node_name as node, '' as namespace, host_name as host, count(*) as span_count,
  cast(row_number() over (partition by service_name order by count(*) desc, pod_name, node_name, host_name) as int) as position from {_placed} and {{}} group by 1, 2, 3, 5"""
add("infra_correlation", on("spans", "metrics")(lambda s, m: metrics.infra_correlation(s.filter("service_name <> 'svc-6' or pod_name = '' and host_name = ''"), m, most=5)),
    ", c as (" + _contexts.format("service_name <> 'svc-6'").replace("or host_name <> '' and", "or host_name <> '') and").replace("where pod_name", "where (pod_name") + "), m as (" + _minutes.format("and service_name in (select service_name from c)")
    + """) select 'context' as what, *, null as name, cast(null as bigint) as minute, cast(null as double) as avg_value, cast(null as double) as max_value,
    cast(null as double) as min_value from c where position <= 5
    union all select 'minute', service_name, null, null, null, null, null, null, name, minute, avg_value, max_value, min_value from m""", "spans", "metrics")  # fmt: skip
_sampled = "sampled_at_ms between {} and {}".format(T0 + 4 * DAY, T0 + 11 * DAY)
add("profiles_list", on("profiles")(lambda p: metrics.profiles(p, "svc-1", "cpu", 100, T0 + 4 * DAY, T0 + 11 * DAY)),
    f"""select id, service_name, profile_type, format, duration_ms, sampled_at_ms from profiles where service_name = 'svc-1' and profile_type = 'cpu'
    and {_sampled} order by sampled_at_ms desc, id limit 100""", "profiles")  # fmt: skip
add("pod_metrics_list", on("pod_metrics")(lambda p: metrics.pod_metrics(p, pod="pod-3", from_ms=T0 + 4 * DAY, to_ms=T0 + 11 * DAY).select("event_id", "service_name", "pod_name", "sampled_at_ms")),
    f"select event_id, service_name, pod_name, sampled_at_ms from pod_metrics where pod_name = 'pod-3' and {_sampled} order by sampled_at_ms desc, event_id limit 200", "pod_metrics")

# whole traces
add("slow_queries", on("spans")(lambda s: traces.slow_queries(s, threshold_ms=20, limit=None)),
    """select trace_id, span_id, service_name, db_system, db_name, db_operation, db_statement, round(duration_nano / 1e6, 2) as duration_ms,
    cast(floor(start_time_nano / 1000000) as bigint) as start_ms, status_code from spans where db_system <> '' and duration_nano / 1e6 >= 20""", "spans")  # fmt: skip
_broken = """select trace_id, count(*) as span_count, coalesce(min(nullif(service_name, '')), '') as service_name, cast(floor(min(start_time_nano) / 1000000) as bigint) as start_ms, {failed} as error_count,
    cast(floor(max(duration_nano) / 1000000) as bigint) as max_duration_ms from {of} group by trace_id having sum(case when parent_span_id = '' then 1 else 0 end) = 0"""
add("broken_traces", on("spans")(lambda s: traces.broken_traces(s, limit=None)), _broken.format(failed=FAILED, of="spans"), "spans")
add("broken_traces_of_service", on("spans")(lambda s: traces.broken_traces(s, "svc-1", limit=None)), _broken.format(failed=FAILED, of="spans where service_name = 'svc-1'"), "spans")
add("broken_traces_whole", on("spans")(lambda s: traces.broken_traces(s, "svc-1", limit=None, whole_trace=True)),
    _broken.format(failed=FAILED, of="spans where trace_id in (select trace_id from spans where service_name = 'svc-1')"), "spans")
add(
    "error_groups", on("spans")(lambda s: traces.error_groups(s, limit=None)),
    """select md5(concat(service_name, '|', exception_type, '|', substr(exception_message, 1, 200))) as fingerprint, service_name, exception_type,
    substr(exception_message, 1, 200) as message, count(*) as total,
      min(cast(floor(start_time_nano / 1000000000) as bigint) * 1000) as first_seen_ms,
    max(cast(floor(start_time_nano / 1000000000) as bigint) * 1000) as last_seen_ms
    from spans where status_code = 2 and exception_type <> '' group by 1, 2, 3, 4""", "spans",
)
add("trace_waterfall", on("spans")(lambda s: traces.trace_waterfall(s)), """,
s as (select trace_id, span_id, parent_span_id, name as span_name, service_name, kind, status_code, exception_type, exception_message,
    http_status_code,
    start_time_nano // 1000000 as start_ms, (end_time_nano - start_time_nano) // 1000000 as duration_ms,
    start_time_nano // 1000000 + (end_time_nano - start_time_nano) // 1000000 as end_ms,
    row_number() over (partition by trace_id order by start_time_nano, span_id) as n from spans),
w as (with recursive r as (select s.*, [n] as path, [(start_ms, span_id)] as spelled from s where not exists (select 1 from s p
    where p.trace_id = s.trace_id and p.span_id = s.parent_span_id)
    union all select s.*, list_append(r.path, s.n), list_append(r.spelled, (s.start_ms, s.span_id)) from s join r on s.trace_id = r.trace_id
    and s.parent_span_id = r.span_id) select * from r),
m as (select trace_id, a as n, max(end_ms) as subtree_end_ms from (select trace_id, end_ms, unnest(path) as a from w) group by 1, 2),
t as (select * from (select trace_id, min(start_ms) as t0, count(*) as span_count, sum(case when status_code = 2 then 1 else 0 end) as error_count,
    count(distinct service_name) as service_count from s group by 1)
    join (select trace_id, max(end_ms) as t1, sum(case when len(path) = 1 then 1 else 0 end) as root_span_count from w group by 1) using (trace_id)),
c as (select w.*, m.subtree_end_ms, t.*, case when len(path) = 1 then 0 else path[len(path) - 1] end as above from w join m using (trace_id, n)
    join t on t.trace_id = w.trace_id),
d as (select *, subtree_end_ms = t1 and row_number() over (partition by trace_id, above order by case when subtree_end_ms = t1 then 1 else 0 end desc,
    start_ms, span_id) = 1 as chosen,
    cast(row_number() over (partition by trace_id order by spelled) as int) as position from c),
g as (select trace_id, list(n) filter (chosen) as ns from d group by 1)
select d.trace_id, span_id, parent_span_id, span_name, service_name, kind, status_code, exception_type, exception_message, http_status_code,
    cast(len(path) - 1 as int) as depth, start_ms,
    start_ms - t0 as offset_ms, duration_ms, subtree_end_ms, coalesce(list_has_all(g.ns, d.path), false) as critical, position, t1 - t0 as total_ms,
    span_count, cast(error_count as bigint) as error_count, service_count, cast(root_span_count as bigint) as root_span_count
from d join g on g.trace_id = d.trace_id""", "spans")  # fmt: skip
add("trace_context", on("spans", "logs")(lambda s, l: correlate.trace_context(s, l)), f""",
s as (select trace_id, span_id, name, service_name, parent_span_id, status_code, exception_type, exception_message, http_status_code,
    start_time_nano // 1000000 as at_ms,
    (end_time_nano - start_time_nano) // 1000000 as duration_ms, cast(row_number() over (partition by trace_id order by start_time_nano,
    span_id) as int) as position from spans),
h as (select trace_id, arg_min(service_name, position) filter (service_name <> '') as service_name, min(at_ms) filter (at_ms <> 0) as from_ms,
    greatest(max(at_ms + duration_ms), 0) as to_ms from s where position <= 500 group by 1),
l as (select s.trace_id, g.trace_id as trace_id_1, g.* exclude (trace_id) from (select distinct trace_id from s) s
    join logs g on g.trace_id = s.trace_id
    union select h.trace_id, g.trace_id, g.* exclude (trace_id) from h join logs g on g.service_name = h.service_name and from_ms > 0
    and timestamp_nano between from_ms * 1000000 and to_ms * 1000000),
l2 as (select l.*, cast(row_number() over (partition by trace_id order by timestamp_nano, event_id) as int) as position from l),
r as (select service_name, {bucket_sql('start_time_nano', 60)} // 1000000000 as at_s, count(*) as n, {FAILED} as errors,
    round(quantile_cont(duration_nano, 0.95) / 1e6, 6) as p95_ms from spans where kind in (2, 5) group by 1, 2),
r2 as (select h.trace_id, r.*, cast(row_number() over (partition by h.trace_id order by at_s) as int) as position from h
    join r on r.service_name = h.service_name and from_ms > 0 and at_s between from_ms // 1000 - 60 and to_ms // 1000 + 60)
select trace_id, 'span' as what, position, span_id as item, name, service_name, parent_span_id, at_ms, duration_ms, status_code, exception_type,
    exception_message, http_status_code, null as log_trace_id, null as log_span_id, null as body,
    cast(null as bigint) as n, cast(null as bigint) as errors, cast(null as double) as p95_ms from s where position <= 500
union all select trace_id, 'log', position, cast(event_id as string), severity_text, service_name, null, timestamp_nano // 1000000, null, null,
    exception_type, null, null, trace_id_1, span_id, body, null, null, null from l2 where position <= 200
union all select trace_id, 'red', position, service_name, null, service_name, null, at_s * 1000, null, null, null, null, null, null, null, null, n,
    errors, p95_ms from r2""", "spans", "logs")  # fmt: skip

# adaptive sampling: the fold over ticks as a recursive query
_tick = 6 * 3_600_000
add("adaptive_limit", on("spans")(lambda s: sampling.adaptive_limit(sampling.sampled_traces(s, sampling.Sampling(sampling.Policy(errors=True, rate=1.0))), 0.0004, 0.05, tick_ms=_tick).select("trace_id", "reason")), f""",
f as (select trace_id, bool_or(status_code = 2) as failed, min(received_at_ms) as first_ms from spans group by 1),
t as (select *, cast(floor(first_ms / {_tick}) as bigint) as tick from f),
p as (select tick, count(*) as n, row_number() over (order by tick) as i from t where not failed group by 1),
q as (select p.*, b.n / ((p.tick - b.tick) * {_tick} / 1000) as seen from p left join p b on b.i = p.i - 1),
r as (with recursive x as (select i, tick, cast(-1 as double) as ewma, cast(0.05 as double) as rate from q where i = 1
    union all select q.i, q.tick, case when x.ewma < 0 then q.seen else 0.3 * q.seen + 0.7 * x.ewma end,
      least(greatest(x.rate * 0.0004 / case when x.ewma < 0 then q.seen else 0.3 * q.seen + 0.7 * x.ewma end, 0.05), 1.0) from x join q on q.i = x.i + 1) select * from x),
k as (select t.*, rate, row_number() over (partition by tick order by first_ms, trace_id) as k from t join r using (tick) where not failed)
select trace_id, 'error' as reason from t where failed union all select trace_id, 'probabilistic' from k where k % greatest(cast(floor(1 / rate + 0.5) as bigint), 1) = 0""", "spans")  # fmt: skip
add("trace_seconds", on("spans")(lambda s: sampling.trace_seconds(s)),
    """select second, count(*) as n, second * 1000000000 as at_nano from (select trace_id, cast(floor(min(received_at_ms) / 1000) as bigint) as second
    from spans group by 1) group by 1""", "spans")  # fmt: skip
