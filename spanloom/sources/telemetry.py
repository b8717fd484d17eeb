"""Telemetry tables derived from the event and order tables, and their schemas.

The expressions are the same for Spark and for the SQL that checks it; only three functions differ,
written US(x) (microseconds of a timestamp), ARR(...) (an array) and NONE(type) (an empty one).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_five, _third = "cast(floor(event_id/5) as bigint)", "cast(floor(event_id/3) as bigint)"
_received = "cast(floor(US(ts)/1000) as bigint) + 250"
_service = "concat('svc-', cast(user_id%8 as string))"
#: Some rows arrive an hour late.
_late = f"{_received} + case when event_id%40 = 7 then 3600000 else 0 end"
_duration = "cast(round(value*100) as bigint)*10000"
_exception = "case when event_type = 'error' and event_id%6 <> 1 then concat('Exc', cast(event_id%4 as string)) else '' end"
_span = "substr(md5(concat('s', cast(event_id as string))), 1, 16)"
_trace = f"md5(cast({_five} as string))"

SPANS = {
    "event_id": "event_id",
    "trace_id": _trace,
    "span_id": _span,
    "parent_span_id": f"case when event_id%5 = 0 then case when {_five}%7 = 0 then 'ffffffffffffffff' else '' end else substr(md5(concat('s', cast(event_id - event_id%5 + cast(floor((event_id%5-1)/2) as bigint) as string))), 1, 16) end",
    "name": "event_type",
    "kind": f"cast({_third}%5 + 1 as int)",
    "start_time_nano": "US(ts)*1000",
    "end_time_nano": f"US(ts)*1000 + {_duration}",
    "duration_nano": _duration,
    "status_code": "case when event_type = 'error' then 2 else 1 end",
    "status_message": "case when event_type = 'error' and event_id%3 <> 0 then concat('failed ', cast(event_id%4 as string)) else '' end",
    "service_name": f"case when {_five}%11 = 3 and event_id%5 < 2 then '' else {_service} end",
    "scope_name": "case when event_id%3 = 0 then 'web' else '' end",
    "received_at_ms": f"{_received} + case when event_id%50 = 0 then 86400000 else 0 end",
    "http_route": "concat('/api/', event_type)",
    "http_status_code": "cast(case when event_type = 'error' then 500 + event_id%4 when event_id%7 = 0 then 0 else 200 end as int)",
    "peer_service": f"case when {_third}%5 + 1 = 3 and event_id%4 <> 0 then concat('svc-', cast((user_id+1)%8 as string)) else '' end",
    "db_system": f"case when {_third}%5 + 1 = 3 and event_id%2 = 0 then 'mysql' else '' end",
    "db_name": f"case when {_third}%5 + 1 = 3 and event_id%4 = 0 then 'shop' else '' end",
    "db_operation": f"case when {_third}%5 + 1 = 3 and event_id%2 = 0 then 'SELECT' else '' end",
    "db_statement": f"case when {_third}%5 + 1 = 3 and event_id%2 = 0 then concat('select ', event_type) else '' end",
    "exception_type": _exception,
    "exception_message": "case when event_type = 'error' and event_id%9 <> 2 then concat('user group ', cast(user_id%3 as string)) else '' end",
    "exception_stacktrace": "case when event_type = 'error' and event_id%5 = 3 then concat('at line ', cast(event_id%50 as string)) else '' end",
    "pod_name": "case when event_id%4 <> 3 then concat('pod-', cast(user_id%5 as string)) else '' end",
    "node_name": "case when event_id%4 <> 1 then concat('node-', cast(user_id%3 as string)) else '' end",
    "host_name": "case when event_id%8 = 7 then concat('host-', cast(user_id%3 as string)) else '' end",
}
LOGS = {
    "event_id": "event_id",
    "timestamp_nano": f"US(ts)*1000 + case when event_id%4 = 0 then {_duration} + 300000 else 0 end",
    "severity_number": "case event_type when 'error' then 17 when 'signup' then 13 when 'view' then 5 else 9 end",
    "severity_text": "case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' when 'view' then 'DEBUG' else 'INFO' end",
    "body": "case when event_id%9 = 4 then 'Heartbeat 2024 of the group' else concat('Request ', cast(event_id+10000 as string), ' of user ', cast(user_id as string), ' ended in ', event_type) end",
    "service_name": _service,
    "trace_id": f"case when event_id%4 = 0 then '' else {_trace} end",
    "span_id": f"case when event_id%4 = 0 then '' else {_span} end",
    "exception_type": _exception,
    "logger_name": "case when event_id%9 = 0 then '' else concat('com.acme.', event_type) end",
    "received_at_ms": _late,
}
_names = (
    "jvm.memory.heap.used", "jvm.memory.heap.committed", "jvm.memory.heap.max", "jvm.thread.count", "jvm.threads.count", "process.runtime.jvm.threads.count", "jvm.thread.peak", "jvm.thread.daemon.count",
    "jvm.process.cpu.utilization", "jvm.cpu.utilization", "system.cpu.utilization", "process.cpu.time", "runtime.jvm.memory.used", "runtime.jvm.classes", "http.requests", "db.client.connections.usage",
)
METRICS = {
    "event_id": "event_id",
    "name": f"case event_id%{len(_names)} " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(_names)) + " end",
    "type": "case when event_id%4 = 3 then 'SUM' else 'GAUGE' end",
    "unit": "case when event_id%4 = 3 then 'By' else '' end",
    "value": "value",
    "service_name": _service,
    "timestamp_nano": "US(ts)*1000",
    "received_at_ms": _late,
}
_edges = (5, 10, 25, 50, 100)
_counts = [f"case when {f'value > {a} and ' if a else ''}{f'value <= {b}' if b else 'true'} then 1 else 0 end{more}" for a, b, more in zip((0, *_edges), (*_edges, 0), ("", " + event_id%2", "", " + event_id%3", "", ""))]
#: Points without buckets: all of one metric, and some of the others.
_bare = "event_id%7 = 1 or event_id%5 = 4"
HISTOGRAMS = {
    "event_id": "event_id",
    "service_name": _service,
    "metric_name": "case event_id%7 when 0 then 'jvm.gc.duration' when 1 then 'queue.time' else 'http.server.duration' end",
    "gc_name": "case when event_id%7 = 0 and event_id%3 <> 0 then concat('G', cast(event_id%2 as string)) else '' end",
    "timestamp_nano": "US(ts)*1000",
    "bounds": f"case when {_bare} then NONE(double) else ARR(5.0e0, 10.0e0, 25.0e0, 50.0e0, 100.0e0) end",
    "bucket_counts": f"case when {_bare} then NONE(bigint) else ARR(" + ", ".join(f"cast({c} as bigint)" for c in _counts) + ") end",
    "total_count": "cast(1 + event_id%2 + event_id%3 as bigint)",
    "total_sum": "value",
    "received_at_ms": _late,
}
DEPLOYMENTS = {
    "id": "concat('d', cast(o_orderkey as string))",
    "service_name": "concat('svc-', cast(o_custkey%8 as string))",
    "version": "case when o_orderkey%100 = 7 then '' else concat('v', cast(o_orderkey%100 as string)) end",
    "environment": "case when o_orderkey%3 = 0 then '' when o_orderkey%3 = 1 then 'staging' else 'production' end",
    "deployed_by": "case when o_orderkey%4 = 0 then '' else concat('user-', cast(o_custkey%9 as string)) end",
    "deployed_at_ms": "1704067200000 + (o_orderkey*7919%2592000)*1000",
}
POD_METRICS = {
    "event_id": "event_id",
    "service_name": _service,
    "pod_name": "concat('pod-', cast(user_id%5 as string))",
    "node_name": "concat('node-', cast(user_id%3 as string))",
    "namespace": "'shop'",
    "cpu_usage_millicore": "value",
    "cpu_limit_millicore": "cast(500 + 100*(user_id%5) as double)",
    "memory_usage_bytes": "event_id*1024",
    "memory_limit_bytes": "cast(1073741824 as bigint)",
    "sampled_at_ms": _received,
}
PROFILES = {
    "id": "concat('p', cast(event_id as string))",
    "service_name": _service,
    "profile_type": "case event_id%4 when 0 then 'cpu' when 1 then 'heap' when 2 then 'wall' else 'alloc' end",
    "format": "'collapsed'",
    "payload": "concat('main;', event_type, ' ', cast(event_id as string))",
    "duration_ms": "cast(floor(value*10) as bigint)",
    "sampled_at_ms": _received,
}
ANOMALIES = {
    "id": "concat('a', cast(event_id as string))",
    "service_name": _service,
    "span_name": "event_type",
    "anomaly_type": "case event_id%3 when 0 then 'latency_p95_spike' when 1 then 'error_rate_spike' else 'traffic_drop' end",
    "minute_nano": "cast(floor(US(ts)/60000000) as bigint)*60000000000",
    "current_value": "value",
    "z_score": "value/10",
    "severity": "case when value >= 30 then 'critical' else 'warning' end",
    "detected_at_ms": _received,
}
#: View, base table, filter.
VIEWS = {
    "spans": (SPANS, "events", ""), "logs": (LOGS, "events", ""), "metrics": (METRICS, "events", ""), "histograms": (HISTOGRAMS, "events", ""), "deployments": (DEPLOYMENTS, "orders", ""),
    "pod_metrics": (POD_METRICS, "events", ""), "profiles": (PROFILES, "events", ""), "anomalies": (ANOMALIES, "events", "event_type = 'error'"),
}
#: Days that rows of a table are kept.
RETENTION_DAYS = {
    "spans": 30, "metrics": 30, "metric_histograms": 30, "logs": 30, "red_1m": 90, "red_5m": 180, "red_1h": 365, "topology": 30, "histogram_1m": 90, "histogram_5m": 180, "histogram_1h": 365, "error_logs_1m": 30, "error_logs_1h": 365,
    "log_volume_1m": 30, "error_groups": 90, "slow_queries": 7, "error_documents": 30, "red_baseline": 90, "anomalies": 90, "rca_reports": 90, "slo_burn_alerts": 90, "alert_events": 30, "deployment_events": 365, "profiles": 30, "pod_metrics": 7,
}


def _macro(text: str, us: str, arr: str) -> str:
    text = re.sub(r"US\((\w+)\)", lambda m: us.format(m[1]), text)
    text = re.sub(r"NONE\((\w+)\)", r"cast(array() as array<\1>)" if arr == "array(" else r"cast([] as \1[])", text)
    return text.replace("ARR(", arr)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A telemetry table over the tables in ``sf_dir``."""
    columns, base, where = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    df = df.filter(where) if where else df
    out = df.selectExpr(*[f"{_macro(e, 'unix_micros(cast({} as timestamp))', 'array(')} as {c}" for c, e in columns.items()])
    if name == "spans":
        bag = {"k8s.pod.name": "pod_name", "k8s.node.name": "node_name", "host.name": "host_name", "db.statement": "db_statement"}
        out = out.withColumn("attributes", F.map_filter(F.create_map(*[F.lit(k) if i == 0 else F.col(c) for k, c in bag.items() for i in (0, 1)]), lambda _, v: v != ""))
        out = out.withColumn("dt", F.to_date(F.timestamp_millis("received_at_ms")))
    if name == "metrics":
        out = out.withColumn("attributes", F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("pool"), F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")))).otherwise(F.create_map().cast("map<string,string>")))
    if name == "histograms":
        out = out.withColumn("attributes", F.create_map(F.lit("jvm.gc.name"), "gc_name"))
    return out


def view_sql(name: str) -> str:
    """The same table as SQL for the checking engine (without the attribute map)."""
    columns, base, where = VIEWS[name]
    body = ", ".join(f"{_macro(e, 'epoch_us({})', 'list_value(')} as {c}" for c, e in columns.items())
    return f"select {body} from {base}" + (f" where {where}" if where else "")
