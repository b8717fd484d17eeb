"""Queries of published events, stored rows, error documents and user SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import logs, traces
from spanloom.plans.base import NOW, add, on
from spanloom.sources import sinks
from spanloom.sources.sql import sql
from spanloom.sources.telemetry import view


def read_back(df: DataFrame, **fields: str) -> DataFrame:
    """Keys, the names of all fields that a value has, and fields of these types."""
    names = F.array_join(F.json_object_keys("value"), ",").alias("names")
    return df.select("key", names, *[F.get_json_object("value", f"$.{c}").cast(t).alias(c) for c, t in fields.items()])


def optional(*names: str) -> str:
    """SQL of the names of fields, of which those in the form name=test appear only if the test holds."""
    parts = [f"case when {n.partition('=')[2]} then '{n.partition('=')[0]}' end" if "=" in n else f"'{n}'" for n in names]
    return f"concat_ws(',', {', '.join(parts)}) as names"


_bag = "pod_name <> '' or node_name <> '' or host_name <> '' or db_statement <> ''"
add(
    "span_events",
    on("spans")(lambda s: read_back(sinks.span_events(s), trace_id="string", span_id="string", parent_span_id="string", name="string", kind="int", start_time_nano="long", end_time_nano="long", status_code="int", status_message="string", service_name="string", scope_name="string")),
    "select service_name as key, " + optional("trace_id", "span_id", "parent_span_id=parent_span_id <> ''", "name", "kind", "start_time_nano", "end_time_nano", f"attributes={_bag}", "status_code", "status_message=status_message <> ''", "service_name", "scope_name=scope_name <> ''")
    + """, trace_id, span_id, nullif(parent_span_id, '') as parent_span_id, name, kind, start_time_nano, end_time_nano, status_code, nullif(status_message,
    '') as status_message, service_name, nullif(scope_name, '') as scope_name from spans""", "spans",
)
add("span_event_attributes", on("spans")(lambda s: sinks.span_events(s).select(F.get_json_object("value", "$.span_id").alias("span_id"), F.from_json(F.get_json_object("value", "$.attributes"), "map<string,string>").alias("a")).select("span_id", F.col("a")["k8s.pod.name"].alias("pod"), F.col("a")["db.statement"].alias("statement"))),
    "select span_id, nullif(pod_name, '') as pod, nullif(db_statement, '') as statement from spans", "spans")


def _points(m: DataFrame, h: DataFrame) -> DataFrame:
    """Scalar points and histogram points, some of these without a count."""
    none = F.create_map().cast("map<string,string>")
    a = m.select("service_name", "name", "type", "unit", "value", F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("sum"), "timestamp_nano", none.alias("attributes"))
    count = F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("total_count"))
    b = h.select("service_name", F.col("metric_name").alias("name"), F.lit("HISTOGRAM").alias("type"), F.lit("s").alias("unit"), F.lit(-1.0).alias("value"), count.alias("count"), F.col("total_sum").alias("sum"), "timestamp_nano", "attributes")
    return a.unionByName(b)


add(
    "metric_events", on("metrics", "histograms")(lambda m, h: read_back(sinks.metric_events(_points(m, h)), service_name="string", metric_name="string", metric_type="string", unit="string", value="double", timestamp_ms="long").withColumn("value", F.round("value", 4))),
    "select concat(service_name, '.', name) as key, " + optional("service_name", "metric_name", "metric_type", "unit=unit <> ''", "value", "timestamp_ms")
    + """, service_name, name as metric_name, type as metric_type, nullif(unit, '') as unit, round(value, 4) as value, cast(floor(timestamp_nano / 1000000) as bigint) as timestamp_ms from metrics
    union all select concat(service_name, '.', metric_name), 'service_name,metric_name,metric_type,unit,value,timestamp_ms,attributes', service_name, metric_name, 'HISTOGRAM', 's',
      round(case when event_id % 5 = 0 then total_sum else total_sum / total_count end, 4), cast(floor(timestamp_nano / 1000000) as bigint) from histograms""", "metrics", "histograms",
)
add(
    "log_events", on("logs")(lambda l: read_back(sinks.log_events(l.withColumn("attributes", F.create_map(F.lit("logger.name"), "logger_name"))), service_name="string", severity="string", body="string", timestamp_ms="long", trace_id="string", span_id="string")),
    "select service_name as key, " + optional("service_name", "severity", "body", "timestamp_ms", "trace_id=trace_id <> ''", "span_id=span_id <> ''", "attributes")
    + """, service_name, severity_text as severity, body, cast(floor(timestamp_nano / 1000000) as bigint) as timestamp_ms, nullif(trace_id, '') as trace_id,
    nullif(span_id, '') as span_id from logs""", "logs",
)


def _late(d: DataFrame) -> DataFrame:
    """Deployments of which some have no time."""
    return d.withColumn("deployed_at_ms", F.when(F.length("id") % 2 == 0, F.lit(0)).otherwise(F.col("deployed_at_ms")))


_environment, _at = "coalesce(nullif(environment, ''), 'production')", f"case when length(id) % 2 = 0 then {NOW} else deployed_at_ms end"
add("deploy_rows", on("deployments")(lambda d: sinks.deploy_rows(_late(d), NOW)),
    f"select id, service_name, version, {_environment} as environment, deployed_by, {_at} as deployed_at_ms from deployments where version <> ''", "deployments")
add("deploy_events", on("deployments")(lambda d: read_back(sinks.deploy_events(_late(d), NOW), service_name="string", version="string", environment="string", deployed_by="string", timestamp_ms="long")),
    "select service_name as key, " + optional("service_name", "version", "environment", "deployed_by=deployed_by <> ''", "timestamp_ms")
    + f", service_name, version, {_environment} as environment, nullif(deployed_by, '') as deployed_by, {_at} as timestamp_ms from deployments where version <> ''", "deployments")

# rows as stored: a scalar row for each point of any type
_typed = "array<struct<attributes:map<string,string>,timestamp_nano:bigint,value:double,count:bigint,sum:double>>"
_received = lambda df: df.select("name", "type", "service_name", "received_at_ms", F.array(F.struct("attributes", "timestamp_nano", "value", "count", "sum")).cast(_typed).alias("data_points"))


def _metric_rows(m: DataFrame, h: DataFrame) -> DataFrame:
    points = _points(m, h).withColumn("received_at_ms", F.floor(F.col("timestamp_nano") / 1_000_000))
    return sinks.metric_rows(_received(points)).select("name", "type", F.round("value", 4).alias("value"), "service_name", "timestamp_nano")


add("metric_rows", on("metrics", "histograms")(_metric_rows),
    """select name, type, round(value, 4) as value, service_name, timestamp_nano from metrics union all select metric_name, 'HISTOGRAM', round(total_sum, 4),
    service_name, timestamp_nano from histograms""", "metrics", "histograms")  # fmt: skip

add(
    "error_documents", on("spans", "logs")(lambda s, l: traces.error_documents_from_spans(s).unionByName(logs.error_documents_from_logs(l))),
    """select sha256(concat('span_error|', trace_id, '|', span_id)) as id, 'span_error' as source_type, span_id as source_id, service_name, trace_id,
    span_id, cast(floor(start_time_nano / 1000000) as bigint) as occurred_ms,
      concat('[', service_name, '] ', name, chr(10), 'ERROR: ', status_message, chr(10), case when exception_type <> '' then concat('Exception: ',
    exception_type, chr(10)) else '' end,
        case when exception_message <> '' then concat('Message: ', exception_message, chr(10)) else '' end, substr(exception_stacktrace, 1,
    2000)) as document
    from spans where status_code = 2 and status_message <> ''
    union all select sha256(concat('log_error|', service_name, '|', cast(timestamp_nano as string), '|', span_id, '|', body)), 'log_error',
    cast(timestamp_nano as string), service_name, trace_id, span_id, cast(floor(timestamp_nano / 1000000) as bigint),
      concat('[', service_name, '] ', case when exception_type <> '' then concat('[', exception_type, '] ') else '' end, body) from logs
    where severity_number >= 17""", "spans", "logs",
)
add("user_sql", lambda spark, sf: sql(spark, "select service_name, count(*) as n, max(received_at_ms) as updated_at from {spans} group by service_name", spans=view(spark, sf, "spans")),
    "select service_name, count(*) as n, max(received_at_ms) as updated_at from spans group by service_name", "spans")
