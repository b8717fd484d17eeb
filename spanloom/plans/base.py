"""How queries are registered: by name, over the telemetry tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators import sampling
from spanloom.sources.telemetry import view, view_sql

Query = Callable[[SparkSession, str], DataFrame]
#: First millisecond of the data, and the time that jobs take as now.
T0 = 1704067200000
DAY = 86_400_000
NOW = T0 + 20 * DAY
SAMPLING = sampling.Sampling(sampling.Policy(errors=True, latency_ms=150, rate=0.25), (("svc-[01]", sampling.Policy(rate=0.5)), ("svc-7", sampling.Policy())))
GLOBS = ["clic?", "v*w", "/api/*"]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None, *needs: str) -> None:
    """needs: the telemetry tables that the SQL reads."""
    QUERIES[name] = query
    if oracle:
        parts = [f"{n} as ({TABLES[n] if n in TABLES else view_sql(n)})" for n in needs]
        ORACLES[name] = ((f"with {', '.join(parts)} " if parts else "") + oracle.strip()).replace(") ,", "),")


def on(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query that applies f to telemetry tables."""
    return lambda f: lambda spark, sf: f(*[table(spark, sf, n) for n in names])


#: Tables of objectives and routes, derived from the business tables; some rows are newer versions of others.
TABLES = {
    "slos": """select concat('svc-', cast(s_suppkey%8 as string)) as service_name, concat('slo-', cast(s_suppkey%80 as string)) as slo_name,
        case s_suppkey%4 when 0 then 99.9e0 when 1 then 99e0 when 2 then 95e0 else 100e0 end as target_pct,
        case s_suppkey%5 when 0 then 'latency_p95' when 1 then 'latency_p95' when 2 then 'availability' else 'error_rate' end as metric_type,
        case when s_suppkey%10 = 1 then 0e0 else cast(20 + s_suppkey%50 as double) end as threshold_ms, s_suppkey as updated_at from supplier""",
    "routes": """select concat('r', cast(n_nationkey%20 as string)) as id,
        case n_nationkey%4 when 0 then 'svc-*' when 1 then 'svc-[0-3]' when 2 then '' else concat('svc-', cast(n_nationkey%8 as string)) end as match_service,
        case n_nationkey%3 when 0 then 'critical' when 1 then '' else 'warning' end as match_severity,
        case when n_nationkey%5 = 0 then 'traffic_drop' else '' end as match_anomaly_type,
        case when n_nationkey%2 = 0 then 'x' else '' end as slack_url, '' as webhook_url,
        case when n_nationkey%4 = 0 then 'y' else '' end as escalate_slack_url, case when n_nationkey%4 = 1 then 'z' else '' end as escalate_webhook_url,
        cast(n_regionkey as int) as priority, cast(n_nationkey%6*5 as int) as escalation_after_min, n_nationkey%7 <> 0 as enabled,
        cast(n_nationkey as bigint) as created_at from nation""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in TABLES:
        text = TABLES[name]
        base = text.rpartition(" from ")[2]
        return spark.read.parquet(f"{sf}/{base}.parquet").selectExpr(*_columns(text[len("select ") : text.rindex(" from ")]))
    return view(spark, sf, name)


def _columns(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def bucket_sql(column: str, seconds: int) -> str:
    w = seconds * 1_000_000_000
    return f"({column} - {column} % {w})"


#: SQL of a span's failure as 0 or 1, and of the latest versions of objectives and routes.
FAILED = "cast(sum(case when status_code = 2 then 1 else 0 end) as bigint)"
LATEST = """slo as (select * from slos qualify row_number() over (partition by service_name, slo_name order by updated_at desc) = 1)""", """route as (select * from routes qualify row_number() over (partition by id order by created_at desc) = 1)"""
