"""Queries of objectives, alert routing, lists of alerts and versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.core import latest
from spanloom.operators import alerts, correlate
from spanloom.plans.base import DAY, LATEST, NOW, T0, add, bucket_sql, on

_slo, _route = LATEST
# requests by service and minute; windows of one and six hours
_minutes = f"""m as (select service_name, {bucket_sql('start_time_nano', 60)} as minute, count(*) as n, sum(case when status_code = 2 then 1 else 0 end) as e, quantile_cont(duration_nano, 0.95) as p
  from spans where kind in (2, 5) group by 1, 2)"""
_burn = f""", {_slo}, {_minutes},
w as (select 1 as hours, 14.4e0 as above, 'page' as severity union all select 6, 6e0, 'ticket'),
g as (select s.service_name, slo_name, target_pct, metric_type, threshold_ms, hours, above, severity, sum(e) as e, sum(n) as n,
    avg(case when p / 1e6 > threshold_ms then 1e0 when p is not null then 0e0 end) as late
  from slo s cross join w left join m on m.service_name = s.service_name and minute between ({NOW} - hours * 3600000) * 1000000 and {NOW} * 1000000
  where target_pct < 100 and metric_type in ('error_rate', 'latency_p95') group by 1, 2, 3, 4, 5, 6, 7, 8),
b as (select *, coalesce(case when metric_type = 'error_rate' then e / n when threshold_ms > 0 then late end, 0) as bad from g)
"""
add("slo_burn", on("spans", "slos")(lambda s, d: alerts.burn_rates(s, d, NOW)),
    _burn + """select service_name, slo_name, hours, severity, round(bad, 6) as bad_rate, round(bad / (1 - target_pct / 100), 4) as burn_rate,
    bad / (1 - target_pct / 100) > above as alert from b""", "spans", "slos")  # fmt: skip
add("burn_alerts", on("spans", "slos")(lambda s, d: alerts.burn_alerts(alerts.burn_rates(s, d, NOW), NOW)),
    _burn + f"""select service_name, slo_name, round(bad / (1 - target_pct / 100), 4) as burn_rate, concat(hours, 'h') as window, severity, {NOW} as alerted_at_ms from b
    where bad / (1 - target_pct / 100) > above order by service_name, slo_name, hours limit 100""", "spans", "slos")  # fmt: skip
_span_of_time = (NOW - DAY // 4, NOW)
add(
    "burn_by_minute", on("spans", "slos")(lambda s, d: alerts.burn_by_minute(s, d, *_span_of_time)),
    f""", {_slo}, {_minutes},
    t as (select unnest(range({_span_of_time[0]}, {_span_of_time[1]} + 1, 60000)) as at_ms), w as (select 1 as hours, 14.4e0 as above,
    'page' as severity union all select 6, 6e0, 'ticket'),
    g as (select s.service_name, slo_name, target_pct, metric_type, threshold_ms, hours, above, severity, at_ms, sum(e) as e, sum(n) as n,
    avg(case when p / 1e6 > threshold_ms then 1e0 when p is not null then 0e0 end) as late
      from slo s cross join w cross join t left join m on m.service_name = s.service_name and minute // 1000000 between at_ms - hours * 3600000
    and at_ms
      where target_pct < 100 and metric_type in ('error_rate', 'latency_p95') group by all),
    b as (select *, coalesce(case when metric_type = 'error_rate' then e / n when threshold_ms > 0 then late end, 0) as bad from g)
    select service_name, slo_name, at_ms, hours, severity, round(bad, 6) as bad_rate, round(bad / (1 - target_pct / 100), 4) as burn_rate,
    bad / (1 - target_pct / 100) > above as alert from b""", "spans", "slos",
)
_six = f"minute between {(NOW - 6 * 3_600_000) * 10**6} and {NOW * 10**6}"
add("slo_error_rate", on("spans")(lambda s: alerts.slo_error_rate(alerts.service_minutes(s, NOW - 6 * 3_600_000, NOW))), f", {_minutes} select service_name, sum(e) / sum(n) as bad_rate from m where {_six} group by 1", "spans")
add("slo_latency", on("spans", "slos")(lambda s, d: alerts.slo_latency(alerts.service_minutes(s, NOW - 6 * 3_600_000, NOW), d)),
    f""", {_minutes}, d as (select distinct service_name, threshold_ms from slos)
    select d.service_name, threshold_ms, case when threshold_ms > 0 then coalesce(avg(case when p / 1e6 > threshold_ms then 1e0 when p is not null then 0e0 end), 0) else 0 end as bad_rate
    from d left join m on m.service_name = d.service_name and {_six} group by 1, 2""", "spans", "slos")  # fmt: skip

_escalates = "escalation_after_min > 0 and (escalate_slack_url <> '' or escalate_webhook_url <> '')"
add(
    "route_alerts", on("anomalies", "routes")(lambda a, r: alerts.route_alerts(a, r)),
    f""", {_route} select a.id as event_id, r.id as route_id, service_name, priority, cast(row_number() over (partition by a.id order by priority, created_at, r.id) as int) as position,
      slack_url <> '' as to_slack, webhook_url <> '' as to_webhook, {_escalates} as escalates
    from anomalies a join route r on enabled and (match_service = '' or regexp_matches(service_name, concat('^', replace(match_service, '*', '[^/]*'), '$')))
      and (match_severity = '' or match_severity = severity) and (match_anomaly_type = '' or match_anomaly_type = anomaly_type)""", "anomalies", "routes",
)


def fired(anomalies: DataFrame) -> DataFrame:
    """An alert event for each anomaly."""
    route = F.concat(F.lit("r"), F.pmod(F.floor(F.col("current_value")), F.lit(25)).cast("string"))
    return anomalies.select(F.col("id").alias("event_id"), "service_name", route.alias("route_id"), F.col("detected_at_ms").alias("fired_at_ms"), (F.col("severity") == "critical").alias("escalated"))


def _acknowledged(anomalies: DataFrame, where: str) -> DataFrame:
    return anomalies.filter(where).select(F.col("id").alias("event_id"))


add(
    "escalations_due", on("anomalies", "routes")(lambda a, r: alerts.escalations_due(fired(a), r, _acknowledged(a, "anomaly_type = 'traffic_drop'"), NOW)),
    f""", {_route} select a.id as event_id, r.id as route_id, detected_at_ms as fired_at_ms from anomalies a join route r on r.id = concat('r', cast(cast(floor(current_value) as bigint) % 25 as string))
    where severity <> 'critical' and {_escalates} and detected_at_ms + escalation_after_min * 60000 <= {NOW} and anomaly_type <> 'traffic_drop'""", "anomalies", "routes",
)
add("unacknowledged", on("anomalies")(lambda a: alerts.unacknowledged(fired(a), _acknowledged(a, "severity = 'critical'")).select("event_id")), "select id as event_id from anomalies where severity <> 'critical'", "anomalies")

# lists, newest first
add("anomalies_list", on("anomalies")(lambda a: alerts.newest(a, "detected_at_ms", "id", 100, T0 + DAY, T0 + 15 * DAY, severity="critical").select("id", "service_name", "detected_at_ms")),
    f"""select id, service_name, detected_at_ms from anomalies where detected_at_ms between {T0 + DAY} and {T0 + 15 * DAY}
    and severity = 'critical' order by detected_at_ms desc, id limit 100""", "anomalies")  # fmt: skip
add("alert_history", on("anomalies")(lambda a: alerts.newest(fired(a), "fired_at_ms", "event_id", 100, service_name="svc-3").select("event_id", "service_name", "fired_at_ms")),
    "select id as event_id, service_name, detected_at_ms as fired_at_ms from anomalies where service_name = 'svc-3' order by detected_at_ms desc, id limit 100", "anomalies")
add("rca_reports", on("anomalies", "spans", "deployments")(lambda a, s, d: alerts.newest(correlate.rca_rows(a, s, d).withColumnRenamed("detected_at_ms", "created_at_ms"), "created_at_ms", "id", 50, T0 + 2 * DAY, T0 + 12 * DAY, service_name="svc-5", severity="warning").select("id", "anomaly_type", "created_at_ms")),
    f"""select id, anomaly_type, detected_at_ms as created_at_ms from anomalies where service_name = 'svc-5' and severity = 'warning'
    and detected_at_ms between {T0 + 2 * DAY} and {T0 + 12 * DAY} order by detected_at_ms desc, id limit 50""", "anomalies")  # fmt: skip
add("soft_delete", on("routes")(lambda r: latest(alerts.soft_delete(r, "id", "r3", "created_at", F.lit(10**6).cast("bigint")), ["id"], F.col("created_at")).select("id", "enabled")), f", {_route} select id, enabled and id <> 'r3' as enabled from route", "routes")
