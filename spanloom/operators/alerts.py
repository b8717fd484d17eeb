"""Service objectives, alert routing, and tables of versioned rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.core import at_between, bucket, equals, glob_regex, latest, page

#: Hours looked back, rate above which it alerts, severity (fixed values).
BURN_WINDOWS = ((1, 14.4, "page"), (6, 6.0, "ticket"))
#: What blank columns of a new version become, by table.
DEFAULTS = {"slos": {"metric_type": "error_rate", "window_hours": 720}, "services": {"tier": "standard"}, "routes": {"enabled": True, "priority": 0}}


def service_minutes(spans: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """``service_name, minute, n, errors, p95``: requests of each service in the minutes from one time to another, p95 in ns."""
    m = spans.filter(F.col("kind").isin(2, 5)).select("service_name", bucket("start_time_nano", 60).alias("minute"), "status_code", "duration_nano")
    m = m.filter(F.col("minute").between(from_ms * 1_000_000, to_ms * 1_000_000))
    return m.groupBy("service_name", "minute").agg(F.count("*").alias("n"), F.sum((F.col("status_code") == 2).cast("long")).alias("errors"), F.percentile("duration_nano", F.lit(0.95)).alias("p95"))


def slo_error_rate(minutes: DataFrame) -> DataFrame:
    """Failed share of each service's requests in service_minutes(); 0 without requests."""
    rate = F.coalesce(F.try_divide(F.sum("errors"), F.sum("n")), F.lit(0.0))
    return minutes.groupBy("service_name").agg(rate.alias("bad_rate"))


def slo_latency(minutes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each row (service_name, threshold_ms) the share of the service's minutes whose p95 is above it; 0 without
    minutes, and where the threshold isn't positive."""
    some = thresholds.select("service_name", "threshold_ms").distinct()
    both = some.join(minutes, "service_name", "left")
    late = F.avg((F.col("p95") / 1e6 > F.col("threshold_ms")).cast("double"))
    return both.groupBy("service_name", "threshold_ms").agg(F.when(F.col("threshold_ms") > 0, F.coalesce(late, F.lit(0.0))).otherwise(0.0).alias("bad_rate"))


def known_objectives(definitions: DataFrame) -> DataFrame:
    """The latest version of each objective (service_name, slo_name, target_pct, metric_type, threshold_ms, updated_at) with an error
    budget and of a known kind: failed requests (error_rate), or minutes whose p95 exceeds the threshold (latency_p95)."""
    return latest(definitions, ["service_name", "slo_name"], F.col("updated_at")).filter("target_pct < 100 and metric_type in ('error_rate', 'latency_p95')")


def _bad_share(n: Column, errors: Column, minutes: Column, late: Column) -> Column:
    """An objective's bad share from its service's sums; 0 without requests, and for latency where the threshold isn't positive."""
    by_errors, by_minutes = F.try_divide(errors, n), F.when(F.col("threshold_ms") > 0, F.try_divide(late, minutes))
    return F.coalesce(F.when(F.col("metric_type") == "error_rate", by_errors).otherwise(by_minutes), F.lit(0.0))


def _late() -> Column:
    return (F.col("p95") / 1e6 > F.col("threshold_ms")).cast("long")


def burn_rates(spans: DataFrame, definitions: DataFrame, now_ms: int) -> DataFrame:
    """Burn rate of every known objective for each window up to ``now_ms``: bad share over the error budget.

    The minutes of the longest window are made once; the shorter one is a condition on them.
    """
    d = known_objectives(definitions)
    m = service_minutes(spans, now_ms - max(h for h, _, _ in BURN_WINDOWS) * 3_600_000, now_ms)
    both = d.select("service_name", "threshold_ms").distinct().join(m, "service_name")
    sums = []
    for hours, above, severity in BURN_WINDOWS:
        of = lambda c, h=hours: F.sum(F.when(F.col("minute") >= (now_ms - h * 3_600_000) * 1_000_000, c))
        values = {"n": of(F.col("n")), "errors": of(F.col("errors")), "minutes": of(F.lit(1)), "late": of(_late())}
        sums.append(F.struct(F.lit(hours).alias("hours"), F.lit(above).alias("above"), F.lit(severity).alias("severity"), *[v.alias(c) for c, v in values.items()]))
    windows = both.groupBy("service_name", "threshold_ms").agg(F.array(*sums).alias("w"))
    none = "cast(null as bigint)"
    empty = F.array(*[F.expr(f"named_struct('hours', {h}, 'above', double({a}), 'severity', '{s}', 'n', {none}, 'errors', {none}, 'minutes', {none}, 'late', {none})") for h, a, s in BURN_WINDOWS])
    out = d.join(windows, ["service_name", "threshold_ms"], "left").withColumn("w", F.explode(F.coalesce("w", empty))).select(*d.columns, "w.*")
    return _burning(out, "service_name", "slo_name", "hours", "severity")


def _burning(df: DataFrame, *keys: str) -> DataFrame:
    bad = _bad_share(*map(F.col, ("n", "errors", "minutes", "late")))
    df = df.withColumn("bad_rate", bad).withColumn("burn_rate", F.col("bad_rate") / (1 - F.col("target_pct") / 100))
    return df.select(*keys, F.round("bad_rate", 6).alias("bad_rate"), F.round("burn_rate", 4).alias("burn_rate"), (F.col("burn_rate") > F.col("above")).alias("alert"))


def burn_by_minute(spans: DataFrame, definitions: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """burn_rates() at every whole minute from one time to another, as ``at_ms``.

    Spans are read once, into panes of a minute; minutes without requests are filled in, and a window's sums are the difference
    of two running sums, so a row counts once however long the windows are.  A group is the minutes of one service and
    threshold in the range, whatever its traffic.
    """
    minute = 60_000
    first, last = -(-from_ms // minute) * minute, to_ms // minute * minute
    longest = max(h for h, _, _ in BURN_WINDOWS) * 60
    d = known_objectives(definitions)
    m = service_minutes(spans, first - longest * minute, last).withColumn("at_ms", F.expr("minute div 1000000")).drop("minute")
    some = d.select("service_name", "threshold_ms").distinct()
    grid = some.withColumn("at_ms", F.explode(F.sequence(F.lit(first - longest * minute), F.lit(last), F.lit(minute))))
    panes = grid.join(m, ["service_name", "at_ms"], "left").withColumns({"minutes": F.col("n").isNotNull().cast("long"), "late": _late()})
    by_time = Window.partitionBy("service_name", "threshold_ms").orderBy("at_ms")
    sums = ("n", "errors", "minutes", "late")
    running = panes.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(by_time.rowsBetween(Window.unboundedPreceding, 0)) for c in sums})
    windows = []
    for hours, above, severity in BURN_WINDOWS:
        # a window of h hours holds the minutes at both of its ends
        within = [(F.col(c) - F.coalesce(F.lag(c, hours * 60 + 1).over(by_time), F.lit(0))).alias(c) for c in sums]
        windows.append(F.struct(F.lit(hours).alias("hours"), F.lit(above).alias("above"), F.lit(severity).alias("severity"), *within))
    rows = running.select("service_name", "threshold_ms", "at_ms", F.array(*windows).alias("w")).filter(F.col("at_ms") >= first)
    rows = rows.select("service_name", "threshold_ms", "at_ms", F.explode("w").alias("w")).select("service_name", "threshold_ms", "at_ms", "w.*")
    return _burning(d.join(rows, ["service_name", "threshold_ms"]), "service_name", "slo_name", "at_ms", "hours", "severity")


def burn_alerts(rates: DataFrame, now_ms: int, service: str = "", limit: int | None = 100) -> DataFrame:
    """The alerts among burn_rates(), as recorded at ``now_ms``, newest first."""
    rows = rates.filter("alert").select("service_name", "slo_name", "burn_rate", F.concat(F.col("hours").cast("string"), F.lit("h")).alias("window"), "severity", F.lit(now_ms).alias("alerted_at_ms"))
    return newest(rows, "alerted_at_ms", ["service_name", "slo_name", "window"], limit, service_name=service)


def with_glob(routes: DataFrame, glob: str = "match_service", regex: str = "service_regex", most: int = 10_000) -> DataFrame:
    """Routes with their glob as a regular expression; blank matches any, a bad one nothing.  The distinct
    globs of a routing table are few: at most ``most`` are compiled, more raise an error."""
    globs = [r[0] for r in routes.select(glob).distinct().limit(most + 1).collect()]
    if len(globs) > most:
        raise ValueError(f"more than {most} globs")
    rows = [(g, "" if not g else glob_regex(g)) for g in globs]
    known = routes.sparkSession.createDataFrame(rows or [("", "")], "g string, r string")
    return routes.join(F.broadcast(known), routes[glob].eqNullSafe(known["g"]), "left").drop("g").withColumnRenamed("r", regex)


def has_escalation() -> Column:
    """Whether a route escalates: after some minutes, and to somewhere."""
    return (F.col("escalation_after_min") > 0) & ((F.col("escalate_slack_url") != "") | (F.col("escalate_webhook_url") != ""))


def route_alerts(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Pairs of an event and an enabled route (the latest version of its id) that takes it, by priority and age of the route.

    events: id, service_name, severity, anomaly_type; blank conditions of a route take any.  The routing
    table's conditions on severity and type are joined as equalities over a short list of
    alternatives, so that only the glob is tested pair by pair.
    """
    r = with_glob(latest(routes, ["id"], F.col("created_at")).filter("enabled"))
    e = events.select(F.col("id").alias("event_id"), "service_name", "severity", "anomaly_type", F.explode(F.array(F.col("severity"), F.lit(""))).alias("match_severity"))
    e = e.withColumn("match_anomaly_type", F.explode(F.array(F.col("anomaly_type"), F.lit(""))))
    e = e.filter("not (match_severity = '' and severity = '') and not (match_anomaly_type = '' and anomaly_type = '')")
    hit = (F.col("service_regex") == "") | F.expr("service_name rlike service_regex")
    both = e.join(r.withColumnRenamed("id", "route_id"), ["match_severity", "match_anomaly_type"]).filter(F.col("service_regex").isNotNull() & hit)
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("priority", "created_at", "route_id"))
    return both.select("event_id", "route_id", "service_name", "priority", rank.alias("position"), (F.col("slack_url") != "").alias("to_slack"), (F.col("webhook_url") != "").alias("to_webhook"), has_escalation().alias("escalates"))


def escalations_due(events: DataFrame, routes: DataFrame, acks: DataFrame, now_ms: int) -> DataFrame:
    """Alert events (event_id, route_id, fired_at_ms, escalated) to escalate now: the latest version of their route
    escalates, time is up, nobody has acknowledged."""
    r = latest(routes, ["id"], F.col("created_at")).filter(has_escalation())
    due = events.filter("not escalated").join(r.select(F.col("id").alias("route_id"), "escalation_after_min"), "route_id")
    due = due.filter(F.col("fired_at_ms") + F.col("escalation_after_min") * 60_000 <= now_ms)
    return due.join(acks.select("event_id"), "event_id", "left_anti").select("event_id", "route_id", "fired_at_ms")


def upsert(table: DataFrame, rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """The table with new versions appended; blank and missing values take their defaults.  Read it through latest()."""
    for c, v in defaults.items():
        blank = F.col(c).isNull() | (F.col(c).cast("string") == "") if c in rows.columns else F.lit(True)
        rows = rows.withColumn(c, F.when(blank, F.lit(v)).otherwise(F.col(c)) if c in rows.columns else F.lit(v))
    return table.unionByName(rows, allowMissingColumns=True)


def soft_delete(table: DataFrame, key: str, value: object, version: str, now: Column) -> DataFrame:
    """The table with a newer copy of the latest version of one row, disabled."""
    gone = latest(table.filter(F.col(key) == value), [key], F.col(version)).withColumn("enabled", F.lit(False)).withColumn(version, now)
    return table.unionByName(gone)


def update_feedback(reports: DataFrame, report_id: str, resolved: bool, text: str) -> DataFrame:
    mine = F.col("id") == report_id
    return reports.withColumn("resolved", F.when(mine, F.lit(resolved)).otherwise(F.col("resolved"))).withColumn("feedback", F.when(mine, F.lit(text)).otherwise(F.col("feedback")))


def acknowledge(acks: DataFrame, event_id: str, now_ms: int) -> DataFrame:
    return acks.unionByName(acks.sparkSession.createDataFrame([(event_id, now_ms)], "event_id string, acked_at_ms long"))


def unacknowledged(events: DataFrame, acks: DataFrame) -> DataFrame:
    return events.join(acks.select("event_id"), "event_id", "left_anti")


def recorded(rows: DataFrame, now_ms: int, defaults: dict[str, object], time: str) -> DataFrame:
    """Rows to append, with defaults for blank values and the time of recording where none is given."""
    for c, v in defaults.items():
        rows = rows.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)))
    return rows.withColumn(time, F.coalesce(F.nullif(F.col(time), F.lit(0)), F.lit(now_ms)).cast("long"))


def apply_retention(df: DataFrame, days: int, today: str, date: str = "dt") -> DataFrame:
    """Rows not older than so many days; on a table partitioned by the date only its partitions are read."""
    return df.filter(F.col(date) >= F.date_sub(F.lit(today).cast("date"), days))


def evolve(parts: Sequence[DataFrame], defaults: dict[str, object]) -> DataFrame:
    """Tables of older and newer schemas as one: missing columns get their defaults."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def newest(df: DataFrame, time: str, key: str | list[str], limit: int | None = 100, from_ms: int | None = None, to_ms: int | None = None, **values: object) -> DataFrame:
    """A filtered list in a range of time, newest first: anomalies, reports, burn alerts, alert history."""
    df = equals(at_between(df, time, from_ms, to_ms), **values)
    return page(df, [F.col(time).desc(), *map(F.col, [key] if isinstance(key, str) else key)], limit)
