"""Known answers on tiny frames."""

import bisect
import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import ranking
from spanloom.functions.core import choose_error_tier, choose_tier, glob_regex, histogram_percentiles, leading_uint16, severity_label
from spanloom.operators import alerts, correlate, metrics, sampling, traces
from spanloom.sources import otlp, retention, sinks
from spanloom.sources.sql import check_plan, check_select, sql
from spanloom.sources.telemetry import view


def test_scalars(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (9,), (13,), (17,), (21,)], "n int")
    assert [r[0] for r in df.select(severity_label(F.col("n"))).collect()] == ["UNSPECIFIED", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
    rows = [([4, 0, 6, 10], [2.0, 4.0, 8.0]), ([], []), ([0, 0], [1.0]), (None, None), ([3], []), ([10, 10], [4.0])]
    h = spark.createDataFrame(rows, "bucket_counts array<long>, bounds array<double>")
    got = [tuple(r)[2:] for r in histogram_percentiles(h, {"a": 20, "b": 50, "c": 99}).collect()]
    assert got == [(2.0, 8.0, 8.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.6, 4.0, 4.0)]
    t = spark.createDataFrame([("200",), (" 404 x",), ("",), ("x",), ("65537",), ("-1",)], "t string")
    assert [r[0] for r in t.select(leading_uint16(F.col("t"))).collect()] == [200, 404, 0, 0, 1, 65535]


def test_tiers_and_globs():
    h = 3_600_000
    assert [choose_tier(7, 7 + x) for x in (3 * h, 3 * h + 1, 24 * h, 24 * h + 1)] == ["1m", "5m", "5m", "1h"] and choose_tier(None, 5) == choose_tier(0, 99 * h) == "1m" and choose_error_tier(1, 1 + 24 * h) == "1h"
    import re

    assert re.match(glob_regex("/actuator/*"), "/actuator/info") and not re.match(glob_regex("/actuator/*"), "/actuator/a/b")
    assert re.match(glob_regex("svc-[0-3]"), "svc-2") and glob_regex("[a") is None and glob_regex("a\\") is None and re.match(glob_regex("a\\*"), "a*")


def test_sql_guard(spark):
    check_select("select created_at, updated_at from t where x = 'drop it'")
    check_select("with a as (select 1) select * from a")
    assert sql(spark, "with a as (select id from {t}) select count(*) as n from a where id in (select id from {t})", t=spark.range(3)).first().n == 3
    bad = ["", "drop table t", "select 1; system reload", "select 1 union kill query x", "select 1; delete from t", "insert into t select 1", "select java_method('java.lang.System', 'getProperty', 'user.home')", "select `reflect`('java.lang.System', 'lineSeparator')"]
    bad += [r"with x as (select r'\' as c) insert into t select ' a'", "with x as (select 1 as c) from x insert into t select c"]
    for text in bad:
        with pytest.raises(ValueError):
            check_select(text)
    for text in (r"with x as (select r'\' as c) insert into t select ' a'", "cache table t", "set a = 1", "explain select 1"):
        with pytest.raises(ValueError):
            check_plan(spark, text)
    for path in ("parquet.`/root/testdata/sf0.001/nation.parquet`", "json.x"):
        for text in (f"select * from {path}", f"select 1 where 1 in (select 1 from {path})", f"with a as (select * from {path}) select * from a"):
            with pytest.raises(ValueError, match="not a table"):
                sql(spark, text)
    check_select("select granted, killed_at from t")


def test_trace_hash_and_rates(spark):
    """The last 16 digits of an id of 32 or more; the lower half of the range is kept at a rate of a half."""
    ids = {"5c1d" * 7 + "0b9e": 0x5C1D5C1D5C1D0B9E, "77" * 15 + "ab" * 3: 0x7777777777ABABAB, "beef" * 8: 0xBEEFBEEFBEEFBEEF, "12" * 15: 0, "z" * 32: 0}
    df = spark.createDataFrame([(i,) for i in ids], "t string")
    kept = lambda rate: [r[0] for r in df.select(sampling.keeps_share(F.col("t"), rate)).collect()]
    assert [int(r[0]) for r in df.select(sampling.trace_hash(F.col("t"))).collect()] == list(ids.values())
    assert kept(0.5) == [n < 2**63 for n in ids.values()] == [True, True, False, True, True]
    assert all(kept(1.0)) and not any(kept(0.0))


def test_adaptive_rates_fold_in_time_order(spark):
    offered = [(0, 10), (1, 40), (2, 5), (9, 300), (10, 300), (11, 2), (12, 1), (30, 900), (31, 7)]
    rows = [(f"t{s}-{k}", s * 1000 + k, "probabilistic") for s, n in offered for k in range(n)]
    df = spark.createDataFrame(rows, "trace_id string, first_ms long, reason string")
    ewma, rate, before, want = -1.0, 0.05, None, {}
    for s, n in offered:  # begins at the least rate; then what was offered, over the time since
        if before:
            seen = before[1] / (s - before[0])
            ewma = seen if ewma < 0 else 0.3 * seen + 0.7 * ewma
            rate = min(max(rate * 10 / ewma, 0.05), 1.0)
        want[s], before = rate, (s, n)
    for block in (86_400, 10, 2, 1):  # the blocks that tasks fold apart change nothing, nor does midnight
        assert {r.tick: round(r.rate, 9) for r in sampling.adaptive_rates(df, 10, 0.05, block=block).collect()} == {k: round(v, 9) for k, v in want.items()}
    assert sampling.adaptive_limit(df.withColumn("reason", F.lit("error")), 1, 0.05).count() == len(rows)
    assert sampling.adaptive_limit(df.filter("first_ms < 1000"), 10, 0.2).count() == 2 and sampling.adaptive_limit(df.limit(0), 10).count() == 0
    many = spark.range(200_000).select(F.col("id").cast("string").alias("trace_id"), (F.col("id") * 1000).alias("first_ms"))
    assert sampling.adaptive_rates(many, 0.5).count() == 200_000


SPAN = "trace_id string, span_id string, parent_span_id string, name string, service_name string, status_code int, start_time_nano long, end_time_nano long, kind int, exception_type string, exception_message string, http_status_code int"


def test_waterfall(spark):
    ms = 1_000_000
    rows = [("t", "r", "", "root", 0, 100), ("t", "a", "r", "A", 10, 60), ("t", "b", "r", "B", 50, 120), ("t", "c", "b", "C", 60, 120), ("t", "d", "x", "D", 70, 80), ("t", "e", "f", "E", 1, 2), ("t", "f", "e", "F", 1, 2)]
    rows += [("deep", f"n{k}", f"n{k - 1}" if k else "", f"n{k}", k, 2000 - k) for k in range(700)]
    df = spark.createDataFrame([(t, s, p, n, "svc", 1, a * ms, b * ms, 1, "", "", 0) for t, s, p, n, a, b in rows], SPAN)
    both = traces.trace_waterfall(df)
    deep = both.filter("trace_id = 'deep'").orderBy("position").collect()  # a chain longer than the limit
    assert [(r.depth, r.position, r.subtree_end_ms, r.critical) for r in deep] == [(k, k + 1, 2000 - k, k == 0) for k in range(500)]
    got = both.filter("trace_id = 't'").orderBy("position").collect()
    assert [(r.span_name, r.depth, r.critical) for r in got] == [("root", 0, True), ("A", 1, False), ("B", 1, True), ("C", 2, True), ("D", 0, False)]
    assert got[0].total_ms == 120 and got[0].span_count == 7 and got[3].offset_ms == 60


def test_waterfall_of_many_batches(spark):
    spans = view(spark, "/root/testdata/sf0.001", "spans")
    want = sorted(map(str, traces.trace_waterfall(spans).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # traces go on from one batch to the next
    try:
        assert sorted(map(str, traces.trace_waterfall(spans).collect())) == want and want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


LOG = "event_id long, trace_id string, span_id string, service_name string, timestamp_nano long, severity_text string, exception_type string, body string"


def test_trace_context_by_the_times_and_services_of_traces(spark):
    ms, now = 1_000_000, 1_700_000_000_000
    at = lambda t, i, service, start, end: (t, i, "", "root", service, 1, start * ms, end * ms, 2, "", "", 0)
    rows = [
        at("zero", "a", "svc", 0, now), at("good", "b", "svc", now - 5, now), at("back", "c", "svc", now, 0),
        at("blank", "d", "", now - 9, now), at("blank", "e", "svc", now - 8, now), at("nameless", "f", "", now, now + 1),
        at("later", "g", "svc", now + 500, now + 501),  # half a second into a minute
    ]
    spans = spark.createDataFrame(rows, SPAN).withColumn("duration_nano", F.col("end_time_nano") - F.col("start_time_nano"))
    logs = spark.createDataFrame([(1, "", "", "svc", now * ms, "INFO", "", "x"), (2, "", "", "svc", now * ms + 700_000, "INFO", "", "x"), (3, "zero", "s3", "other", 5, "INFO", "", "y"), (4, "", "", "", now * ms, "INFO", "", "z")], LOG)
    got = correlate.trace_context(spans, logs).collect()
    named = lambda t, what: sorted((r.position, r.item) for r in got if r.trace_id == t and r.what == what)
    # a start of 0 leaves the logs that name the trace, and no rates; so does an end before the start
    assert named("zero", "log") == [(1, "3")] and named("zero", "red") == [] == named("back", "log") == named("back", "red")
    assert [(r.log_trace_id, r.log_span_id) for r in got if r.item == "3"] == [("zero", "s3")]
    # not the log 0.7 ms after the end; a blank first service is passed over
    assert named("good", "log") == [(1, "1")] == named("blank", "log") and named("nameless", "log") == []
    assert [r.duration_ms for r in got if r.trace_id == "back" and r.what == "span"] == [-now]
    # now is 20 seconds into a minute: this one counts, and what begins up to 60 seconds before the whole second
    minute = (now - 20_000) * ms
    more = spark.createDataFrame([("m", f"m{k}", "", "x", "svc", 1, minute + k * 60_000 * ms, minute + k * 60_000 * ms, 2, "", "", 0) for k in (-2, -1, 0, 1, 2)], SPAN)
    more = more.withColumn("duration_nano", F.lit(0).cast("long"))
    got = [r for r in correlate.trace_context(spans.unionByName(more), logs).collect() if r.what == "red" and r.trace_id == "later"]
    assert sorted(r.at_ms - now for r in got) == [-20_000, 40_000]


def test_first_within_of_a_crowded_minute(spark):
    """Half of all points lie in one minute of one service, and 10,000 ranges look at it: no range makes more than 200 rows."""
    points = spark.range(100_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 97)).alias("service_name"), (F.col("id") * 7919 % 60_000).alias("at"))
    ranges = spark.range(10_000).select(F.col("id").alias("n"), F.lit("hot").alias("service_name"), (F.col("id") * 31 % 60_000).alias("range_from"), (F.col("id") * 31 % 60_000 + F.col("id") % 500).alias("range_to"))
    got = ranking.first_within(ranges, points, "service_name", "at", ["event_id"], 200)
    per = got.groupBy("n").agg(F.count("*").alias("k"), F.max("position").alias("p"), F.sum("event_id").alias("e"))
    mine = {r.n: (r.k, r.p, r.e) for r in per.collect()}
    hot = sorted((i * 7919 % 60_000, i) for i in range(0, 100_000, 2))
    times = [t for t, _ in hot]
    for n in range(10_000):
        a = bisect.bisect_left(times, n * 31 % 60_000)
        b = min(bisect.bisect_right(times, n * 31 % 60_000 + n % 500), a + 200)
        assert mine.get(n, (0, 0, 0)) == (b - a, b - a, sum(i for _, i in hot[a:b]))
    join = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x]
    assert len(join) >= 1 and "_block" in "".join(join)


def test_first_within_of_odd_rows(spark):
    points = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", None), (4, None, 5), (5, "b", 5), (6, "a", 9)], "event_id long, s string, at long")
    ranges = spark.createDataFrame([(1, "a", 5, 5), (2, "a", 5, 9), (3, "a", 9, 5), (4, None, 0, 9), (5, "c", 0, 9), (6, "a", None, 9), (2, "a", 5, 9)], "n long, s string, range_from long, range_to long")
    got = ranking.first_within(ranges, points, "s", "at", ["event_id"], 2)
    assert sorted((r.n, r.event_id, r.position) for r in got.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 1, 1), (2, 2, 2), (2, 2, 2)]
    assert ranking.first_within(ranges, points.limit(0), "s", "at", ["event_id"], 2).count() == 0 == ranking.first_within(ranges.limit(0), points, "s", "at", ["event_id"], 2).count()


def test_exact_percentiles_of_a_hot_group(spark):
    """A group with half of all rows is ranked over several partitions; all groups equal percentile()."""
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 4 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 13)).alias("k"), F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 1009 * 1_000_003).alias("v"))
    df = df.unionByName(spark.createDataFrame([("nulls", None)], "k string, v long"))
    shares = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.99, "e": 1.0}
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(c) for c, p in shares.items()])
    for most in (5_000, 10**6):
        got = ranking.exact_percentiles(df, ["k"], "v", shares, most)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_alerts_after_a_silence(spark):
    pick = random.Random(4)
    rows, want = [], []
    for place in ("steady", "rare", "mixed", None):
        now, last = 0, None
        for _ in range(1 if place == "rare" else 900):
            now += 1 if place == "steady" else pick.choice((1, 1, 1, 2, 9, 10, 11, 40))
            rows.append((place, now, "x"))
            if last is None or now - last >= 10:
                want.append((place, now, "x"))
                last = now
    df = spark.createDataFrame(rows, "place string, minute long, other string").repartition(3)
    assert sorted(map(tuple, correlate.alerting(df, ["place"], "minute", 10).collect()), key=str) == sorted(want, key=str)
    assert correlate.alerting(df.limit(0), ["place"], "minute", 10).count() == 0


def test_cardinality_of_more_full_keys_than_are_sent(spark):
    rows = [(k, "big" if k % 3 else "small", {f"k{j}": f"v{(k * (j + 1)) % (5 * j + 3)}" for j in range(8)}) for k in range(600)]
    df = spark.createDataFrame(rows, "n long, service_name string, attributes map<string,string>")
    sent, joined = (sampling.limit_cardinality(df, "attributes", ["n"], 6, sent=n) for n in (1000, 2))
    key = lambda d: sorted((r.n, sorted(r.attributes.items())) for r in d.collect())
    assert key(sent) == key(joined) and len(key(joined)) == 600
    assert any(v == sampling.HIGH_CARDINALITY for r in joined.collect() for v in r.attributes.values())


def test_sampling_by_the_service_of_the_root(spark):
    rows = [("t", "c", "r", 5, 1, "child"), ("t", "r", "", 9, 1, "front"), ("u", "a", "x", 1, 1, "child"), ("u", "b", "x", 2, 1, "front"), ("v", "a", "", 3, 1, "child"), ("v", "b", "", 2, 1, "front")]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, received_at_ms long, status_code int, service_name string").withColumn("duration_nano", F.lit(1).cast("long"))
    assert {r.trace_id: r.service_name for r in sampling.trace_facts(spans).collect()} == {"t": "front", "u": "child", "v": "front"}


def test_critical_traces_are_not_counted(spark):
    """A tick with any number of failed traces gives the others the rate they would have without them."""
    rows = [(f"p{k}", k * 10, "probabilistic") for k in range(300)] + [(f"e{k}", k, "error") for k in range(3000)] + [(f"l{k}", k, "latency") for k in range(500)]
    df = spark.createDataFrame(rows, "trace_id string, first_ms long, reason string")
    got = sampling.adaptive_limit(df, 20, 0.1)
    alone = sampling.adaptive_limit(df.filter("reason = 'probabilistic'"), 20, 0.1)
    assert got.filter("reason <> 'probabilistic'").count() == 3500
    assert sorted(got.filter("reason = 'probabilistic'").collect()) == sorted(alone.collect()) and 0 < alone.count() < 300


def test_histograms_merge_on_reading(spark):
    rows = [("a", "m", 1, [1, 2], [5.0], 3, 9.0), ("a", "m", 2, [], [], 2, 1.0), ("b", "m", 3, [], [], 4, 8.0), ("a", "m", 4, [0, 1, 7], [5.0, 6.0], 8, 2.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, service_name string, metric_name string, timestamp_nano long, bucket_counts array<long>, bounds array<double>, total_count long, total_sum double")
    one = metrics.histograms(metrics.histogram_rollup(df, "1m")).collect()
    parts = [metrics.histogram_rollup(df.filter(f"event_id % 3 = {k}"), "1m") for k in range(3)]
    assert sorted(metrics.histograms(parts[0].union(parts[1]).union(parts[2])).collect()) == sorted(one)
    assert {(r.service_name, r.total_count, r.total_sum, r.average) for r in one} == {("a", 13, 12.0, round(12 / 13, 7)), ("b", 4, 8.0, 2.0)}
    whole = {r.service_name: (r.bucket_counts, r.bounds) for r in metrics.histogram_rollup(df, "1m").collect()}
    assert whole == {"a": ([1, 3, 7], [5.0]), "b": ([], [])}


def test_burn_rate(spark):
    now, minute = 1_700_000_000_000 // 60_000 * 60_000, 60_000_000_000
    rows = [("s", "op", 2, now * 1_000_000 - k % 50 * minute, 2 if k < 2 else 1, 5_000_000, "/") for k in range(100)] + [("s", "op", 2, now * 1_000_000 - (61 + k % 200) * minute, 1, 5_000_000, "/") for k in range(900)]
    spans = spark.createDataFrame(rows, "service_name string, name string, kind int, start_time_nano long, status_code int, duration_nano long, http_route string")
    slo = [("s", "x", 50.0, "error_rate", 0.0, 1), ("s", "x", 99.9, "error_rate", 0.0, 2), ("s", "y", 100.0, "error_rate", 0.0, 1), ("none", "z", 99.0, "latency_p95", 1.0, 1)]
    slo += [("s", "slow", 90.0, "latency_p95", 4.0, 1), ("s", "free", 90.0, "latency_p95", 0.0, 1), ("s", "what", 90.0, "latency", 4.0, 1)]
    slo = spark.createDataFrame(slo, "service_name string, slo_name string, target_pct double, metric_type string, threshold_ms double, updated_at long")
    rates = alerts.burn_rates(spans, slo, now)
    got = {(r.slo_name, r.hours): (r.burn_rate, r.alert) for r in rates.collect()}
    nothing = {(n, h): (0.0, False) for n in ("z", "free") for h in (1, 6)}
    assert got == nothing | {("x", 1): (20.0, True), ("x", 6): (2.0, False), ("slow", 1): (10.0, False), ("slow", 6): (10.0, True)}
    assert [(r.slo_name, r.window, r.severity) for r in alerts.burn_alerts(rates, now).collect()] == [("slow", "6h", "ticket"), ("x", "1h", "page")]


def test_cardinality(spark):
    rows = [(k, "s", {"k": v, "i": str(k)}, {"k": "string", "i": "int"}) for k, v in enumerate("abcacd")]
    df = spark.createDataFrame(rows, "at int, service_name string, attributes map<string,string>, types map<string,string>")
    x = sampling.HIGH_CARDINALITY
    for sent in (sampling.SENT, 0):  # sent to all tasks, or joined by an exchange
        got = sampling.limit_cardinality(df, "attributes", ["at"], 2, types="types", sent=sent).orderBy("at").collect()
        assert [r.attributes["k"] for r in got] == ["a", "b", x, "a", x, x] and [r.attributes["i"] for r in got] == list("012345")


def test_versions(spark):
    routes = spark.createDataFrame([("r1", True, 1, "svc-*"), ("r2", True, 2, "")], "id string, enabled boolean, created_at long, match_service string")
    gone = alerts.latest(alerts.soft_delete(routes, "id", "r1", "created_at", F.lit(9).cast("long")), ["id"], F.col("created_at"))
    assert {r.id: r.enabled for r in gone.collect()} == {"r1": False, "r2": True}
    more = alerts.upsert(routes, spark.createDataFrame([("r3", 5, "")], "id string, created_at long, match_service string"), alerts.DEFAULTS["routes"])
    assert {r.id: r.enabled for r in more.collect()} == {"r1": True, "r2": True, "r3": True}
    slo = alerts.upsert(spark.createDataFrame([], "slo_name string, metric_type string, window_hours int"), spark.createDataFrame([("x", ""), ("y", "latency_p95")], "slo_name string, metric_type string"), alerts.DEFAULTS["slos"])
    assert sorted(map(tuple, slo.collect())) == [("x", "error_rate", 720), ("y", "latency_p95", 720)]
    reports = spark.createDataFrame([("a", False, ""), ("b", False, "")], "id string, resolved boolean, feedback string")
    assert {r.id: (r.resolved, r.feedback) for r in alerts.update_feedback(reports, "a", True, "ok").collect()} == {"a": (True, "ok"), "b": (False, "")}
    acks = alerts.acknowledge(spark.createDataFrame([], "event_id string, acked_at_ms long"), "e1", 5)
    assert [tuple(r) for r in acks.collect()] == [("e1", 5)]
    rows = spark.createDataFrame([("s", "", 0), ("s", "dev", 7)], "service_name string, environment string, deployed_at_ms long")
    assert sorted(tuple(r) for r in alerts.recorded(rows, 99, {"environment": "production"}, "deployed_at_ms").collect()) == [("s", "dev", 7), ("s", "production", 99)]


def attr(k, **v):
    return {"key": k, "value": v}


def test_otlp(spark):
    res = {"attributes": [attr("service.name", stringValue="shop")]}
    span = {"traceId": "AB" * 16, "spanId": "cd" * 8, "parentSpanId": "0" * 16, "name": "get", "kind": 2, "startTimeUnixNano": "1000", "endTimeUnixNano": "3000", "attributes": [attr("http.route", stringValue="/a"), attr("n", intValue="-708"), attr("d", doubleValue=0.0625), attr("b", boolValue=False)], "status": {"code": 2, "message": "no"}, "links": [{"traceId": "ab", "spanId": "cd"}]}
    line = json.dumps({"resourceSpans": [{"resource": res, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span]}]}]})
    got = otlp.otlp_traces(spark.createDataFrame([(line,), ("broken",)], "value string"), received_at_ms=F.lit(7)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.trace_id, r.parent_span_id, r.kind, r.duration_nano, r.status_code, r.service_name, r.received_at_ms) == ("ab" * 16, "", 2, 2000, 2, "shop", 7)
    assert r.attributes == {"http.route": "/a", "n": "-708", "d": "0.0625", "b": "false"} and json.loads(r.span_links)[0]["traceId"] == "ab"
    stored = sinks.span_rows(otlp.otlp_traces(spark.createDataFrame([(line,)], "value string"), received_at_ms=F.lit(7))).first()
    assert stored.http_route == "/a" and str(stored.dt) == "1970-01-01"
    point = {"timeUnixNano": "5", "asInt": "19"}
    hist = {"timeUnixNano": "6", "count": "9", "sum": 31.5, "bucketCounts": ["4", "0", "5"], "explicitBounds": [2, 8], "exemplars": [{"timeUnixNano": "1", "asDouble": 2.5, "traceId": "AA", "spanId": "BB", "filteredAttributes": [attr("x", stringValue="y")]}]}
    line = json.dumps({"resourceMetrics": [{"resource": res, "scopeMetrics": [{"metrics": [{"name": "m", "sum": {"dataPoints": [point]}}, {"name": "h", "histogram": {"dataPoints": [hist]}}, {"name": "e", "summary": {}}]}]}]})
    m = otlp.otlp_metrics(spark.createDataFrame([(line,)], "value string"), received_at_ms=F.lit(7))
    rows = {r.name: r for r in m.collect()}
    assert rows["m"].type == "SUM" and rows["m"].data_points[0].value == 19.0 and rows["e"].type == "UNSPECIFIED" and rows["e"].data_points == []
    assert rows["h"].data_points[0].bucket_counts == [4, 0, 5]
    assert {(r.name, r.value) for r in sinks.metric_rows(m).collect()} == {("m", 19.0), ("h", 31.5)}
    h = sinks.histogram_rows(m).first()
    assert h.total_count == 9 and h.exemplar_values == [2.5] and json.loads(h.exemplar_attributes[0]) == {"x": "y"}
    line = json.dumps({"resourceLogs": [{"resource": res, "scopeLogs": [{"logRecords": [{"timeUnixNano": "9", "severityNumber": 9, "severityText": "INFO", "body": {"stringValue": "hi"}, "attributes": [attr("exception.type", stringValue="E")]}]}]}]})
    log = sinks.log_rows(otlp.otlp_logs(spark.createDataFrame([(line,)], "value string"), received_at_ms=F.lit(7))).first()
    assert (log.body, log.exception_type, log.trace_id, log.service_name) == ("hi", "E", "", "shop")


def test_files(spark, tmp_path):
    good = {"timestampNanos": 1, "severityNumber": 9, "severityText": "INFO", "body": "x", "attributes": {"a": "b"}, "traceId": "", "spanId": "", "serviceName": "s", "scopeName": "", "receivedAtMs": 1704067200000}
    (tmp_path / "wal.jsonl").write_text("\n".join([json.dumps(good)] * 30 + ["broken"]))
    rows = otlp.read_signal_jsonl(spark, str(tmp_path / "wal.jsonl"), "logs")
    assert rows.collect().__len__() == 30 and rows.first().attributes == {"a": "b"}
    otlp.write_signal_jsonl(rows, str(tmp_path / "backup"))
    assert (tmp_path / "backup" / "dt=2024-01-01").is_dir()
    dlq = tmp_path / "dlq"
    otlp.write_dlq(rows.limit(2).coalesce(1), str(dlq), "down", "2024-01-01", "logs")
    long = {**good, "body": "y" * otlp.MOST_BYTES}
    (dlq / "logs-2023-12-30.jsonl").write_text(json.dumps(long) + "\n" + json.dumps({"error_reason": "down", "batch": []}) + "\n")
    (dlq / "logs-2024-01-02.jsonl").write_text(json.dumps(good) + "\nbroken\n")
    (dlq / "logs-2024-01-03.jsonl").write_text(json.dumps(good) + "\n")
    (dlq / "other-2024-01-01.jsonl").write_text(json.dumps(good) + "\n")
    assert len(otlp.read_dlq(spark, str(dlq), "logs", "2024-01-03").collect()) == 3
    (dlq / "logs-2023-99-99.jsonl").write_text("")
    assert retention.drop_dead_letters(spark, str(dlq), 0, "2024-01-04") == []
    assert retention.drop_dead_letters(spark, str(dlq), 3, "2024-01-04") == ["logs-2023-12-30.jsonl"]
    assert sorted(p.name for p in dlq.iterdir() if p.name[0] != ".") == ["logs-2023-99-99.jsonl", "logs-2024-01-01", "logs-2024-01-02.jsonl", "logs-2024-01-03.jsonl", "other-2024-01-01.jsonl"]


def test_guarded_sink_hands_failed_batches_on(spark):
    seen = []

    def write(df, batch):
        raise RuntimeError("down")

    tries = []
    sinks.guarded(lambda df, b: tries.append(b) or write(df, b), lambda df, b, why: seen.append((b, why, df.count())), (0, 0.01, 0))(spark.range(3), 4)
    assert seen == [(4, "RuntimeError: down", 3)] and tries == [4] * 4
    done = []
    sinks.both_ways(lambda df, b: done.append(df.count()), write, lambda b, why: seen.append((b, why)))(spark.range(3), 5)
    assert done == [3] and seen[1:] == [(5, "RuntimeError: down")]


def test_stored_table_prunes_partitions(spark, tmp_path):
    spans = view(spark, "/root/testdata/sf0.001", "spans")
    sinks.write_table(spans.drop("attributes"), str(tmp_path / "spans"), "service_name")
    read = spark.read.parquet(str(tmp_path / "spans"))
    some = traces.spans(read, None, from_ms=1704067200000 + 5 * 86_400_000, to_ms=1704067200000 + 6 * 86_400_000)
    kept = spans.filter("dt >= '2024-01-11'").count()
    assert retention.drop_all_partitions(spark, str(tmp_path), "2024-01-26", {"spans": 15, "none": 3})["spans"][-1] == "dt=2024-01-10"
    assert spark.read.parquet(str(tmp_path / "spans")).count() == kept
    sinks.write_table(spans.drop("attributes").filter("dt < '2024-01-11'"), str(tmp_path / "spans"), "service_name")
    read = spark.read.parquet(str(tmp_path / "spans"))
    some = traces.spans(read, None, from_ms=1704067200000 + 5 * 86_400_000, to_ms=1704067200000 + 6 * 86_400_000)
    assert "PartitionFilters: [isnotnull(dt" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == traces.spans(spans, None, from_ms=1704067200000 + 5 * 86_400_000, to_ms=1704067200000 + 6 * 86_400_000).count()


def test_baselines_of_the_last_days_and_the_newest_one(spark):
    spans = view(spark, "/root/testdata/sf0.001", "spans")
    now = 1704067200000 + 20 * 86_400_000
    some = correlate.red_baseline(spans, now, 7)
    inside = spans.filter(f"kind in (2, 5) and start_time_nano between {(now - 7 * 86_400_000) * 10**6} and {now * 10**6}").count()
    assert some.agg(F.sum("sample_count")).first()[0] == inside > 0
    both = some.union(correlate.red_baseline(spans, now + 1, 7).withColumn("p50", F.lit(-1.0)))
    force = correlate.baseline_in_force(both)
    assert force.count() == some.count() and {r.p50 for r in force.collect()} == {-1.0}


def test_shared_folder_is_asked_for(spark):
    from spanloom.plans.tables import shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
