"""Streams give what the batch gives, also in several micro-batches and out of order."""

import json
import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import logs, metrics, sampling, traces
from spanloom.sources import otlp, replay
from spanloom.sources.telemetry import view
from spanloom.streaming import adaptive, assembly, bags, jobs, merging, snapshots, tails

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Spans in four files, in no order of time."""
    path = str(tmp_path_factory.mktemp("spans") / "in")
    spans = view(spark, SF, "spans").drop("attributes", "dt")
    spans.repartition(4, F.xxhash64("span_id")).write.parquet(path)
    return path, spans


def test_rollups_by_micro_batch_equal_the_batch(spark, parts, tmp_path):
    path, spans = parts
    stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rollups = {"topology": traces.topology_rollup, "red": lambda d: traces.red_rollup(d, "1h")}
    q = jobs.start_rollups(stream, str(tmp_path / "out"), rollups, str(tmp_path / "check"), "0 seconds").start()
    q.processAllAvailable()
    q.stop()
    assert len(list((tmp_path / "out" / "topology").glob("batch=*"))) == 4
    got = traces.topology(spark.read.parquet(str(tmp_path / "out/topology")))
    assert sorted(got.collect()) == sorted(traces.topology(traces.topology_rollup(spans)).collect())
    red = traces.red_from_rollup(spark.read.parquet(str(tmp_path / "out/red")), limit=None)
    exact = {tuple(r)[:4]: r for r in traces.red(spans, "1h", limit=None).collect()}
    rows = red.collect()
    assert len(rows) == len(exact) and all(exact[tuple(r)[:4]].rps == r.rps and exact[tuple(r)[:4]].error_count == r.error_count for r in rows)


def test_other_rollups_by_micro_batch(spark, tmp_path):
    """Histograms, log volume, error logs, slow queries and error documents: partial rows read as one equal the batch."""
    h, l, s = (view(spark, SF, n) for n in ("histograms", "logs", "spans"))
    slow = lambda d: traces.slow_queries(d, threshold_ms=0, limit=None)
    jobs_of = {
        "histograms": (h, lambda d: metrics.histogram_rollup(d, "5m"), lambda r: metrics.histograms(r, limit=None)),
        "volume": (l, logs.log_volume_rollup, lambda r: logs.log_volume(l, r, limit=None)),
        "errors": (l, lambda d: logs.error_log_rollup(d, "1h"), lambda r: logs.error_logs(r, limit=None)),
        "slow": (s.drop("dt"), slow, lambda r: r),
        "documents": (l, logs.error_documents_from_logs, lambda r: r),
    }
    for name, (df, rollup, read) in jobs_of.items():
        df.repartition(3, F.xxhash64("event_id")).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        q = stream.writeStream.foreachBatch(jobs.rollup_sink(str(tmp_path / "out"), {name: rollup})).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = read(spark.read.parquet(str(tmp_path / "out" / name)).drop("batch"))
        assert sorted(map(str, got.collect())) == sorted(map(str, read(rollup(df)).select(got.columns).collect()))


def test_windows(spark, parts, tmp_path):
    path, spans = parts
    stream = spark.readStream.schema(spans.schema).parquet(path).withColumn("at", F.timestamp_micros(F.floor(F.col("start_time_nano") / 1000)))
    for name, df in (("windows", jobs.windowed_counts(stream, "at", ["service_name"], "1 hour", "60 days")), ("sliding", jobs.windowed_counts(stream, "at", ["service_name"], "1 hour", "60 days", "20 minutes"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spans.count()
    assert spark.table("sliding").agg(F.sum("n")).first()[0] == 3 * spans.count()


def test_sampled_batches(spark, parts):
    _, spans = parts
    config = sampling.Sampling(sampling.Policy(errors=True, rate=0.2))
    got = []
    jobs.sample_batch(config, lambda df, b: got.extend(df.collect()))(spans, 0)
    assert sorted(got) == sorted(sampling.tail_sample(spans, config).collect())


def _stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)


def _files(df, path, n, order):
    """df in n files, read one by one in the order of their rows."""
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // n)
    for k in range(n):
        df.sparkSession.createDataFrame(rows[k * size : (k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


@pytest.mark.parametrize("signal", ("spans", "metrics", "logs"))
def test_limited_bags_equal_the_batch(spark, tmp_path, signal):
    """Whole rows of each signal, in several triggers; the first values by service and key are those of the batch."""
    _stateful(spark)
    df = view(spark, SF, signal).limit(240)
    at = ["start_time_nano" if signal == "spans" else "timestamp_nano", "event_id"]
    id_, number = F.col("event_id").cast("string"), F.col("event_id").cast("long")
    bag = F.create_map(F.lit("id"), id_, F.lit("seven"), (number * 7 % 11).cast("string"), F.lit("one"), F.lit("x"), F.lit("count"), id_)
    df = df.withColumn("attributes", F.when(number % 10 != 3, bag)).withColumn("types", F.create_map(F.lit("id"), F.lit("string"), F.lit("seven"), F.lit("string"), F.lit("one"), F.lit("string"), F.lit("count"), F.lit("int")))
    df = df.drop("dt", "bounds").cache()
    path = str(tmp_path / "in")
    _files(df, path, 3, at)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = bags.limit_bags(stream, "attributes", ["event_id"], at, 5, types="types").writeStream.format("memory").queryName(f"limited_{signal}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    want = sampling.limit_cardinality(df, "attributes", at, 5, types="types")
    key = lambda d: sorted(str(sorted(r.asDict(recursive=True).items(), key=str)) if r.attributes is None else str(sorted({**r.asDict(), "attributes": sorted(r.attributes.items()), "types": None}.items())) for r in d.collect())
    got = spark.table(f"limited_{signal}")
    assert got.columns == df.columns and key(got) == key(want) and got.count() == df.count() == 240
    assert got.filter(F.array_contains(F.map_values("attributes"), sampling.HIGH_CARDINALITY)).count() > 50


def _until(stop, seconds=100):
    end = time.time() + seconds
    while not stop() and time.time() < end:
        time.sleep(0.5)
    assert stop()


def test_the_oldest_trace_closes_when_too_many_are_open(spark, tmp_path):
    """The fourth of three closes the first; its late span begins it anew, and a sampler decides a second time."""
    _stateful(spark)
    schema = "trace_id string, span_id string, parent_span_id string, received_at_ms long, status_code int, service_name string, duration_nano long"
    path, check = str(tmp_path / "in"), str(tmp_path / "c")
    add = lambda *rows: spark.createDataFrame([(t, s, "x", k, code, "svc", None) for k, (t, s, code) in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(path)
    add(("a", "a1", 1), ("a", "a2", 1), ("b", "b1", 1))
    batches, decided = {}, {}  # a batch that was stopped half-way runs again and counts once
    config = sampling.Sampling(sampling.Policy(errors=True))
    decide = jobs.sample_batch(config, lambda df, b: decided.update({b: [(r.trace_id, r.span_id) for r in df.collect()]}))
    released = lambda: [x for b in sorted(batches) for x in batches[b]]
    kept = lambda: [x for b in sorted(decided) for x in decided[b]]

    def sink(df, batch):
        batches[batch] = [(r.trace_id, r.span_id, r.duration_nano) for r in df.collect()]
        decide(df, batch)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = assembly.assemble_traces(stream, most_ms=3_600_000, most_open=3, shards=1).writeStream.foreachBatch(sink).option("checkpointLocation", check).trigger(processingTime="1 second").start()
    try:
        time.sleep(4)
        assert released() == []
        add(("c", "c1", 1), ("b", "b2", 1))
        time.sleep(3)
        add(("d", "d1", 1))
        _until(released)
        assert released() == [("a", "a1", None), ("a", "a2", None)] and kept() == []
        add(("a", "a3", 2))  # too late: a new trace, and b is the oldest now
        _until(lambda: len(released()) == 4)
        assert sorted(released()[2:]) == [("b", "b1", None), ("b", "b2", None)]
    finally:
        q.stop()
    # what is open is still so after a restart
    add(("e", "e1", 1), ("f", "f1", 1), ("g", "g1", 1))
    q = assembly.assemble_traces(stream, most_ms=3_600_000, most_open=3, shards=1).writeStream.foreachBatch(sink).option("checkpointLocation", check).trigger(processingTime="1 second").start()
    try:
        _until(lambda: len(released()) == 7)
        _until(kept)
        assert [r[1] for r in released()[4:]] == ["c1", "d1", "a3"] and kept() == [("a", "a3")]
    finally:
        q.stop()


def test_snapshots_are_told_again_without_news(spark, tmp_path):
    _stateful(spark)
    m, h = (view(spark, SF, n) for n in ("metrics", "histograms"))
    points = snapshots.runtime_points(m, h).cache()
    path = str(tmp_path / "in")
    _files(points, path, 2, ["event_id", "field"])
    stream = spark.readStream.schema(points.schema).parquet(path)
    told = []
    q = snapshots.snapshots(stream, 1500).writeStream.foreachBatch(lambda df, b: told.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        services = points.select("service_name").distinct().count()
        _until(lambda: len(told) >= 3 * services)
    finally:
        q.stop()
    want = {r.service_name: r.asDict() for r in metrics.jvm_snapshot(m, h).collect()}
    for r in told:
        assert {c: v for c, v in r.asDict().items() if c != "flushed_at_ms"} == {c: want[r.service_name].get(c) for c in r.asDict() if c != "flushed_at_ms"}
    times = {s: sorted(r.flushed_at_ms for r in told if r.service_name == s) for s in want}
    assert all(len(t) >= 2 and len(set(t)) == len(t) for t in times.values())


def test_traces_are_assembled_whole(spark, parts, tmp_path):
    _stateful(spark)
    path, spans = parts
    stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 1).parquet(path)
    batches = []
    q = assembly.assemble_traces(stream, 100, 4000, shards=4).writeStream.foreachBatch(lambda df, b: batches.append(df.select("trace_id", "span_id").collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    total, end = spans.count(), time.time() + 100
    while sum(map(len, batches)) < total and time.time() < end:
        time.sleep(1)
    q.stop()
    got = [tuple(r) for b in batches for r in b]
    assert sorted(got) == sorted(map(tuple, spans.select("trace_id", "span_id").collect()))


def test_tails_tell_each_row_once(spark, tmp_path):
    """Rows of one time on both sides of a poll; the 50 newest of a poll and no others; by service and severity."""
    _stateful(spark)
    schema = "event_id long, service_name string, severity_text string, received_at_ms long, body string"
    path = str(tmp_path / "in")
    subscriptions = spark.createDataFrame([("all", "", ""), ("errors", None, "ERROR"), ("a", "a", ""), ("b-errors", "b", "ERROR")], "subscription_id string, service string, severity string")
    rows = lambda first, n, at: [(k, "ab"[k % 2], ("ERROR", "INFO", None)[k % 3], at(k), f"body {k}") for k in range(first, first + n)]
    add = lambda r: spark.createDataFrame(r, schema).repartition(2).write.mode("append").parquet(path)
    one, two = rows(0, 200, lambda k: 1000 + k // 7), rows(200, 30, lambda k: 1000 + 199 // 7)  # the second has the last time of the first
    add(one)
    told = {}
    stream = spark.readStream.schema(schema).parquet(path)
    sink = lambda df, b: told.update({b: df.collect()})
    q = tails.tails(stream, subscriptions, every_ms=2000).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    seen = lambda: [r for b in sorted(told) for r in told[b]]
    try:
        _until(lambda: len({r.subscription_id for r in seen()}) == 4)
        add(two)
        _until(lambda: {r.subscription_id for r in seen() if r.poll == 2} == {"all", "errors", "a", "b-errors"})
        time.sleep(3)
    finally:
        q.stop()
    of = {"all": lambda r: True, "errors": lambda r: r[2] == "ERROR", "a": lambda r: r[1] == "a", "b-errors": lambda r: r[1] == "b" and r[2] == "ERROR"}
    for name, test in of.items():
        for poll, part in ((1, one), (2, two)):
            want = sorted(filter(test, part), key=lambda r: (-r[3], str(r[0])))[:50]
            got = sorted((r.position, json.loads(r.row)["event_id"], r.at_ms) for r in seen() if r.subscription_id == name and r.poll == poll)
            assert got == [(k + 1, r[0], r[3]) for k, r in enumerate(want)], (name, poll)
    assert max(r.poll for r in seen()) == 2


def test_adaptive_rates_of_a_stream_equal_the_batch(spark, tmp_path):
    _stateful(spark)
    offered = [(0, 10), (1, 40), (2, 5), (9, 300), (10, 300), (11, 2), (12, 1), (30, 900), (31, 7)]
    rows = [(f"t{s}-{k}", s * 1000 + k, "probabilistic") for s, n in offered for k in range(n)] + [(f"e{s}", s * 1000 + 5, "error") for s in range(40)]
    df = spark.createDataFrame(rows, "trace_id string, first_ms long, reason string")
    path = str(tmp_path / "in")
    _files(df, path, 4, ["first_ms", "trace_id"])
    # the last row only moves the watermark on
    spark.createDataFrame([("end", 10**6, "probabilistic")], df.schema).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rates, passed = {}, {}
    gate = adaptive.gate_sink(lambda ticks: df, lambda d, b: passed.update({b: d.collect()}))

    def sink(d, b):
        rates[b] = d.collect()
        gate(d, b)

    q = adaptive.rates_stream(stream, 10, 0.05).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    plain = df.filter("reason = 'probabilistic'")
    want = {r.tick: round(r.rate, 9) for r in sampling.adaptive_rates(plain, 10, 0.05).collect()}
    assert {r.tick: round(r.rate, 9) for b in rates.values() for r in b} == want and sum(len(b) for b in rates.values()) == len(want)
    assert sum(1 for b in rates.values() if b) > 1
    assert sorted(r for b in passed.values() for r in b) == sorted(sampling.adaptive_limit(df, 10, 0.05).filter("reason = 'probabilistic'").collect())


def test_rollup_folders_are_merged_while_readers_go_on(spark, parts, tmp_path):
    _, spans = parts
    path = str(tmp_path / "topology")
    for k in range(12):
        jobs.rollup_sink(str(tmp_path), {"topology": traces.topology_rollup})(spans.filter(F.pmod("event_id", F.lit(12)) == k), k)
    want = sorted(traces.topology(traces.topology_rollup(spans)).collect())
    same = lambda: sorted(traces.topology(merging.read_rollup(spark, path)).collect()) == want
    keys = ["caller", "callee", "minute5"]
    combine = lambda d: d.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("calls", "errors", "duration_sum")])
    during = []

    def watched(d):  # a reader while the merge is being written
        during.append(same())
        return combine(d)

    before = merging.read_rollup(spark, path)
    assert same()
    merging.merge(spark, path, watched, 3)
    assert same() and during == [True]
    assert sorted(traces.topology(before).collect()) == want  # one that began before
    with pytest.raises(ZeroDivisionError):
        merging.merge(spark, path, lambda d: 1 / 0, 7)
    assert same()
    merging.merge(spark, path, watched, 7, most_folders=1)
    folders = merging.merge(spark, path, watched, 9, most_folders=1)["folders"]
    assert len(folders) == 1 and same() and during == [True] * 3
    assert len(merging.clean(spark, path)) == 10 + 2 and same()
    assert sorted(p.name for p in (tmp_path / "topology").iterdir() if p.name[0] not in "._") == ["batch=10", "batch=11", *folders]
    assert merging.merge(spark, path, watched, 9)["folders"] == folders and merging.clean(spark, path) == []
    # sketches merge too
    red = str(tmp_path / "red")
    for k in range(4):
        jobs.rollup_sink(str(tmp_path), {"red": lambda d: traces.red_rollup(d, "1h")})(spans.filter(F.pmod("event_id", F.lit(4)) == k), k)
    one = sorted(traces.red_from_rollup(merging.read_rollup(spark, red), limit=None).collect())
    merging.merge(spark, red, traces.merged_red, 2)
    assert sorted(traces.red_from_rollup(merging.read_rollup(spark, red), limit=None).collect()) == one


def test_dead_letters_are_replayed_exactly_once(spark, tmp_path):
    """Stopped before the rows are marked as written, and between that and the files' removal."""
    path, target, ledger = (str(tmp_path / x) for x in ("dlq", "target", "ledger"))
    row = lambda k: spark.createDataFrame([(f"body {k}",)], "body string").coalesce(1)
    for k, day in enumerate(("2024-01-01", "2024-01-02", "2024-01-03")):
        otlp.write_dlq(row(k), path, "down", day, "logs")
        otlp.write_dlq(row(10 + k), path, "down", day, "spans")
    bodies = lambda: sorted(r.body for r in replay.replayed(spark, target, ledger).collect())
    stopped = RuntimeError("stopped")

    def stop():
        raise stopped

    with pytest.raises(RuntimeError):  # written and marked, not removed
        replay.replay(spark, path, "logs", "2024-01-03", target, ledger, before_removal=stop)
    assert bodies() == ["body 0", "body 1"] and len(replay.pending(spark, path, "logs", "2024-01-03")) == 2
    otlp.write_dlq(row(7), path, "down", "2024-01-02", "logs")  # comes late: a group of its own
    assert replay.replay(spark, path, "logs", "2024-01-03", target, ledger) == 3
    assert bodies() == ["body 0", "body 1", "body 7"] and replay.pending(spark, path, "logs", "2024-01-03") == []
    assert len(replay.pending(spark, path, "spans", "2024-01-03")) == 2
    # the rows are there but not marked: the group is written anew
    otlp.write_dlq(row(8), path, "down", "2024-01-02", "logs")
    with pytest.raises(RuntimeError):
        replay.replay(spark, path, "logs", "2024-01-03", target, ledger, before_removal=stop)
    for done in (tmp_path / "ledger").glob("*.done"):
        if not done.with_suffix(".removed").exists():
            done.unlink()
    assert bodies() == ["body 0", "body 1", "body 7"]
    assert replay.replay(spark, path, "logs", "2024-01-03", target, ledger) == 1 and bodies() == ["body 0", "body 1", "body 7", "body 8"]
    assert replay.replay(spark, path, "logs", "2024-01-03", target, ledger) == 0
    assert replay.replay(spark, path, "logs", "2024-01-04", target, ledger) == 1 and bodies()[2] == "body 2"
