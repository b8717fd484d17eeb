"""Spans: lists, rollups, topology, errors, whole-trace views."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.core import NANO, TIERS, attribute, bucket, buckets_between, choose_tier, equals, leading_uint16, matches_glob, nanos_between, page, received_between

#: Attribute keys that become columns.
PROMOTED = {
    "http_method": "http.request.method", "http_route": "http.route", "http_status_code": "http.response.status_code", "db_system": "db.system", "db_name": "db.name", "db_operation": "db.operation", "rpc_system": "rpc.system", "rpc_service": "rpc.service",
    "rpc_method": "rpc.method", "peer_service": "peer.service", "exception_type": "exception.type", "exception_message": "exception.message", "exception_stacktrace": "exception.stacktrace",
}
#: Attributes that hold a span's address.
ADDRESSES = ("http.url", "url.path", "http.target", "url.full")
KINDS = ("INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
RED_KEYS = ["service_name", "span_name", "http_route", "minute"]


def spans(df: DataFrame, limit: int | None = 100, offset: int = 0, from_ms: int | None = None, to_ms: int | None = None, service: str = "", trace_id: str = "", status: int = -1, min_duration_ms: float = 0) -> DataFrame:
    """Spans received in a range, the last received first."""
    df = equals(received_between(df, from_ms, to_ms), service_name=service, trace_id=trace_id)
    if status >= 0:
        df = df.filter(F.col("status_code") == status)
    if min_duration_ms > 0:
        df = df.filter(F.col("duration_nano") >= int(min_duration_ms * 1e6))
    return page(df, [F.col("received_at_ms").desc(), F.col("span_id")], limit, offset)


def slow_queries(df: DataFrame, service: str = "", from_ms: int | None = None, to_ms: int | None = None, threshold_ms: float = 500, limit: int | None = 100) -> DataFrame:
    """Database spans that took at least the threshold, slowest first."""
    df = equals(df.filter("db_system <> ''").filter(nanos_between("start_time_nano", from_ms, to_ms)), service_name=service)
    df = df.filter(F.col("duration_nano") / 1e6 >= threshold_ms)
    df = page(df, [F.col("duration_nano").desc(), F.col("span_id")], limit)
    return df.select(
        "trace_id", "span_id", "service_name", "db_system", "db_name", "db_operation", attribute("attributes", "db.statement").alias("db_statement"),
        F.round(F.col("duration_nano") / 1e6, 2).alias("duration_ms"), F.floor(F.col("start_time_nano") / 1_000_000).alias("start_ms"), "status_code",
    )


def promote_attributes(df: DataFrame, bag: str = "attributes") -> DataFrame:
    """Columns for the promoted attributes; the status code is the integer its text begins with."""
    return df.withColumns({c: leading_uint16(attribute(bag, k)) if c == "http_status_code" else attribute(bag, k) for c, k in PROMOTED.items()})


def derived_columns(df: DataFrame) -> DataFrame:
    kind = F.lit("UNSPECIFIED")
    for n, name in enumerate(KINDS, 1):
        kind = F.when(F.col("kind") == n, name).otherwise(kind)
    return df.withColumns({"duration_ms": F.col("duration_nano") / 1e6, "is_error": F.col("status_code") == 2, "span_kind_str": kind})


def exclude_spans(df: DataFrame, patterns: list[str], bag: str = "attributes") -> DataFrame:
    """Spans of which neither the name nor an address attribute matches one of the globs."""
    hit: Column = F.lit(False)
    for p in patterns:
        for c in (F.col("name"), *[attribute(bag, a) for a in ADDRESSES]):
            hit |= matches_glob(c, p)
    return df.filter(~hit)


def red_rollup(df: DataFrame, tier: str) -> DataFrame:
    """Partial rate, error and duration aggregates by service, span, route and bucket of server and consumer
    spans: sums, and a mergeable quantile sketch.  Rows of several runs or batches can be appended."""
    df = df.filter(F.col("kind").isin(2, 5))
    return df.groupBy("service_name", F.col("name").alias("span_name"), "http_route", bucket("start_time_nano", TIERS[tier]).alias("minute")).agg(
        F.count("*").alias("requests"), F.sum((F.col("status_code") == 2).cast("long")).alias("errors"), F.sum("duration_nano").alias("duration_sum"), F.kll_sketch_agg_double(F.col("duration_nano").cast("double")).alias("sketch")
    )


def merged_red(rollup: DataFrame) -> DataFrame:
    """Partial aggregates of red_rollup() as fewer of them, one for each key."""
    sums = [F.sum(c).alias(c) for c in ("requests", "errors", "duration_sum")]
    return rollup.groupBy(*RED_KEYS).agg(*sums, F.kll_merge_agg_double("sketch").alias("sketch"))


def red_from_rollup(rollup: DataFrame, service: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 1000) -> DataFrame:
    """Rates, errors and durations from partial aggregates; percentiles by merged sketches."""
    df = equals(rollup.filter(buckets_between("minute", from_ms, to_ms)), service_name=service)
    df = df.groupBy(*RED_KEYS).agg(F.sum("requests").alias("rps"), F.sum("errors").alias("error_count"), F.kll_merge_agg_double("sketch").alias("s"))
    q = lambda p: (F.kll_sketch_get_quantile_double("s", F.lit(p)) / 1e6)
    df = df.select(*RED_KEYS, "rps", "error_count", (F.col("error_count") / F.col("rps") * 100).alias("error_rate"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))
    return page(df, [F.col("minute").desc(), *map(F.col, RED_KEYS[:3])], limit)


def red(df: DataFrame, tier: str, service: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 1000) -> DataFrame:
    """The same from spans, with exact percentiles; rps is a count per bucket."""
    df = equals(df.filter(F.col("kind").isin(2, 5)), service_name=service)
    df = df.select("service_name", F.col("name").alias("span_name"), "http_route", bucket("start_time_nano", TIERS[tier]).alias("minute"), "status_code", "duration_nano").filter(buckets_between("minute", from_ms, to_ms))
    df = df.groupBy(*RED_KEYS).agg(F.count("*").alias("rps"), F.sum((F.col("status_code") == 2).cast("long")).alias("error_count"), F.percentile("duration_nano", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    df = df.select(*RED_KEYS, "rps", "error_count", F.round(F.col("error_count") / F.col("rps") * 100, 4).alias("error_rate"), *[F.round(F.get("p", F.lit(i)) / 1e6, 4).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])
    return page(df, [F.col("minute").desc(), *map(F.col, RED_KEYS[:3])], limit)


def red_tiered(rollups: dict[str, DataFrame], service: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 1000) -> DataFrame:
    """red_from_rollup() of the rollup (1m, 5m, 1h) that the range asks for."""
    return red_from_rollup(rollups[choose_tier(from_ms, to_ms)], service, from_ms, to_ms, limit)


def topology_rollup(df: DataFrame) -> DataFrame:
    """Five-minute partial sums of calls from client spans to their peer."""
    df = df.filter((F.col("kind") == 3) & (F.col("peer_service") != ""))
    return df.groupBy(F.col("service_name").alias("caller"), F.col("peer_service").alias("callee"), bucket("start_time_nano", 300).alias("minute5")).agg(F.count("*").alias("calls"), F.sum((F.col("status_code") == 2).cast("long")).alias("errors"), F.sum("duration_nano").alias("duration_sum"))


def topology(rollup: DataFrame, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    df = rollup.filter(buckets_between("minute5", from_ms, to_ms)).groupBy("caller", "callee").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("duration_sum").alias("d"))
    df = df.select("caller", "callee", "calls", "errors", F.round(F.col("errors") / F.col("calls") * 100, 4).alias("error_rate"), F.round(F.col("d") / F.col("calls") / 1e6, 4).alias("avg_ms"))
    return df.orderBy(F.col("calls").desc(), "caller", "callee")


def broken_traces(df: DataFrame, service: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 100, whole_trace: bool = False) -> DataFrame:
    """Traces without a root span, newest first.  Filters apply to spans, so a root outside them doesn't
    count, unless ``whole_trace``: then they pick traces by any span, and all spans are looked at."""
    some = equals(df.filter(nanos_between("start_time_nano", from_ms, to_ms)), service_name=service)
    if whole_trace:
        some = df.join(some.select("trace_id").distinct(), "trace_id", "left_semi")
    g = some.groupBy("trace_id").agg(
        F.count("*").alias("span_count"), F.min(F.when(F.col("service_name") != "", F.col("service_name"))).alias("service"), F.floor(F.min("start_time_nano") / 1_000_000).alias("start_ms"),
        F.sum((F.col("status_code") == 2).cast("long")).alias("error_count"), F.max("duration_nano").alias("max_duration_nano"), F.sum((F.col("parent_span_id") == "").cast("long")).alias("roots"),
    )
    g = g.filter("roots = 0").select("trace_id", "span_count", F.coalesce("service", F.lit("")).alias("service_name"), "start_ms", "error_count", F.floor(F.col("max_duration_nano") / 1_000_000).alias("max_duration_ms"))
    return page(g, [F.col("start_ms").desc(), F.col("trace_id")], limit)


def error_groups(df: DataFrame, service: str = "", from_ms: int | None = None, to_ms: int | None = None, limit: int | None = 100) -> DataFrame:
    """Failed spans with an exception type by fingerprint of service, exception and message, most frequent first;
    times are whole seconds."""
    second = F.col("start_time_nano") - F.pmod("start_time_nano", F.lit(NANO))
    df = df.filter("status_code = 2 and exception_type <> ''").select("service_name", "exception_type", F.substring("exception_message", 1, 200).alias("message"), (second / 1_000_000).cast("long").alias("at_ms"))
    df = equals(df, service_name=service)
    if from_ms is not None:
        df = df.filter(F.col("at_ms") >= from_ms // 1000 * 1000)
    if to_ms is not None:
        df = df.filter(F.col("at_ms") <= to_ms // 1000 * 1000)
    g = df.groupBy(F.md5(F.concat_ws("|", "service_name", "exception_type", "message")).alias("fingerprint"), "service_name", "exception_type", "message").agg(F.count("*").alias("total"), F.min("at_ms").alias("first_seen_ms"), F.max("at_ms").alias("last_seen_ms"))
    return page(g, [F.col("total").desc(), F.col("fingerprint")], limit)


def error_documents_from_spans(df: DataFrame) -> DataFrame:
    """A text for each failed span with a status message: service, name, error, exception, message, stack."""
    df = df.filter("status_code = 2 and status_message <> ''")
    line = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("["), F.col("service_name"), F.lit("] "), F.col("name"), F.lit("\nERROR: "), F.col("status_message"), F.lit("\n"))
    return df.select(
        F.sha2(F.concat_ws("|", F.lit("span_error"), "trace_id", "span_id"), 256).alias("id"),
        F.lit("span_error").alias("source_type"),
        F.col("span_id").alias("source_id"),
        "service_name",
        "trace_id",
        "span_id",
        F.floor(F.col("start_time_nano") / 1_000_000).alias("occurred_ms"),
        F.concat(head, line("Exception", "exception_type"), line("Message", "exception_message"), F.substring("exception_stacktrace", 1, 2000)).alias("document"),
    )


#: What trace_waterfall() reads of a span.
_NODE = "trace_id string, span_id string, parent_span_id string, span_name string, service_name string, kind int, status_code int, exception_type string, exception_message string, http_status_code int, start_ms long, duration_ms long"
_NODES = "trace_id string, span_id string, parent_span_id string, span_name string, service_name string, kind int, status_code int, exception_type string, exception_message string, http_status_code int, depth int, start_ms long, offset_ms long, duration_ms long, subtree_end_ms long, critical boolean, position int, total_ms long, span_count long, error_count long, service_count long, root_span_count long"


def trace_waterfall(df: DataFrame, per_trace: int = 500) -> DataFrame:
    """Depth, offset, subtree end, order and critical path of the spans of every trace.

    A span ends its duration in whole milliseconds after the millisecond it starts in.  A span whose parent is empty or missing is a
    root; spans in a cycle are left out, though they count as spans and services of the trace.  Only the
    first ``per_trace`` spans of a trace by start are looked at, so a trace is a bounded group.  One exchange
    by trace; the trees of all traces of an Arrow batch are then built at once in numpy.
    """
    first = Window.partitionBy("trace_id").orderBy("start_time_nano", "span_id")
    whole = {"start_ms": F.expr("start_time_nano div 1000000"), "duration_ms": F.expr("(end_time_nano - start_time_nano) div 1000000")}
    s = df.withColumnRenamed("name", "span_name").withColumns({**whole, "n": F.row_number().over(first)})
    s = s.filter(F.col("n") <= per_trace).sortWithinPartitions("trace_id", "start_time_nano", "span_id")
    return s.select(*[c.split()[0] for c in _NODE.split(", ")]).mapInPandas(_waterfalls, _NODES)


def _waterfalls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Traces lie together, by start; the last of a batch may go on in the next."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        ids = b["trace_id"].to_numpy()
        whole = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if len(b) and (ids != ids[-1]).any() else 0
        rest = b.iloc[whole:]
        if whole:
            yield _trees(b.iloc[:whole].reset_index(drop=True))
    if rest is not None and len(rest):
        yield _trees(rest.reset_index(drop=True))


def _trees(b: pd.DataFrame) -> pd.DataFrame:
    n = len(b)
    trace, _ = pd.factorize(b["trace_id"])
    names, _ = pd.factorize(pd.concat([b["span_id"], b["parent_span_id"]]))
    own, above = trace * (2 * n) + names[:n], trace * (2 * n) + names[n:]
    order = np.argsort(own, kind="stable")
    at = np.searchsorted(own[order], above, "right") - 1  # of equal ids the last is the parent
    found = (at >= 0) & (own[order][at] == above) & (b["parent_span_id"].to_numpy() != "")
    parent = np.where(found, order[at], -1)
    # depths by pointer doubling: a span that doesn't come to a root in as many steps as there are is in a cycle
    up, depth = np.where(found, parent, np.arange(n)), found.astype(np.int64)
    for _ in range(int(np.bincount(trace).max()).bit_length()):
        depth, up = depth + depth[up], up[up]
    there = ~found[up]
    start, lasts = b["start_ms"].to_numpy(), b["duration_ms"].to_numpy()
    end = start + lasts
    levels = [np.flatnonzero(there & (depth == d)) for d in range(int(depth[there].max(initial=-1)) + 1)]
    most, size = end.copy(), np.ones(n, np.int64)
    for level in levels[:0:-1]:
        np.maximum.at(most, parent[level], most[level])
        np.add.at(size, parent[level], size[level])
    first, last = np.full(trace.max() + 1, np.iinfo(np.int64).max), np.full(trace.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(first, trace, start)
    np.maximum.at(last, trace[there], end[there])
    # siblings by start; of those whose subtree ends last in the trace, the first is chosen
    family = np.where(found, parent, n + trace)
    spelled, _ = pd.factorize(b["span_id"], sort=True)
    order = np.lexsort((np.arange(n), spelled, start, family))
    order = order[there[order]]
    new = np.diff(family[order], prepend=-1) != 0
    before = np.cumsum(size[order]) - size[order]
    offset = np.zeros(n, np.int64)
    offset[order] = before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(order))))
    ends = order[(most == last[trace])[order]]
    chosen = np.zeros(n, bool)
    chosen[ends[np.diff(family[ends], prepend=-1) != 0]] = True
    named, kinds = pd.factorize(b["service_name"])
    services = np.bincount(np.unique(trace * (len(kinds) + 1) + named + 1) // (len(kinds) + 1))
    position = offset + 1
    for level in levels[1:]:
        chosen[level] &= chosen[parent[level]]
        position[level] += position[parent[level]]
    out = b.assign(
        depth=depth.astype(np.int32), offset_ms=np.maximum(start - first[trace], 0), subtree_end_ms=most, critical=chosen, position=position.astype(np.int32),
        total_ms=(last - first)[trace], span_count=np.bincount(trace)[trace], error_count=np.bincount(trace, b["status_code"].to_numpy() == 2).astype(np.int64)[trace],
        service_count=services[trace], root_span_count=np.bincount(trace, ~found).astype(np.int64)[trace],
    )
    return out[there][[c.split()[0] for c in _NODES.split(", ")]]
