"""Trace sampling and attribute-cardinality limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.core import NANO, matches_glob
from spanloom.plans.tables import cut

HIGH_CARDINALITY = "__high_cardinality__"
#: Reasons for which a trace goes past the adaptive limit.
CRITICAL = ("error", "latency")


@dataclass(frozen=True)
class Policy:
    """Which traces stay: failed ones, slow ones (root above so many ms), a share by hash.  None: not used."""

    errors: bool = False
    latency_ms: float | None = None
    rate: float | None = None

    @property
    def empty(self) -> bool:
        return not self.errors and self.latency_ms is None and self.rate is None


@dataclass(frozen=True)
class Sampling:
    """The default policy and, by service glob, policies that replace it whole; the first match counts."""

    default: Policy = Policy()
    services: tuple[tuple[str, Policy], ...] = field(default=())
    enabled: bool = True


def trace_hash(trace_id: Column) -> Column:
    """The last 16 hex digits as an unsigned number; 0 for short or malformed ids."""
    tail = F.right(trace_id, F.lit(16))
    ok = (F.length(trace_id) >= 32) & tail.rlike("^[0-9a-fA-F]{16}$")
    return F.when(ok, F.conv(F.when(ok, tail).otherwise(F.lit("0")), 16, 10).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))


def keeps_share(trace_id: Column, rate: float) -> Column:
    """Whether a trace's hash is below its share of the hash range."""
    if rate >= 1:
        return F.lit(True)
    if rate <= 0:
        return F.lit(False)
    return trace_hash(trace_id) < F.lit(str(int(rate * 2**64))).cast("decimal(20,0)")


def trace_facts(spans: DataFrame) -> DataFrame:
    """What decides on a trace: an error, the latency (of the first root to arrive, else of any span), the service (of that
    root, else of the first span to arrive)."""
    arrival = F.struct("received_at_ms", "span_id")
    root = F.col("parent_span_id") == ""
    g = spans.groupBy("trace_id").agg(
        F.bool_or(F.col("status_code") == 2).alias("failed"), F.min_by(F.when(root, F.col("duration_nano")), F.when(root, arrival)).alias("root_nano"), F.max("duration_nano").alias("most_nano"),
        F.min_by(F.when(root, F.col("service_name")), F.when(root, arrival)).alias("root_service"), F.min_by("service_name", arrival).alias("service_name"), F.min("received_at_ms").alias("first_ms"),
    )
    g = g.withColumn("latency_nano", F.coalesce("root_nano", "most_nano"))
    return g.withColumn("service_name", F.coalesce("root_service", "service_name")).drop("root_service")


def decision(config: Sampling) -> Column:
    """The reason a trace of trace_facts() stays (error, latency, probabilistic, disabled), or null."""
    if not config.enabled:
        return F.lit("disabled")

    def reason(p: Policy) -> Column:
        out = F.when(F.lit(False), "")
        if p.errors:
            out = out.when(F.col("failed"), "error")
        if p.latency_ms is not None:
            out = out.when(F.col("latency_nano") > p.latency_ms * 1e6, "latency")
        if p.rate is not None:
            out = out.when(keeps_share(F.col("trace_id"), p.rate), "probabilistic")
        return out

    out = reason(config.default)
    for glob, p in reversed(config.services):
        out = F.when(matches_glob(F.col("service_name"), glob), reason(p)).otherwise(out)
    return out


def sampled_traces(spans: DataFrame, config: Sampling) -> DataFrame:
    return trace_facts(spans).withColumn("reason", decision(config)).filter("reason is not null")


def tail_sample(spans: DataFrame, config: Sampling) -> DataFrame:
    """The spans of the traces that stay, whole."""
    return spans.join(sampled_traces(spans, config).select("trace_id"), "trace_id", "left_semi")


def adaptive_rates(traces: DataFrame, target_tps: float, least: float = 0.01, most: float = 1.0, alpha: float = 0.3, tick_ms: int = 1000, block: int = 86_400) -> DataFrame:
    """``tick, rate``: the rate in force in each tick with traces, from the smoothed traces per second offered before.

    The rate begins at ``least``.  At each tick with traces, those of the tick before over the time since
    then are smoothed, and the rate is scaled by target over actual and clamped.  Both recurrences are
    compositions of maps (x to ax + b, and x to clamp(ax, lo, hi)): each block of ticks is first reduced to
    one such map, so only a row for each block is folded in order, and no task holds more than a block.
    """
    least = least if least > 0 else 0.01
    per = traces.groupBy(F.floor(F.col("first_ms") / tick_ms).alias("tick")).agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("tick") / block))
    # what a block has to know of the tick before it: a row for each block
    by_block = Window.orderBy("block")
    ends = per.groupBy("block").agg(F.max("tick").alias("tick"), F.max_by("n", "tick").alias("n"))
    ends = ends.select("block", F.lag("tick").over(by_block).alias("prior_tick"), F.lag("n").over(by_block).alias("prior_n"))
    per = per.join(F.broadcast(ends), "block")

    def tps(rows: pd.DataFrame) -> np.ndarray:
        """Traces per second seen at each tick; nan at the very first."""
        rows.sort_values("tick", inplace=True)
        tick, n = rows["tick"].to_numpy().astype(float), rows["n"].to_numpy().astype(float)
        gone = np.diff(tick, prepend=float(rows["prior_tick"].iloc[0])) * tick_ms / 1000
        return np.concatenate([[float(rows["prior_n"].iloc[0])], n[:-1]]) / gone

    def smoothed(seen: np.ndarray, ewma: float) -> Iterator[float]:
        for x in seen:
            if x == x:
                ewma = x if ewma < 0 else alpha * x + (1 - alpha) * ewma
            yield ewma

    def affine(rows: pd.DataFrame) -> pd.DataFrame:
        seen = tps(rows)
        a, b = 1.0, 0.0
        for x in seen[seen == seen]:
            a, b = a * (1 - alpha), alpha * x + (1 - alpha) * b
        first = next((x for x in seen if x == x), -1.0)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "a": [a], "b": [b], "first": [first], "cold": [b + a * first if first >= 0 else -1.0]})

    def clamps(rows: pd.DataFrame) -> pd.DataFrame:
        a, lo, hi = 1.0, -np.inf, np.inf
        seen = tps(rows)
        for x, e in zip(seen, smoothed(seen, rows["ewma"].iloc[0])):
            if x == x:
                k = target_tps / e
                a, lo, hi = a * k, min(max(lo * k, least), most), min(max(hi * k, least), most)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "a": [a], "lo": [lo], "hi": [hi]})

    def rates(rows: pd.DataFrame) -> pd.DataFrame:
        rate, out, seen = rows["rate"].iloc[0], [], tps(rows)
        for x, e in zip(seen, smoothed(seen, rows["ewma"].iloc[0])):
            if x == x:
                rate = min(max(rate * target_tps / e, least), most)
            out.append(rate)
        return pd.DataFrame({"tick": rows["tick"], "rate": out})

    def carried(blocks: DataFrame, start: float, name: str, step: Callable[[Column, Column], Column]) -> DataFrame:
        """What each block begins with: a fold over the rows of the blocks before it."""
        folded = blocks.agg(F.array_sort(F.collect_list(F.struct(*blocks.columns))).alias("s"))
        states = F.aggregate("s", F.array(F.lit(float(start))), lambda s, x: F.concat(s, F.array(step(F.element_at(s, -1), x))))
        return folded.select(F.explode(F.arrays_zip("s", F.slice(states, 1, F.size("s")).alias("v"))).alias("e")).select("e.s.block", F.col("e.v").alias(name))

    grouped = lambda df, f, schema: df.groupBy("block").applyInPandas(f, schema)
    maps = grouped(per, affine, "block long, a double, b double, first double, cold double")
    cold = carried(maps, -1.0, "ewma", lambda s, x: F.when(s < 0, x.cold).otherwise(x.a * s + x.b))
    per = per.join(F.broadcast(cold), "block")
    maps = grouped(per, clamps, "block long, a double, lo double, hi double")
    per = per.join(F.broadcast(carried(maps, least, "rate", lambda s, x: F.least(F.greatest(x.a * s, x.lo), x.hi))), "block")
    return grouped(per, rates, "tick long, rate double")


def every_kth(traces: DataFrame, rates: DataFrame, tick_ms: int = 1000) -> DataFrame:
    """Of the traces of each tick of ``rates`` (tick, rate) every round(1/rate)-th by arrival."""
    w = Window.partitionBy("tick").orderBy("first_ms", "trace_id")
    t = traces.withColumn("tick", F.floor(F.col("first_ms") / tick_ms)).join(rates, "tick").withColumn("k", F.row_number().over(w))
    every = F.greatest(F.floor(1 / F.col("rate") + 0.5), F.lit(1))
    return t.filter(F.col("k") % every == 0).select(traces.columns)


def adaptive_limit(traces: DataFrame, target_tps: float, least: float = 0.01, most: float = 1.0, alpha: float = 0.3, tick_ms: int = 1000) -> DataFrame:
    """Traces that pass: critical ones (error, latency) go by and are never counted; of the others every round(1/rate)-th
    of each tick by arrival."""
    critical = F.col("reason").isin(*CRITICAL)
    offered = traces.filter(~critical)
    return traces.filter(critical).unionByName(every_kth(offered, adaptive_rates(offered, target_tps, least, most, alpha, tick_ms), tick_ms))


#: Lists of first values that are sent to all tasks at most; beyond it they are joined by an exchange.
SENT = 1000
#: Places over which the attributes of one service and key are dealt.
SALTS = 32


def limit_cardinality(df: DataFrame, bag: str, arrival: list[str], limit: int = 200, service: str = "service_name", types: str | None = None, sent: int = SENT) -> DataFrame:
    """Attribute bags in which, by service and key, the first ``limit`` distinct values stay and later ones become
    a marker.  types: a map from keys to value types, of which only ``string`` is limited.

    First arrivals are minima per value (partial before the shuffle); only keys with more values than the limit are looked
    at again.  If there are at most ``sent`` of them, their first values (``limit`` each) are sent to all tasks; else the attributes
    that use one are joined with its first values by service and key, and rows with the keys that are over in them.
    """
    of_string = (lambda d: d.filter(F.try_element_at(F.col(types), F.col("_k")) == "string")) if types else (lambda d: d)
    more = [types] if types else []
    each = of_string(df.select(service, F.struct(*arrival).alias("_at"), F.explode(bag).alias("_k", "_v"), *more))
    values = each.groupBy(service, "_k", "_v").agg(F.min("_at").alias("_at"))
    rank = F.row_number().over(Window.partitionBy(service, "_k").orderBy("_at", "_v"))
    ranked = values.withColumn("_r", rank).filter(F.col("_r") <= limit + 1)
    first = F.collect_list(F.when(F.col("_r") <= limit, F.col("_v"))).alias("_first")
    full = cut(ranked.groupBy(service, "_k").agg(F.max("_r").alias("_n"), first).filter(F.col("_n") > limit).drop("_n"))
    if full.limit(sent + 1).count() <= sent:
        allowed = full.groupBy(service).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_first"))).alias("_allowed"))
        typed = (lambda k: F.try_element_at(F.col(types), k) == "string") if types else (lambda k: F.lit(True))
        over = lambda k, v: F.coalesce(typed(k) & ~F.array_contains(F.try_element_at("_allowed", k), v), F.lit(False))
        new = F.transform_values(bag, lambda k, v: F.when(over(k, v), F.lit(HIGH_CARDINALITY)).otherwise(v))
        joined = df.join(F.broadcast(allowed), service, "left")
        return joined.withColumn(bag, F.when(F.col("_allowed").isNull(), F.col(bag)).otherwise(new)).select(df.columns)
    # rows are told apart by service, arrival and bag: what these are equal in has equal keys over
    row = {"_row": F.struct(service, *arrival, F.array_sort(F.map_entries(bag)).alias("_bag"))}
    rows = df.withColumns(row)
    salt = F.pmod(F.xxhash64(*arrival), F.lit(SALTS)).cast("int")
    pieces = of_string(rows.select(service, "_row", salt.alias("_salt"), F.explode(bag).alias("_k", "_v"), *more))
    lists = full.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    over = pieces.join(lists, [service, "_k", "_salt"]).filter(~F.array_contains("_first", F.col("_v")))
    over = over.groupBy("_row").agg(F.collect_set("_k").alias("_over"))
    new = F.transform_values(bag, lambda k, v: F.when(F.array_contains("_over", k), F.lit(HIGH_CARDINALITY)).otherwise(v))
    joined = rows.join(over, "_row", "left")
    return joined.withColumn(bag, F.when(F.col("_over").isNull(), F.col(bag)).otherwise(new)).select(df.columns)


def trace_seconds(spans: DataFrame) -> DataFrame:
    """Traces offered in each second of arrival."""
    return trace_facts(spans).groupBy(F.floor(F.col("first_ms") / 1000).alias("second")).agg(F.count("*").alias("n")).withColumn("at_nano", F.col("second") * NANO)
