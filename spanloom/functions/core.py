"""Column helpers that the operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NANO = 1_000_000_000
#: Seconds of each rollup tier.
TIERS = {"1m": 60, "5m": 300, "1h": 3600}
HOUR_MS = 3_600_000


def bucket(ns: Column | str, seconds: int) -> Column:
    """Start of the bucket, in nanoseconds, that a time in nanoseconds falls in."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    return ns - F.pmod(ns, F.lit(seconds * NANO))


def choose_tier(from_ms: int | None, to_ms: int | None) -> str:
    """Rollup for a range: up to 3 hours 1m, up to 24 hours 5m, else 1h; 1m when a bound is missing or not positive."""
    if not from_ms or not to_ms or min(from_ms, to_ms) < 0 or to_ms - from_ms <= 3 * HOUR_MS:
        return "1m"
    return "5m" if to_ms - from_ms <= 24 * HOUR_MS else "1h"


def choose_error_tier(from_ms: int | None, to_ms: int | None) -> str:
    """Rollup of error logs: 1h from 24 hours on, else 1m."""
    return "1h" if from_ms and to_ms and min(from_ms, to_ms) > 0 and to_ms - from_ms >= 24 * HOUR_MS else "1m"


def buckets_between(column: str, from_ms: int | None, to_ms: int | None) -> Column:
    """Bucket starts between two bounds in whole seconds: the first partial bucket is out, the last one whole."""
    out = F.lit(True)
    if from_ms is not None:
        out &= F.col(column) >= from_ms // 1000 * NANO
    if to_ms is not None:
        out &= F.col(column) <= to_ms // 1000 * NANO
    return out


def nanos_between(column: str, from_ms: int | None, to_ms: int | None) -> Column:
    out = F.lit(True)
    if from_ms is not None:
        out &= F.col(column) >= from_ms * 1_000_000
    if to_ms is not None:
        out &= F.col(column) <= to_ms * 1_000_000
    return out


def at_between(df: DataFrame, column: str, from_ms: int | None, to_ms: int | None) -> DataFrame:
    """Rows whose time in milliseconds is in a range, bounds included."""
    return df.filter(millis_between(column, from_ms, to_ms))


def millis_between(column: str, from_ms: int | None, to_ms: int | None) -> Column:
    out = F.lit(True)
    if from_ms is not None:
        out &= F.col(column) >= from_ms
    if to_ms is not None:
        out &= F.col(column) <= to_ms
    return out


def received_between(df: DataFrame, from_ms: int | None, to_ms: int | None) -> DataFrame:
    """Rows received in a range; where the table is partitioned by receive date, the partitions that it implies."""
    if "dt" in df.columns:
        day = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
        if from_ms is not None:
            df = df.filter(F.col("dt") >= day(from_ms))
        if to_ms is not None:
            df = df.filter(F.col("dt") <= day(to_ms))
    return df.filter(millis_between("received_at_ms", from_ms, to_ms))


def equals(df: DataFrame, **values: object) -> DataFrame:
    """Rows in which each column has its value; empty and missing values don't filter."""
    for name, value in values.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == value)
    return df


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """One page in the given order, which must end in a unique key."""
    if limit is None:
        return df
    df = df.orderBy(*order)
    return (df.offset(offset) if offset else df).limit(limit)


def severity_label(n: Column) -> Column:
    out = F.when(n <= 0, "UNSPECIFIED")
    for most, name in ((4, "TRACE"), (8, "DEBUG"), (12, "INFO"), (16, "WARN"), (20, "ERROR")):
        out = out.when(n <= most, name)
    return out.otherwise("FATAL")


def attribute(bag: str, key: str) -> Column:
    """An attribute, '' where it is missing."""
    return F.coalesce(F.try_element_at(F.col(bag), F.lit(key)), F.lit(""))


def leading_uint16(text: Column) -> Column:
    """The integer that a text begins with, wrapped to 16 bits; 0 where there is none."""
    n = F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1)
    return F.when(n == "", 0).otherwise(F.pmod(F.when(n == "", "0").otherwise(n).cast("long"), F.lit(65536))).cast("int")


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for a path glob (``*`` and ``?`` stop at a slash); None for a bad pattern, which matches nothing."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            j = pattern.find("]", i + 2)
            if j < 0:
                return None
            inner = pattern[i + 1 : j]
            out += "[" + inner.replace("\\\\", "\\").replace("[", "\\[") + "]"
            i = j
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"


def matches_glob(column: Column, pattern: str) -> Column:
    regex = glob_regex(pattern)
    return F.lit(False) if regex is None else column.rlike(regex)


def histogram_percentiles(df: DataFrame, percents: dict[str, float], counts: str = "bucket_counts", bounds: str = "bounds") -> DataFrame:
    """df with percentiles of its explicit-bucket histograms: linear inside the bucket in which the cumulative
    count reaches the target; 0 without counts; the last bound for the overflow bucket."""
    up_to = F.transform(counts, lambda c, i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0.0), lambda a, x: a + x.cast("double")))
    df = df.withColumn("_up_to", F.coalesce(up_to, F.array().cast("array<double>")))
    total = F.coalesce(F.get("_up_to", F.size("_up_to") - 1), F.lit(0.0))

    def value(p: float) -> Column:
        target = total * p / 100
        at = F.size(F.filter("_up_to", lambda x: x < target))
        before = F.when(at == 0, 0.0).otherwise(F.get("_up_to", at - 1))
        count, upper = F.get("_up_to", at) - before, F.get(bounds, at)
        lower = F.when(at == 0, 0.0).otherwise(F.get(bounds, at - 1))
        inside = F.when(count == 0, upper).otherwise(lower + (upper - lower) * (target - before) / count)
        some = F.when(at >= F.size(bounds), F.get(bounds, F.size(bounds) - 1)).otherwise(inside)
        return F.when((F.coalesce(F.size(bounds), F.lit(0)) <= 0) | (total == 0), 0.0).otherwise(some)

    return df.withColumns({name: value(p) for name, p in percents.items()}).drop("_up_to")


def latest(df: DataFrame, keys: list[str], *version: Column) -> DataFrame:
    """The newest version of each entity: the first row of its key in the order of ``version`` descending."""
    w = Window.partitionBy(*keys).orderBy(*[v.desc() for v in version])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
