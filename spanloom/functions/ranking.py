"""Places in an order, and what rests on them, with no group in one task: range partitions and an offset for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.plans.tables import cut


#: Points of a block of first_within().
BLOCK = 16


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined with right on columns of one name, null equal to null."""
    names = {c: f"_right_{c}" for c in on}
    right = right.withColumnsRenamed(names)
    test = F.lit(True)
    for c, r in names.items():
        test &= F.col(c).eqNullSafe(F.col(r))
    return left.join(right, test).drop(*names.values())


def count_before(df: DataFrame, group: list[str], order: list[str | Column], counted: Column | None = None, name: str = "rank") -> DataFrame:
    """df with the number of (``counted``) rows of the same group that come before each row; nulls first.

    Rows are sorted over range partitions; a partition needs only the counts of those before it, one row for each partition of a
    group.  So a group with half of all rows is many tasks.  Rows equal in group and order share a partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c.asc_nulls_first() if isinstance(c, Column) else F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = cut(placed.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id(), "_c": F.lit(1) if counted is None else counted.cast("int")}))
    own = [*group, "_part"]
    counts = placed.groupBy(*own).agg(F.sum("_c").alias("_n"), F.min("_at").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    out = _same(placed, counts.withColumn("_earlier", F.coalesce(earlier, F.lit(0))).drop("_n"), own)
    if counted is None:
        inside = F.col("_at") - F.col("_first")
    else:
        inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*own).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn(name, F.col("_earlier") + inside).drop("_at", "_part", "_c", "_first", "_earlier")


def first_within(ranges: DataFrame, points: DataFrame, on: str, time: str, ties: list[str], most: int) -> DataFrame:
    """Each range (``on, range_from, range_to`` and columns of its own) with the first ``most`` points of its ``on`` whose time is in
    it, by time and ``ties``; with ``position`` from 1.  Ranges without points, and nulls in ``on`` or the bounds, give no rows.

    Points and the beginnings of ranges are sorted together, so a range knows how many points lie before it, and takes the
    ``most`` from there.  Points come in blocks of BLOCK in that order: a range meets the few blocks that can hold its points, and opens
    those that begin before its end.  So what it makes is at most ``most`` rows, however many points lie within it.
    """
    own = [c for c in ranges.columns if c not in (on, "range_from", "range_to")]
    theirs = [c for c in points.columns if c != on]
    a = ranges.filter(F.col(on).isNotNull() & (F.col("range_from") <= F.col("range_to"))).select(on, F.col("range_from").alias("_time"), F.lit(0).alias("_kind"), F.struct("range_to", *own).alias("_range"))
    b = points.filter(F.col(on).isNotNull() & F.col(time).isNotNull()).select(on, F.col(time).alias("_time"), F.lit(1).alias("_kind"), F.struct(*theirs).alias("_point"))
    both = a.unionByName(b, allowMissingColumns=True)
    both = count_before(both, [on], ["_time", "_kind", *[F.col(f"_point.{c}") for c in ties]], F.col("_kind") == 1, "_rank")
    block = F.floor(F.col("_rank") / BLOCK)
    last = F.floor((F.col("_rank") + (most - 1)) / BLOCK)
    starts = both.filter("_kind = 0").select(on, F.col("_rank").alias("_start"), "_range", F.explode(F.sequence(block, last)).alias("_block"))
    blocks = both.filter("_kind = 1").groupBy(on, block.alias("_block")).agg(F.min("_time").alias("_first"), F.collect_list(F.struct("_rank", "_time", "_point")).alias("_points"))
    met = starts.join(blocks, [on, "_block"]).filter(F.col("_first") <= F.col("_range.range_to")).withColumn("_p", F.explode("_points"))
    met = met.filter(F.col("_p._rank").between(F.col("_start"), F.col("_start") + (most - 1)) & (F.col("_p._time") <= F.col("_range.range_to")))
    return met.select(on, *[F.col(f"_range.{c}") for c in own], *[F.col(f"_p._point.{c}") for c in theirs], (F.col("_p._rank") - F.col("_start") + 1).cast("int").alias("position"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], most: int = 1_000_000) -> DataFrame:
    """``keys`` and a column for each share: the percentiles that Spark's percentile() gives, linear between ranks.

    percentile() holds all values of a group in one task.  Groups of more than ``most`` values are ranked over range
    partitions instead, and only the rows whose ranks are asked for are looked at again.  Null values don't count; a group
    of nulls has null percentiles.
    """
    named = df.withColumnRenamed(value, "_v") if value != "_v" else df
    sizes = cut(named.groupBy(*keys).agg(F.count("_v").alias("_n")))
    large = sizes.filter(F.col("_n") > most)
    plain = lambda d: d.groupBy(*keys).agg(*[F.percentile("_v", F.lit(p)).alias(c) for c, p in shares.items()])
    if large.isEmpty():
        return plain(named)
    test = F.lit(True)
    for k in keys:
        test &= F.col(f"a.{k}").eqNullSafe(F.col(f"l.{k}"))
    # the large groups are at most a row for each ``most`` rows of the input
    small = named.alias("a").join(F.broadcast(large).alias("l"), test, "left_anti")
    hot = named.alias("a").join(F.broadcast(large).alias("l"), test).filter("_v is not null").select(*[F.col(f"a.{k}") for k in keys], "_v", "_n")
    hot = count_before(hot, keys, ["_v"])
    at = {c: (F.col("_n") - 1) * p for c, p in shares.items()}
    wanted = F.lit(False)
    for x in at.values():
        wanted |= F.col("rank").isin(F.floor(x), F.ceil(x))
    ends = lambda c, f: F.max(F.when(F.col("rank") == f(at[c]), F.col("_v").cast("double")))
    ranked = hot.filter(wanted).groupBy(*keys).agg(*[e for c, p in shares.items() for e in (ends(c, F.floor).alias(f"_lo_{c}"), ends(c, F.ceil).alias(f"_hi_{c}"), F.max(at[c] - F.floor(at[c])).alias(f"_x_{c}"))])
    # as percentile() does: (1 - x) * lower + x * higher
    between = lambda c: F.when(F.col(f"_lo_{c}") == F.col(f"_hi_{c}"), F.col(f"_lo_{c}")).otherwise((1 - F.col(f"_x_{c}")) * F.col(f"_lo_{c}") + F.col(f"_x_{c}") * F.col(f"_hi_{c}"))
    return plain(small).unionByName(ranked.select(*keys, *[between(c).alias(c) for c in shares]))
