"""Mixing sources to target weights by Sainte-Lague apportionment (operator 9).

Targets come from the weights by water filling, capped at a multiple of each source's size.
The total becomes a number of equal-token blocks, which sources get by highest
quotients target/1, target/3, target/5 ...; a source's blocks go to its shards in the same
way by their sizes.  In a shard, whole passes come first; the rest is taken block by block
from its documents in a seeded order.  Shards hold a bounded number of documents on average, so a
source with a third of all rows is many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import cut, join_same


def sainte_lague(rows: DataFrame, group: list[str], unit: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """rows with the seats of each unit of a group, by highest quotients weight/(2k+1), ties by unit.
    seats: the group's number, equal in its rows.  The divisor is found by bisection over the
    group's weights; the few seats that ties leave go to the next quotients."""
    units = rows.groupBy(*group).agg(F.collect_list(F.col(weight).cast("double")).alias("_w"), F.max(seats).cast("double").alias("_q"))
    given = lambda d: F.aggregate("_w", F.lit(0.0), lambda a, w: a + F.floor(w / d + 0.5).cast("double"))
    total = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w)
    start = F.struct(F.lit(0.0).alias("lo"), (2 * total + 1).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s.lo + s.hi) / 2
        more = F.when(middle > 0, given(middle)).otherwise(F.lit(float("inf"))) > F.col("_q")
        return F.struct(F.when(more, middle).otherwise(s.lo).alias("lo"), F.when(more, s.hi).otherwise(middle).alias("hi"))

    divisor = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, halve).hi
    units = units.select(*group, divisor.alias("_d"), "_q")
    joined = join_same(rows, units, group).withColumn("_a", F.floor(F.col(weight) / F.col("_d") + 0.5))
    whole = Window.partitionBy(*group)
    order = whole.orderBy((F.col(weight) / (2 * F.col("_a") + 1)).desc(), *[F.col(u).asc_nulls_last() for u in unit])
    left = F.col("_q") - F.sum("_a").over(whole)
    return joined.withColumn(out, (F.col("_a") + F.when((F.row_number().over(order) <= left) & (F.col(weight) > 0), 1).otherwise(0)).cast("long")).drop("_d", "_q", "_a")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``source, source_size, n, target``: sources by code point, null last, weigh ``weights`` in turn;
    what goes beyond ``cap`` times a source's size is shared anew by weight.  That is a level: every
    target is the lesser of its cap and weight times level, and all add up to the share."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))
    df = sources.withColumn("w", w).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.sum("most").over(by) - F.col("most")
    after = F.sum("w").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.sum("w").over(by) + F.col("w")
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("level", (share * total - before) / after)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("at", level["level"]).select("source", "source_size", "n", F.coalesce(F.least("most", F.col("w") * F.col("at")), F.col("most")).cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 64, shard_docs: int = 4000, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, size long, source_size long, target double, taken long`` for each row of docs.

    size: words of the text, 0 for null; taken: words that the mix takes of it, repeats counted, at
    most ``cap`` times its size (rounded down to whole passes where cap isn't whole).  A null source is
    a source.  Repeated rows are rows of their own; rows with equal keys and sizes differ in nothing
    that could order them, so they are numbered, and which of them has which number doesn't matter.  Equal quotients go to the
    unit that comes first.  Empty tables give no rows; with no words nothing is taken.  A text of any length is
    counted whole and may be taken in part.  Other columns are not read.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"))
    # equal rows are told apart by a number, so that those of one key, or of none, are dealt like others
    rows = rows.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    sizes = cut(rows.select("key", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sources, weights, share, cap)
    blocks = F.round(F.sum("target").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / block)
    plan = cut(sainte_lague(plan.withColumn("all", blocks).withColumn("one", F.lit(1)), ["one"], ["source"], "target", "all", "blocks"))
    near = join_same(sizes, plan.select("source", "source_size", "target", "blocks", "n"), ["source"])
    near = near.withColumn("shard", F.pmod(F.xxhash64("key", "size", "copy", F.lit(seed)), F.ceil(F.col("n") / shard_docs)))
    shards = near.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    quotas = cut(sainte_lague(shards, ["source"], ["shard"], "shard_size", "blocks", "quota").select("source", "shard", "shard_size", "quota"))
    both = join_same(near, quotas, ["source", "shard"]).withColumn("due", F.col("quota") * block)
    most = int(cap)
    passes = F.least(F.lit(most), F.coalesce(F.floor(F.try_divide("due", "shard_size")), F.lit(0)))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("key", "size", "copy", F.lit(seed + 1)), "key", "size", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("passes", passes).withColumn("before", F.sum("size").over(order) - F.col("size"))
    open_ = F.greatest(F.col("due") - F.col("passes") * F.col("shard_size") - F.col("before"), F.lit(0))
    rest = F.when(F.col("passes") < most, F.least("size", F.ceil(open_ / block) * block)).otherwise(0)
    return both.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("passes") * F.col("size") + rest).cast("long").alias("taken"))
