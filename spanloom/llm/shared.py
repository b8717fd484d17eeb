"""What several operators need: written tables that cut lineage, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.tables import cut


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on columns of one name, null equal to null; they stand once, as left's."""
    names = {c: f"_right_{c}" for c in on}
    right = right.withColumnsRenamed(names)
    test = F.lit(True)
    for c, r in names.items():
        test &= F.col(c).eqNullSafe(F.col(r))
    return left.join(right, test, how).drop(*names.values())


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which whoever runs it sizes with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a long, b long): the least node it is connected to.

    Large-star and small-star rounds in turn (Kiveris et al., 2014) until nothing changes: each
    links the neighbours of a node to their least one, so the edges never become more.  All
    steps are partial minima and joins; a hub with very many neighbours is one row of the
    minima's side, whose skewed partition Spark splits.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        before = _sum(edges)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = cut(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        if _sum(edges) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _sum(edges: DataFrame) -> tuple:
    """The edges in a few numbers: equal before and after a round when it changed nothing."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.sum(F.col("v").cast("decimal(38,0)"))).first())
