"""A corpus preparation pipeline: each stage is a Spark job over the table that the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import pii
from spanloom.llm.decontaminate import without_contaminated
from spanloom.llm.mixing import mix
from spanloom.llm.ngram_join import ngram_jaccard_join
from spanloom.llm.quality_rules import keep_good
from spanloom.plans.tables import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go; null and empty texts are too short and go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by sets of five words and similarity 0.8 one row stays: that with the least id (null last), of
    equal ids the first.  Where ids repeat or are null, rows are told apart by a number, so these are rows like others;
    texts without words are linked with nothing and stay."""
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        linked = ngram_jaccard_join(docs, n=5, percent=80)
        gone = linked.filter("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    linked = ngram_jaccard_join(rows, n=5, percent=80, key=row).select(row, "component_id")
    several = linked.filter(F.col("component_id") != F.col(row)).select("component_id").distinct()
    members = linked.join(several, "component_id", "left_semi").join(rows.select(row, F.col("doc_id").alias("_id")), row)
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col(row).alias("at")))
    stays = members.groupBy("component_id").agg(least["at"].alias("at"))
    gone = members.join(stays, "component_id").filter(F.col(row) != F.col("at")).select(row)
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy or an edited copy of a test item go; null texts hold none and stay."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; all rows stay, null texts as they are."""
    return pii.masked(docs, spark.createDataFrame(pii.labelled_rows(), "text string, start int, end int"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each row: a null text has none, a null source is a source."""
    return mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("mixing", mixing),
]

#: The learned rules, the alignment and the random field are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
