"""Readers and writers: JSON lines, labelled sets, whole documents, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "text string, label string, tier string, expected_label string, strategy string, source string"


def read_jsonl(spark: SparkSession, path: str, schema: str = LABELLED) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def label_of() -> Column:
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(blank("expected_label"), blank("label"), blank("tier"))


def read_labelled(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """text and label of the rows that have both; distinct reads a text that several files share once."""
    d = read_jsonl(spark, path).select("text", label_of().alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    return d.dropDuplicates(["text"]) if distinct else d


def seeds_by_label(df: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One row for each label, also for those without texts; unknown labels are dropped."""
    every = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    own = df.filter(F.col("label").isin(*labels)).groupBy("label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("text")).alias("texts"))
    return every.join(own, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: of equal keys, the row of the highest version; of equal versions the new one, then the greatest.

    max_by is summed before the shuffle, so a key with many versions costs one row per task.
    """
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*old.columns)
    return every.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(F.col(version), F.col("_new"), row)).alias("_row")).select("_row.*")
