"""Prediction files: rows numbered by line, ids and correctness filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "example_id string, gold_answer string, predicted_answer string, is_correct boolean, question string"


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """``df`` with its rows' numbers from 1, in the order of its partitions.

    Only the partitions' sizes, one row each, are summed in one task; rows stay where they are. ``df`` must give the
    same partitions each time it is read, as files and written tables do.
    """
    held = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(sizes.select("_part", "_first", before.alias("_before")), "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_n", "_first", "_before")


def normalised(rows: DataFrame, told: str = "is_correct") -> DataFrame:
    """Rows with row_id, example_id, gold, pred and whether they were told to be correct: a missing id is row_N, a
    missing verdict is whether both answers are there and equal."""
    named = F.when(F.trim("example_id") != "", F.trim("example_id"))
    verdict = F.coalesce(F.col(told), F.col("gold") == F.col("pred"), F.lit(False))
    return rows.withColumn("example_id", F.coalesce(named, F.concat(F.lit("row_"), F.col("row_id").cast("string")))).withColumn("is_correct", verdict)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """row_id (line number), example_id, gold, pred, is_correct, question of the lines of a file; blank lines go, but
    count."""
    lines = numbered(spark.read.text(path).withColumnRenamed("value", "line"))
    rows = lines.filter(F.trim("line") != "").select("row_id", F.from_json("line", SCHEMA).alias("r"))
    return normalised(rows.select("row_id", "r.example_id", F.col("r.gold_answer").alias("gold"), F.col("r.predicted_answer").alias("pred"), "r.is_correct", F.coalesce("r.question", F.lit("")).alias("question")))
