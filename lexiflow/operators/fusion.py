"""Fusion, rescoring, gates and evidence packing over hit lists (q, id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (q, source, id, rank from 1): score and votes."""
    return lists.groupBy("q", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.count("*").alias("votes"))


def minmax(c: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (c - low) / (high - low)).otherwise(0.0)


def rescore(hits: DataFrame, parts: list[tuple[Column, float]]) -> DataFrame:
    """``final``: the weighted mean of the parts."""
    total = sum(w for _, w in parts)
    value = F.lit(0.0)
    for c, w in parts:
        value = value + c * w
    return hits.withColumn("final", value / total)


def gate(hits: DataFrame, value: Column, least: float) -> DataFrame:
    """Lists whose first hit (rank 1) has ``value`` of at least ``least``; other lists go whole."""
    first = F.first(value).over(Window.partitionBy("q").orderBy("rank"))
    return hits.withColumn("gate", first).filter(F.col("gate") >= least).drop("gate")


def best_of(hits: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def pack_prefix(hits: DataFrame, tokens: str, budget: int) -> DataFrame:
    """Hits up to the first that would pass the budget."""
    used = F.sum(tokens).over(Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", used).filter(F.col("used") <= budget)


def pack_fold(hits: DataFrame, tokens: str, budget: int, truncate_over: int | None = None) -> DataFrame:
    """q, kept (array of id, tokens), used: skips what does not fit and tries on; with ``truncate_over``, the first
    that does not fit is cut to the rest of the budget, if that is more than so many tokens, and ends the list.

    The fold runs over one query's list, which top-k bounds."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("id"), F.col(tokens).cast("long").alias("tokens"))))
    start = F.struct(F.array().cast("array<struct<id:bigint,tokens:bigint>>").alias("kept"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        take = lambda n: F.struct(F.concat(acc["kept"], F.array(F.struct(x["id"].cast("long").alias("id"), n.alias("tokens")))).alias("kept"), (acc["used"] + n).alias("used"), acc["over"].alias("over"))
        fits = acc["used"] + x["tokens"] <= budget
        if truncate_over is None:
            return F.when(fits, take(x["tokens"])).otherwise(acc)
        rest = F.lit(budget).cast("long") - acc["used"]
        cut = F.when(rest > truncate_over, take(rest)).otherwise(acc)
        closed = lambda s: F.struct(s["kept"].alias("kept"), s["used"].alias("used"), F.lit(True).alias("over"))
        return F.when(acc["over"], acc).when(fits, take(x["tokens"])).otherwise(closed(cut))

    return hits.groupBy("q").agg(rows.alias("rows")).select("q", F.aggregate("rows", start, step).alias("p")).select("q", "p.kept", "p.used")


def first_seen(hits: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in order: hits of one document keep their first place."""
    return best_of(hits, by, order)


def first_match(left: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """``left`` with the columns of the first matching row by ``order``; rows are cut to one a key before the join."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c != key]), order).alias("_r"))
    return left.join(first.select(key, "_r.*"), key, "left")
