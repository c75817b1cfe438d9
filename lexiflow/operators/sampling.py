"""Deduplication and seeded sampling: order by a hash, never by a random column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, by: list[Column], order: list[Column], cap: int = 1) -> DataFrame:
    """At most ``cap`` rows of each group, in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def dedup_title_or_text(df: DataFrame, title: Column, text: Column, order: str) -> DataFrame:
    """Rows whose title and text both were not seen in a row kept before (an ordered scan).

    Null titles are no titles and match nothing; null texts are one text. Rows of one place in the order go by title,
    text and their other columns; of wholly equal rows one stays.

    Each round keeps the rows that are the first undecided ones of both their title and their text, and drops those
    that share either with them: what the scan decides, for all chains at once. Only keys take part, as minima per
    title and text, and each round is written; rows meet the outcome once.
    """
    from ..shared import delete, written

    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.withColumn("_k", F.struct(F.col(order).alias("o"), title.alias("t"), F.coalesce(text, F.lit("")).alias("x"), F.xxhash64(F.to_json(own)).alias("h")))
    left, path = written(rows.select("_k", F.col("_k.t").alias("_t"), F.col("_k.x").alias("_x")).distinct(), "dedup-keys")
    kept, paths = None, [path]
    while not left.isEmpty():
        first_t = left.filter("_t is not null").groupBy("_t").agg(F.min("_k").alias("_a"))
        first_x = left.groupBy("_x").agg(F.min("_k").alias("_b"))
        now = left.join(first_x, "_x").filter("_k = _b").join(first_t, "_t", "left").filter("_t is null or _k = _a").select("_k", "_t", "_x")
        now, path = written(now, "dedup-kept")
        kept = now if kept is None else kept.unionByName(now)
        rest = left.join(now.select("_t"), "_t", "left_anti").join(now.select("_x"), "_x", "left_anti")
        before, (left, paths_left) = paths[-1], written(rest, "dedup-keys")
        paths += [path, paths_left]
        delete(df.sparkSession, before)
    if kept is None:
        return df
    out = rows.join(kept.select("_k"), "_k", "left_semi")
    return out.dropDuplicates(["_k"]).select(*[F.col(f"`{c}`") for c in df.columns])


def hash_order(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))


def stratified_split(df: DataFrame, by: str, key: str, share: float, seed: str = "") -> DataFrame:
    """``split``: train for this share of each stratum in hash order, else val."""
    place = F.percent_rank().over(Window.partitionBy(by).orderBy(hash_order(key, seed), key))
    return df.withColumn("split", F.when(place < share, "train").otherwise("val"))


def balanced_sample(df: DataFrame, by: str, key: str, target: int, seed: str = "") -> DataFrame:
    """``target // classes`` rows of each class, the remainder from the largest classes, in hash order."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_size"))
    n = sizes.agg(F.count("*").alias("_k"))
    rank = F.row_number().over(Window.orderBy(F.desc("_size"), by))  # one row per class
    quota = sizes.crossJoin(F.broadcast(n)).withColumn("_quota", F.floor(F.lit(target) / F.col("_k")) + (rank <= F.lit(target) % F.col("_k")).cast("long"))
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(hash_order(key, seed), key)))
    return ranked.join(F.broadcast(quota.select(by, "_quota")), by).filter("_n <= _quota").drop("_n", "_quota")


def sample_of(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """``n`` rows, the first in the order of their key's seeded hash, then key: the same under any partitioning. Each
    task keeps its own first ``n``, so nothing is sorted whole. Null keys come first in the order of hashes of nulls."""
    return df.orderBy(F.coalesce(hash_order(key, seed), F.lit("")), key).limit(n)


def merge_samples(held: DataFrame | None, fresh: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """The sample of all rows seen, from the sample held and what is new: samples merge, so a stream keeps one as a
    table of ``n`` rows, replaced batch by batch."""
    return sample_of(fresh if held is None else held.unionByName(fresh), key, n, seed)


def few_shot(examples: DataFrame, pool: DataFrame, k: int, key: str, subject: str, text: str) -> DataFrame:
    """For each example, k others that do not leak it (other id and other text): those of its subject in id order,
    then, where they are fewer, those of other subjects in id order. Ids of the pool are unique.

    An example leaves out one subject, one text and one id, so a few rows of the pool serve as others for all: a row
    with more than k + 1 rows before it of its subject and text, or twice as many of either, is not among the first.
    """
    e = examples.select(F.col(key).alias("example"), F.col(subject).alias("_s"), F.col(text).alias("_x"))
    p = pool.select(F.col(key).alias("shot"), F.col(subject).alias("_t"), F.col(text).alias("_y"))
    apart = (F.col("example") != F.col("shot")) & ~F.col("_x").eqNullSafe(F.col("_y"))
    order = [F.col("shot")]
    # Of a subject, the same bound holds: an example leaves out one text and one id.
    near = first_of(first_of(p, [F.col("_t"), F.col("_y")], order, k + 1), [F.col("_t")], order, 2 * k + 2)
    same = e.join(near, F.col("_s").eqNullSafe(F.col("_t")) & apart).select("example", "shot")
    same = first_of(same, [F.col("example")], [F.col("shot")], k)
    few = same.groupBy("example").agg(F.count("*").alias("_have"))
    few = e.join(few, "example", "left").filter(F.coalesce("_have", F.lit(0)) < k)
    head = first_of(p, [F.col("_t"), F.col("_y")], order, k + 1)
    head = first_of(first_of(head, [F.col("_t")], order, 2 * k + 2), [F.col("_y")], order, 2 * k + 2).orderBy("shot").limit(5 * k + 5)
    others = few.join(F.broadcast(head), ~F.col("_s").eqNullSafe(F.col("_t")) & apart).select("example", "shot")
    met = same.withColumn("_o", F.lit(0)).unionByName(others.withColumn("_o", F.lit(1)))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("example").orderBy("_o", "shot"))).filter(F.col("rank") <= k).select("example", "shot", "rank")
