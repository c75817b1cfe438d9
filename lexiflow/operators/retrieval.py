"""BM25 as one query, similarities, coarse-to-fine search, reranking. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1 (a window group limit prunes before the shuffle)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def bm25(docs: DataFrame, queries: DataFrame, key: str, query_key: str, doc_tokens: Column, query_tokens: Column, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """query key, key, score of every pair with a common term; a query's repeated term counts as often.

    Terms of negative idf get ``floor`` times the mean idf of the vocabulary. Only postings of query terms meet
    documents; statistics come as one-row tables, never through the driver.
    """
    d = docs.select(key, doc_tokens.alias("tokens")).withColumn("dl", F.size("tokens"))
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # Document frequencies sum per term before their shuffle; (document, term) pairs exist for query terms only.
    df = d.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    idf = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("idf")))
    asked = queries.select(query_key, F.explode(query_tokens).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    weights = asked.select("term").distinct().join(idf.select("term", "idf", "avgdl"), "term")
    tf = d.select(key, "dl", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term").groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(weights, "term").select(key, "term", part.alias("part"))
    return scored.join(asked, "term").groupBy(query_key, key).agg(F.sum(F.col("qtf") * F.col("part")).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, eps: float = 1e-12) -> Column:
    norm = lambda u: F.greatest(F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(eps))
    return bind(v, lambda u: bind(norm(u), lambda n: F.transform(u, lambda x: x.cast("double") / n)))


def similarity(a: Column, b: Column, metric: str) -> Column:
    if metric == "l2":
        return -F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return dot(unit(a), unit(b)) if metric == "cosine" else dot(a, b)


def merge_variants(hits: DataFrame, how: str = "votes") -> DataFrame:
    """Hits of several query variants (q, variant, id, score) as one list per query: by votes, then best score; or by
    best score; or by the first variant's score."""
    if how == "first":
        return hits.groupBy("q", "id").agg(F.count("*").alias("votes"), F.min_by("score", "variant").alias("score"))
    return hits.groupBy("q", "id").agg(F.count("*").alias("votes"), F.max("score").alias("score"))


def coarse_sections(hits: DataFrame, k: int) -> DataFrame:
    """q, section of the k sections with the best hit; hits (q, section, score)."""
    best = hits.groupBy("q", "section").agg(F.max("score").alias("score"))
    return top_k(best, ["q"], [F.desc("score"), F.asc("section")], k).select("q", "section")


def rerank_head(hits: DataFrame, score: Column, head: int) -> DataFrame:
    """Hits (q, id, rank) with their first ``head`` ranks sorted anew by ``score``; the tail keeps its order."""
    order = Window.partitionBy("q").orderBy(F.col("rank") > head, F.when(F.col("rank") <= head, -F.col("rerank")).otherwise(F.col("rank").cast("double")), F.col("id"))
    return hits.withColumn("rerank", score).withColumn("new_rank", F.row_number().over(order))
