"""Steps that once grew faster than their input."""

import math
import time

import pytest
from pyspark.sql import functions as F

from lexiflow.functions.text import whitespace_tokens
from lexiflow.operators import analytics, index, retrieval


def test_a_tail_of_a_million_pairs():
    exact = lambda n, k: min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    for n, k in ((0, 0), (1, 0), (2, 1), (9, 2), (40, 20), (1001, 480), (3000, 0), (3000, 1440)):
        assert math.isclose(analytics.binomial_tail(n, k), exact(n, k), rel_tol=1e-9, abs_tol=1e-300)
    began = time.time()
    assert abs(analytics.binomial_tail(1_000_000, 499_000) - 0.045608) < 1e-5  # normal tail with continuity: z = 1.999
    assert analytics.binomial_tail(2_000_000, 500) == 0.0 and time.time() - began < 2


def test_a_build_shuffles_no_posting_and_a_search_only_rows_of_shards(spark, tmp_path):
    """Every text shares words; the best, whole and by group, are those of all scores, deleted documents aside."""
    rows = [(i, f"all of {i % 7} these w{i % 13} words " * (1 + i % 3), f"s{i % 4}" if i % 9 else None) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = whitespace_tokens(F.col("text"))
    plan = index._sharded(docs, "doc_id", tokens, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    w = index.Bm25Writer(spark, f"{tmp_path}/i", "doc_id", tokens)
    w.append(docs)
    w.delete(docs.filter("doc_id % 10 = 3").select("doc_id"))
    held = index.Bm25.open(spark, w.path)
    assert held.shards.groupBy("shard", "term").count().filter("count > 1").isEmpty() and held.docs.count() > 1
    queries = spark.createDataFrame([(i, f"these w{i} {i % 7} {i % 7}") for i in range(300)] + [(999, "unheard")], "q long, text string")
    every = held.search(queries, "doc_id", "q", tokens).withColumn("score", F.round("score", 6)).join(docs.select("doc_id", "source"), "doc_id")
    for groups, by in ((None, ["q"]), (docs.select("doc_id", "source"), ["q", "source"])):
        want = retrieval.top_k(every, by, [F.desc("score"), F.asc("doc_id")], 3).select(*by, "doc_id", "score", "rank")
        got = held.top(queries, "q", tokens, 3, groups=groups).select(*by, "doc_id", "score", "rank")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.fixture
def small_broadcasts(spark):
    """Tables of documents are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_few_phrases_move_no_text(spark, sf, small_broadcasts):
    from lexiflow.operators import phrases

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.slice(whitespace_tokens(F.col("text")), 1, 3).alias("phrase"))
    assert "SortMergeJoin" not in _plan(phrases.matches(docs, some, "doc_id", whitespace_tokens(F.col("text")), longest=False))


def test_few_ids_of_near_copies_move_no_text(spark, sf, small_broadcasts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert "SortMergeJoin" not in _plan(corpus_pipeline.near_duplicates(spark, docs, sf))


def test_ids_of_near_copies_are_broadcast_whatever_the_threshold(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in _plan(corpus_pipeline.near_duplicates(spark, docs, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_that_share_a_passage_send_no_sets_to_all_tiles(spark, monkeypatch):
    """A family of texts with one common passage, of which few link: what is written of its sets grows with its size."""
    from lexiflow.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "TILE", 5)
    write, bytes_of = jaccard_join.materialize, []

    def counted(df, label):
        out = write(df, label)
        some = [F.octet_length(c) for c, kind in out.dtypes if kind == "binary" and c in ("blob", "hashes", "sketch")]
        bytes_of.extend(out.select(F.coalesce(F.sum(some[0]), F.lit(0))).first() if some else [])
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"t{i}x{j}" for j in range(24)) for i in range(120)]
    texts += [t + " end" for t in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar(docs).collect()}
    assert got == {i: i if i < 120 else i - 120 for i in range(123)}
    assert sum(bytes_of) < 5 * 8 * 82 * len(texts)
