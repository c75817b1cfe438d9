"""Vector searches against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from lexiflow.operators import index, vectors
from lexiflow.plans import registry, retrieve

NAN, INF = float("nan"), float("inf")
ODD = [(1, [1.0, 0.0]), (2, None), (3, [NAN, 1.0]), (4, [INF, 0.0]), (5, [None, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [0.0, 0.0]), (8, [1.0, 0.0]), (8, [0.6, 0.8]), (9, []), (50, [0.5, 0.5])]


def embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)


def asked(v, where):
    return v.filter(where).select(F.col("id").alias("q"), F.col("v").alias("qv"))


def test_dense_search_over_all_vectors(spark, sf):
    ids, x = embeddings(spark, sf)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = {"ip": lambda q: x @ x[q], "cosine": lambda q: unit @ unit[q], "l2": lambda q: -((x - x[q]) ** 2).sum(1)}
    for metric, by in score.items():
        want = set()
        for q in np.flatnonzero(ids % 50 == 0):
            s = np.where(ids == ids[q], -np.inf, np.round(by(q), 9))
            want |= {(int(ids[q]), int(ids[i]), n + 1) for n, i in enumerate(np.lexsort((ids, -s))[:5])}
        assert {(r.q, r.id, r.rank) for r in registry.QUERIES[f"dense_whole_{metric}"](spark, sf).collect()} == want
    near = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.01]), (1, [0.0, 1.0])], "id long, v array<double>")
    asked = near.filter("id = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    assert vectors.dense(asked, near, 1, "ip", others=True).first().id == 50


def test_dense_search_on_odd_vectors(spark, monkeypatch):
    """Null, NaN, infinite and empty ones, other lengths, zero vectors, repeated ids and ties."""
    v = spark.createDataFrame(ODD, "id long, v array<double>")
    got = lambda metric, k=9: [(r.q, r.id, round(r.score, 6), r["rank"]) for r in vectors.dense(asked(v, "id in (1, 3, 6, 7)"), v, k, metric).orderBy("q", "rank").collect()]
    assert got("ip") == [(1, 1, 1.0, 1), (1, 8, 1.0, 2), (1, 8, 0.6, 3), (1, 50, 0.5, 4), (1, 7, 0.0, 5), (6, 6, 1.0, 1)] + [(7, i, 0.0, n + 1) for n, i in enumerate((1, 7, 8, 8, 50))]
    assert got("cosine")[:5] == [(1, 1, 1.0, 1), (1, 8, 1.0, 2), (1, 50, 0.707107, 3), (1, 8, 0.6, 4), (1, 7, 0.0, 5)]
    assert got("l2", 1) == [(1, 1, 0.0, 1), (6, 6, 0.0, 1), (7, 7, 0.0, 1)]
    assert vectors.dense(asked(v, "false"), v, 3).isEmpty() and vectors.dense(asked(v, "id = 1"), v.limit(0), 3).isEmpty()


def test_tiles_of_many_vectors(spark, monkeypatch):
    """More vectors than a tile and than a task holds."""
    monkeypatch.setattr(vectors, "HELD", 50)
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (400, 5)).astype(float)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    got = {(r.q, r["rank"]): r.id for r in vectors.dense(asked(v, "id % 9 = 0"), v, 7, "ip", others=True).collect()}
    for q in range(0, 400, 9):
        s = np.where(np.arange(400) == q, -np.inf, x @ x[q])
        assert [got[q, n] for n in range(1, 8)] == np.lexsort((np.arange(400), -s))[:7].tolist()


def test_probe_recall_against_brute_force(spark, sf):
    ids, x = embeddings(spark, sf)
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        score = np.round(x @ x[q], 9)
        want |= {(int(ids[q]), int(ids[i])) for i in np.lexsort((ids, -score))[:5]}
    got = {(r.q, r.id) for r in retrieve.ivf_probe(spark, sf).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_inverted_file(spark, tmp_path):
    """All cells asked, every vector is found; few asked, only their partitions are read."""
    rows = [(i, [math.cos(i), math.sin(i), 0.1 * i]) for i in range(60)] + [(60, None), (61, [1.0, 2.0]), (62, [NAN, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    vectors.build_vectors(v, f"{tmp_path}/i", 8)
    assert index.open_index(spark, f"{tmp_path}/i")[1].count() == 8
    got = vectors.probe_vectors(spark, f"{tmp_path}/i", asked(v, "id < 3 or id >= 60"), 8, 100).collect()
    assert sorted({r.q for r in got}) == [0, 1, 2, 61] and len(got) == 181
    near = vectors.probe_vectors(spark, f"{tmp_path}/i", asked(v, "id < 3"), 1, 100)
    assert 3 <= near.count() < 100
    plan = near._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters" in plan
    vectors.build_vectors(v.filter("id > 60"), f"{tmp_path}/few", 8)
    assert vectors.probe_vectors(spark, f"{tmp_path}/few", asked(v, "id = 61"), 2, 3).count() == 1
    vectors.build_vectors(v.limit(0), f"{tmp_path}/none", 8)


def test_graph_recall_against_brute_force(spark, sf):
    ids, x = embeddings(spark, sf)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.where(ids == ids[q], -np.inf, np.round(unit @ unit[q], 9))
        want |= {(int(ids[q]), int(ids[i])) for i in np.lexsort((ids, -s))[:5]}
    got = {(r.q, r.id) for r in retrieve.graph_search(spark, sf).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_graph_meets_few_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 1500)] + 0.5 * rng.normal(size=(1500, 16))
    odd = [(2000, None), (2001, [1.0]), (2002, [NAN] * 16), (0, [9.0] * 16)]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + odd, "id long, v array<double>")
    vectors.build_graph(v, f"{tmp_path}/g", vectors.Graph(near=12, rounds=3, most=20, seeds=128))
    links = spark.read.parquet(f"{tmp_path}/g/links")
    assert links.groupBy("a").count().agg(F.max("count")).first()[0] <= 20 and spark.read.parquet(f"{tmp_path}/g/nodes").count() == 1500
    some = asked(v, "id % 50 = 1 or id > 1999")
    got, met = vectors.search_graph(spark, f"{tmp_path}/g", some, 5, f"{tmp_path}/s", beam=32, step=8, others=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {(r.q, r.id) for r in got.collect()}
    want = {(q, int(i)) for q in range(1, 1500, 50) for i in np.argsort(-np.where(np.arange(1500) == q, -2, unit @ unit[q]))[:5]}
    assert {q for q, _ in found} == set(range(1, 1500, 50))
    assert len(found & want) >= 0.9 * len(want) and met.count() < 0.2 * 30 * 1500
    assert met.count() == met.select("q", "id").distinct().count()


def test_graph_is_built_and_searched_without_joins_of_vectors(spark, tmp_path, monkeypatch):
    """Many shards: recall, each query's best over all of them, ids as signed numbers; no join or sort of met pairs."""
    monkeypatch.setattr(vectors, "SHARD", 300)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, 1200)] + 0.5 * rng.normal(size=(1200, 16))
    v = spark.createDataFrame([(i - 600, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    vectors.build_graph(v, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/shards").count() == 4 and spark.read.parquet(f"{tmp_path}/g/links").groupBy("a").count().agg(F.max("count")).first()[0] <= 48
    got, met = vectors.search_graph(spark, f"{tmp_path}/g", asked(v, "id % 40 = 0"), 5, f"{tmp_path}/s", others=True)
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert not any(word in plan for word in ("SortMergeJoin", "HashJoin", "Window"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows, hits = got.collect(), 0
    for q in range(-600, 600, 40):
        s = np.where(np.arange(1200) == q + 600, -2, np.round(unit @ unit[q + 600], 9))
        mine = sorted((r["rank"], r.id, r.score) for r in rows if r.q == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(s[i + 600] - c) < 1e-8 for _, i, c in mine)
        hits += len({i + 600 for _, i, _ in mine} & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 30
    vectors.build_graph(v.limit(0), f"{tmp_path}/none")
    assert vectors.search_graph(spark, f"{tmp_path}/none", asked(v, "id = 0"), 5, f"{tmp_path}/s0")[0].isEmpty()
    vectors.build_graph(v.limit(1), f"{tmp_path}/one")
    assert vectors.search_graph(spark, f"{tmp_path}/one", asked(v, "id % 40 = 0"), 5, f"{tmp_path}/s1")[0].count() == 30
