"""Exact top-k inner product search with vector-approximation files.

Equal vectors are one class, of which only the k + 1 smallest ids can be an answer. Two tables are written: exact
vectors, one row a class, and the approximation file, one byte a dimension (the cell of the component) with the edges
of its block. A scan of the cells against blocks of queries bounds every inner product from both sides and keeps the
classes whose upper bound reaches the kth lower bound known so far. Exact vectors are then fetched by class in the
order of the bounds: the k best bounds of a query first, whose kth exact score then decides which of the others can
still belong to the result; only those are fetched as well. No other exact vector meets a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialize

CELLS = 256  # per dimension, so a cell number is one byte
BLOCK = 4096  # classes of a block of cells
QUERY_BLOCK = 256  # queries that meet a block of cells at once
#: Products are summed in float64, which is exact up to here; beyond it Python integers serve.
EXACT = 1 << 53


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer arrays, exactly."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * q.shape[-1]
    if most < EXACT:
        return np.rint(np.einsum("...d,...d->...", q.astype(np.float64), v.astype(np.float64))).astype(np.int64)
    if most < 1 << 62:
        return (q * v).sum(axis=-1)
    return (q.astype(object) * v.astype(object)).sum(axis=-1)


class Approximation:
    """Cells of a block of vectors, evenly spaced per dimension between its least and greatest component."""

    def __init__(self, low: np.ndarray, step: np.ndarray, cells: np.ndarray):
        self.low, self.step = low, step
        self.cells = cells.astype(np.float64)
        self.most = np.maximum(np.abs(low), np.abs(low + step * CELLS))

    @classmethod
    def of(cls, vectors: np.ndarray) -> Approximation:
        v = vectors.astype(np.float64)
        low = v.min(axis=0)
        step = (v.max(axis=0) - low) / CELLS
        cells = np.floor((v - low) / np.where(step > 0, step, 1)).clip(0, CELLS - 1)
        return cls(low, step, cells.astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the inner products, query by vector, and what the lower ones are less by, per query: the
        width of the cells is the same for all vectors. Rounding of sums and edges widens them."""
        q = queries.astype(np.float64)
        slope = q * self.step
        slack = (np.abs(q) @ self.most) * (q.shape[1] + 16) * 1e-15 + 1e-6
        top = q @ self.low + np.maximum(slope, 0).sum(axis=1) + slack
        return slope @ self.cells.T + top[:, None], np.abs(slope).sum(axis=1) + 2 * slack


class Scan:
    """What the cells seen so far say of one block of queries: the k greatest lower bounds of each query, and the
    classes whose upper bound reaches the least of them. The greatest lower bounds of different classes bound the kth
    result from below, since every class that counts holds an id other than the query's."""

    def __init__(self, q_ids: np.ndarray, queries: np.ndarray, k: int):
        self.q_ids, self.queries, self.k = q_ids, queries, k
        self.order = np.argsort(q_ids)
        self.lower = np.full((len(q_ids), k), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, cells: Approximation, classes: np.ndarray, members: np.ndarray, starts: np.ndarray) -> None:
        """Cells of a block with its classes' ids: those of class j are members[starts[j] : starts[j + 1]]."""
        upper, width = cells.bounds(self.queries)
        at = np.searchsorted(self.q_ids[self.order], members).clip(0, len(self.q_ids) - 1)
        own = np.flatnonzero(self.q_ids[self.order][at] == members)
        i, j = self.order[at[own]], np.searchsorted(starts, own, side="right") - 1
        # The class of a query's own id counts for no bound, and is a candidate only if it has other ids.
        kept = upper[i, j]
        kept[starts[j + 1] - starts[j] < 2] = -np.inf
        upper[i, j] = -np.inf
        best = upper if upper.shape[1] <= self.k else np.partition(upper, upper.shape[1] - self.k, axis=1)[:, -self.k :]
        both = np.concatenate([self.lower, best - width[:, None]], axis=1)
        self.lower = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        upper[i, j] = kept
        a, b = np.nonzero((upper >= self.lower.min(axis=1)[:, None]) & (upper > -np.inf))
        self.held.append((a, classes[b], upper[a, b]))

    def rows(self) -> pa.RecordBatch:
        a, c, upper = (np.concatenate(x) for x in zip(*self.held, strict=True))
        still = upper >= self.lower.min(axis=1)[a]
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[a[still]]), pa.array(c[still]), pa.array(upper[still])], ["query_id", "c", "bound"])


def _packed(df: DataFrame) -> DataFrame:
    """(id, v) with the components as bytes, equal only for equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x.values.to_numpy(zero_copy_only=False).astype("<i8").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["id", "v"])

    return df.mapInArrow(run, "id long, v binary")


def _blocks(df: DataFrame, size: int, schema: str, block) -> DataFrame:
    """Rows (.., v last, as bytes) as blocks of vectors of one length: ``block`` makes one row of a list of rows and
    the matrix of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def made(rows):
            m = np.frombuffer(b"".join(r[-1] for r in rows), "<i8").reshape(len(rows), -1)
            row = block(rows, m) | {"dim": m.shape[1]}
            return pa.RecordBatch.from_pylist([row])

        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                rows = held.setdefault(len(row[-1]), [])
                rows.append(row)
                if len(rows) >= size:
                    yield made(held.pop(len(row[-1])))
        for rows in held.values():
            yield made(rows)

    return df.mapInArrow(lambda batches: (_cast(b, schema) for b in run(batches)), schema)


def _cast(b: pa.RecordBatch, schema: str) -> pa.RecordBatch:
    """Columns in the order and with the types of a schema of longs and binaries."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([b.column(n).cast(pa.int64() if t == "long" else pa.binary()) for n, t in fields], [n for n, _ in fields])


def _cells(rows: list[tuple], m: np.ndarray) -> dict:
    a = Approximation.of(m)
    counts = [len(r[1]) for r in rows]
    return {
        "classes": np.array([r[0] for r in rows], "<i8").tobytes(),
        "members": np.array([i for r in rows for i in r[1]], "<i8").tobytes(),
        "starts": np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes(),
        "low": a.low.tobytes(),
        "step": a.step.tobytes(),
        "cells": a.cells.astype(np.uint8).tobytes(),
    }


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """Exact vectors (id, v as bytes) by class, written: c (a number of its own), members (the k + 1 smallest ids with
    how often each occurs, k at most), v. A common vector is cut to its smallest ids before it is shuffled."""
    counted = vectors.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    first = counted.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("at") <= k + 1)
    grouped = first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "copies"))).alias("members"))
    return materialize(grouped.select(F.monotonically_increasing_id().alias("c"), "members", "v"), "va-exact")


def scan(cells: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, c, bound) of all classes that can hold one of the k best of a query, by the cells alone."""
    # Blocks of queries against all blocks of cells, spread over as many salts as the session has shuffle partitions;
    # every salt gets all queries, and a task carries what it knows of a block of queries from one block to the next.
    salts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    asked = _blocks(queries.coalesce(salts), QUERY_BLOCK, "dim long, q_ids binary, q_v binary", lambda rows, m: {"q_ids": np.array([r[0] for r in rows], "<i8").tobytes(), "q_v": m.tobytes()})
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("classes"), F.lit(salts)).cast("int"))
    names = ("dim", "q_ids", "q_v", "classes", "members", "starts", "low", "step", "cells")
    pairs = asked.select("*", spread).join(salted.hint("merge"), ["dim", "salt"]).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = None, None
        for b in batches:
            for row in range(b.num_rows):
                dim, q_ids, q_v, c, members, starts, low, step, grid = (b.column(n)[row].as_py() for n in range(len(names)))
                if (dim, q_ids) != seen:
                    if held is not None:
                        yield held.rows()
                    seen, held = (dim, q_ids), Scan(np.frombuffer(q_ids, "<i8"), np.frombuffer(q_v, "<i8").reshape(-1, dim), k)
                block = Approximation(np.frombuffer(low), np.frombuffer(step), np.frombuffer(grid, np.uint8).reshape(-1, dim))
                held.meet(block, np.frombuffer(c, "<i8"), np.frombuffer(members, "<i8"), np.frombuffer(starts, "<i8"))
        if held is not None:
            yield held.rows()

    return pairs.mapInArrow(run, "query_id long, c long, bound double")


def _scored(wanted: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact scores of pairs (query_id, c): one row per id of the class but the query's own, as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_length: dict[int, list[int]] = {}
            q, v = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, x in enumerate(v):
                by_length.setdefault(len(x), []).append(i)
            for some in by_length.values():
                both = [np.frombuffer(b"".join(x[i] for i in some), "<i8").reshape(len(some), -1) for x in (q, v)]
                part = b.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(_exact(*both)), pa.int64())], ["query_id", "members", "score"])

    met = wanted.select("query_id", "c").join(exact, "c").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    found = met.select("query_id", "members", "q", "v").mapInArrow(run, "query_id long, members array<struct<id: long, copies: int>>, score long")
    each = found.select("query_id", "score", F.explode("members").alias("m")).filter("m.id <> query_id")
    return each.select("query_id", F.col("m.id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), F.col("m.copies"))).alias("copy")).drop("copy")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact k best of ``vectors`` (id, v: array of long) for each row of ``queries`` (same columns).

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id; a query's own id is no candidate.
    Null vectors take no part; vectors of different lengths are never compared. Fewer candidates give fewer rows;
    repeated candidate rows each count; repeated query ids are one query. No rows give no rows. Other columns are
    ignored.
    """
    clean = lambda df: _packed(df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<bigint>").alias("v")).filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)"))
    exact = classes(clean(vectors), k)
    queries = materialize(clean(queries).dropDuplicates(["id"]), "va-queries")
    ids = exact.select("c", F.col("members.id").alias("members"), "v")
    cells = materialize(_blocks(ids, BLOCK, "dim long, classes binary, members binary, starts binary, low binary, step binary, cells binary", _cells), "va-cells")
    by_bound = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "c")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # A query that cannot tell vectors apart (a null vector) finds all classes: no window or join gathers them whole.
    found = materialize(scan(cells, queries, k), "va-found")
    first = found.withColumn("at", F.row_number().over(by_bound)).filter(F.col("at") <= k).select("query_id", "c")

    scores = materialize(_scored(first, exact, queries), "va-scores")
    worst = scores.withColumn("at", F.row_number().over(by_score)).filter(F.col("at") <= k).filter(F.col("at") == k).select("query_id", F.col("score").alias("worst"))
    # A class whose bound is below the kth exact score of its query holds no result; equal ones may win by their id.
    rest = found.join(first, ["query_id", "c"], "left_anti").join(worst, "query_id", "left").filter("worst is null or bound >= worst")
    near = scores.unionByName(_scored(rest, exact, queries))
    return near.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from ._base import table

    e = table(spark, sf_dir, "embeddings")
    sound = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    v = e.filter(sound).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return search(v, v.filter(F.col("id") % 50 == 0), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
"""
