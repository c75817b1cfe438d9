"""Toxicity by a linear classifier over character n-grams scaled with naive Bayes log-count ratios.

Features: hashed byte n-grams of the ASCII-lowered text, present or not. Each is scaled by
``log(share of toxic documents with it / share of others with it)``; a logistic regression with a quadratic
penalty is fitted on the scaled features. Fitting uses at most ``Fit.per_class`` labelled documents of each class
(taken in a seeded hash order); documents are scored in one narrow pass, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import materialize


@dataclass(frozen=True)
class Fit:
    """Parameters. ``per_class`` bounds the labelled rows that the fit sees, ``kept`` the features of the model."""

    per_class: int = 6000
    bits: int = 20
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    kept: int = 1 << 12
    min_documents: int = 5
    smooth: float = 1.0
    penalty: float = 1e-2
    steps: int = 300
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """Feature numbers (ascending) with their final weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int
    sizes: tuple[int, ...]


TASKS = 6  # of the fit
PIECE = 1 << 20  # bytes of text hashed at a time


def grams(texts: list[bytes], sizes: tuple[int, ...], bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs with ``table[feature]`` set, ordered by text number.

    n-grams never cross texts. Long texts are hashed in overlapping pieces, so memory stays bounded.
    """
    docs, found = [], []
    longest, group, at = max(sizes), [], 0

    def hashed(part: list[tuple[int, bytes]]) -> None:
        data = np.frombuffer(b"".join([t for _, t in part]), dtype=np.uint8).astype(np.uint32)
        lens = np.array([len(t) for _, t in part])
        owner = np.repeat(np.arange(len(part)), lens)
        room = np.repeat(np.cumsum(lens), lens) - np.arange(len(data))  # bytes from here to the text's end
        h = np.zeros(len(data), dtype=np.uint32)
        pairs = []
        for k in range(longest):
            h[: len(data) - k] = h[: len(data) - k] * np.uint32(0x01000193) + (data[k:] + np.uint32(1))
            if k + 1 in sizes:
                f = ((h ^ (h >> np.uint32(15)) ^ np.uint32(k * 0x9E37)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
                hit = np.flatnonzero(table[f] & (room > k))
                pairs.append(np.unique((owner[hit].astype(np.int64) << bits) | f[hit]))
        p = np.unique(np.concatenate(pairs))
        ids = np.array([i for i, _ in part], dtype=np.int64)
        docs.append(ids[p >> bits])
        found.append(p & ((1 << bits) - 1))

    for i, t in enumerate(texts):
        t = t.lower()
        for k in range(0, max(1, len(t)), PIECE):
            part = t[k : k + PIECE + longest - 1]
            if part:
                group.append((i, part))
                at += len(part)
            if at >= PIECE:
                hashed(group)
                group, at = [], 0
    if group:
        hashed(group)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique((np.concatenate(docs) << bits) | np.concatenate(found))  # a text's pieces share features
    return both >> bits, both & ((1 << bits) - 1)


def _bytes(column: pa.Array) -> list[bytes]:
    return [v.as_py() or b"" for v in column.cast(pa.binary())]


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, allowed: Column, fit: Fit) -> DataFrame:
    """At most ``fit.per_class`` labelled documents of each class: label and text as ``y`` and ``t``. Of rows that share
    an id the least text by bytes counts, once."""
    own = labels.filter(allowed & F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isin(0, 1)).select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).distinct()
    order = (F.xxhash64("k", F.lit(fit.seed)), F.col("k"))
    some = own.filter("y = 1").orderBy(*order).limit(fit.per_class).unionByName(own.filter("y = 0").orderBy(*order).limit(fit.per_class))
    # The bound on the rows of ``some`` is the proof that it may be broadcast.
    return docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("t")).join(F.broadcast(some), "k").groupBy("k", "y").agg(F.min("t").alias("t")).select("y", "t")


def fit_model(rows: DataFrame, fit: Fit) -> Model:
    """A model from rows of ``sample``. Without both classes every score is the share of toxic rows."""
    spark, bits, sizes = rows.sparkSession, fit.bits, fit.sizes

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows_of = np.zeros((2, 1 << bits), dtype=np.int32), [0, 0]
        every = np.ones(1 << bits, dtype=bool)
        for b in batches:
            y, t = b.column(0).to_numpy(zero_copy_only=False), _bytes(b.column(1))
            for k in range(0, len(t), 64):
                doc, f = grams(t[k : k + 64], sizes, bits, every)
                for c in (0, 1):
                    n[c] += np.bincount(f[y[k : k + 64][doc] == c], minlength=1 << bits).astype(np.int32)
            for c in (0, 1):
                rows_of[c] += int((y == c).sum())
        some = np.flatnonzero(n.sum(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"f": [some.tobytes()], "n0": [n[0][some].tobytes()], "n1": [n[1][some].tobytes()], "d0": [rows_of[0]], "d1": [rows_of[1]]})

    n, d = np.zeros((2, 1 << bits)), [0, 0]
    # The sample is bounded, so is what its few tasks send: one table of fixed size each.
    rows = materialize(rows.repartition(TASKS), "labelled-sample").repartition(TASKS)
    for r in rows.mapInArrow(counted, "f binary, n0 binary, n1 binary, d0 long, d1 long").collect():
        f = np.frombuffer(r.f, dtype=np.int32)
        n[0][f] += np.frombuffer(r.n0, dtype=np.int32)
        n[1][f] += np.frombuffer(r.n1, dtype=np.int32)
        d = [d[0] + r.d0, d[1] + r.d1]
    if not all(d):
        p = (d[1] + 0.5) / (sum(d) + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))), bits, sizes)
    ratio = np.log((n[1] + fit.smooth) / (d[1] + 2 * fit.smooth)) - np.log((n[0] + fit.smooth) / (d[0] + 2 * fit.smooth))
    df = n.sum(axis=0)
    # Features by how far their counts stand from chance.
    expected = df * d[1] / sum(d)
    gain = np.where(df >= fit.min_documents, np.abs(n[1] - expected) / np.sqrt(expected * d[0] / sum(d) + 1), 0.0)
    features = np.sort(np.argsort(-gain, kind="stable")[: min(fit.kept, int((gain > 0).sum()))])
    if not len(features):
        return Model(features, np.zeros(0), float(np.log(d[1] / d[0])), bits, sizes)
    table = np.zeros(1 << bits, dtype=bool)
    table[features] = True
    held = spark.sparkContext.broadcast(table)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, out = _bytes(b.column(1)), []
            for k in range(0, len(t), 64):
                doc, f = grams(t[k : k + 64], sizes, bits, held.value)
                out += [x.astype(np.int32).tobytes() for x in np.split(f, np.searchsorted(doc, np.arange(1, len(t[k : k + 64]))))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["y", "f"])

    ys, lists = [], []
    for r in rows.mapInArrow(rows_of, "y int, f binary").collect():
        ys.append(r.y)
        lists.append(np.searchsorted(features, np.frombuffer(r.f, dtype=np.int32)).astype(np.int32))
    y, lens = np.array(ys, dtype=float), np.array([len(x) for x in lists])
    flat, owner, scale = np.concatenate(lists), np.repeat(np.arange(len(y)), lens), ratio[features]
    weight = np.where(y == 1, 0.5 / d[1], 0.5 / d[0])
    u, b, mu, mb, vu, vb = np.zeros(len(features)), 0.0, np.zeros(len(features)), 0.0, np.zeros(len(features)), 0.0
    for k in range(1, fit.steps + 1):  # full-batch steps with moment estimates
        z = np.bincount(owner, (u * scale)[flat], minlength=len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        gu = np.bincount(flat, e[owner], minlength=len(features)) * scale + fit.penalty * u
        gb = e.sum()
        mu, vu, mb, vb = 0.9 * mu + 0.1 * gu, 0.99 * vu + 0.01 * gu**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.02 * (1 - k / (fit.steps + 1))
        u = u - rate * (mu / (1 - 0.9**k)) / (np.sqrt(vu / (1 - 0.99**k)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    return Model(features, u * scale, float(b), bits, sizes)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column ``score`` in 0..1; null and empty texts get the intercept's score.

    Only the text enters. A column of that name is replaced; other columns, repeated rows and empty tables pass.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        weights = np.zeros(1 << m.bits)
        weights[m.features] = m.weights
        table = weights != 0
        for b in batches:
            t, z = _bytes(b.column(at)), []
            for k in range(0, len(t), 256):
                doc, f = grams(t[k : k + 256], m.sizes, m.bits, table)
                z.append(np.bincount(doc, weights[f], minlength=len(t[k : k + 256])) + m.bias)
            z = np.concatenate(z) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3


def query(spark, sf_dir: str) -> DataFrame:
    from ._base import table

    docs, labels, fit = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Fit()
    model = fit_model(sample(docs, labels, "toxic", "doc_id", "text", fold() != 1, fit), fit)
    # The text stays out of the result; only the key passes through Python beside it.
    out = score(docs.select("doc_id", "text"), model).drop("text")
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
