"""Quality selection by importance resampling of hashed n-gram models.

Two generative models over hashed word n-grams are counted: one of target text (documents labelled good), one of all
raw text. The logarithm of their ratio is a document's weight; documents are drawn without replacement in proportion
to their weights by the k greatest sums of weight and Gumbel noise. The noise comes from a hash of the document's
id, so reruns agree. Counting and scoring are narrow passes; only fixed-size tables of counts are combined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialize
from ._words import _BASE, mix, word_hashes

_U = np.uint64


@dataclass(frozen=True)
class Resampling:
    """``target_rows`` bounds the labelled documents of the target model; raw text is counted whole."""

    bits: int = 16
    smooth: float = 0.5
    target_rows: int = 20_000
    seed: int = 11
    #: Noise is in units of the weight, which is the summed log ratio divided by this power of the n-gram count.
    length_power: float = 0.5


def grams(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word and pair of neighbouring words, ASCII lower-cased."""
    h, n = word_hashes([t.lower() for t in texts])
    owner = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * _BASE + h[1:])
    inside = owner[1:] == owner[:-1]
    return np.concatenate([owner, owner[1:][inside]]), np.concatenate([h, pair[inside]]) >> _U(64 - bits)


def _parts(column: pa.Array) -> Iterator[list[bytes]]:
    part, size = [], 0
    for v in column.cast(pa.binary()):
        part.append(v.as_py() or b"")
        size += len(part[-1])
        if size >= 2 << 20:
            yield part
            part, size = [], 0
    if part:
        yield part


def counts(texts: DataFrame, bits: int) -> np.ndarray:
    """n-gram counts of a one-column table of texts, by bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            for part in _parts(b.column(0)):
                n += np.bincount(grams(part, bits)[1].astype(np.int64), minlength=1 << bits)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n.tobytes()], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            for v in b.column(0):
                n += np.frombuffer(v.as_py(), dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n.tobytes()], pa.binary())})

    # One table of fixed size per task, summed in sixteen tasks before the driver sees them.
    rows = texts.mapInArrow(each, "n binary").repartition(16).mapInArrow(summed, "n binary").collect()
    return sum((np.frombuffer(r.n, dtype=np.int64) for r in rows), np.zeros(1 << bits, dtype=np.int64))


def log_ratios(target: np.ndarray, raw: np.ndarray, smooth: float) -> np.ndarray:
    p, q = target + smooth, raw + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, r: Resampling, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, log_weight, draw (weight plus noise) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{key}`"), F.lit(r.seed)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = []
            for part in _parts(b.column(1)):
                owner, bucket = grams(part, r.bits)
                total = np.bincount(owner, held.value[bucket], minlength=len(part))
                w.append(total / np.maximum(np.bincount(owner, minlength=len(part)), 1) ** r.length_power)
            w = np.concatenate(w) if w else np.zeros(0)
            u = ((b.column(2).to_numpy(zero_copy_only=False).view(np.uint64) >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w), pa.array(w - np.log(-np.log(u)))], ["id", "log_weight", "draw"])

    return rows.mapInArrow(run, "id long, log_weight double, draw double")


def greatest(scored: DataFrame, k: int) -> DataFrame:
    """``scored`` (id, draw and others) with ``kept``: whether a row is among the k greatest draws, ties to the smaller
    id. A histogram is refined until few rows share the last cell; only those are ranked, in one task."""
    low, high, n = scored.agg(F.min("draw"), F.max("draw"), F.count("*")).first()
    if not n or k <= 0 or k >= n:
        return scored.withColumn("kept", F.lit(bool(n) and k >= n))
    need = k  # of the rows in low .. high
    while True:
        step = (high - low) / 4096
        cell = F.least(F.floor((F.col("draw") - low) / step), F.lit(4095)) if step > 0 else F.lit(0)
        inside = scored.filter((F.col("draw") >= low) & (F.col("draw") <= high))
        cells = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("draw").alias("low"), F.max("draw").alias("high")).orderBy(F.desc("cell")).collect()
        for c in cells:
            if need <= c.n:
                break
            need -= c.n
        low, high = c.low, c.high
        if c.n <= 50_000 or low == high:
            break
    edge = (F.col("draw") >= low) & (F.col("draw") <= high)
    ranked = scored.filter(edge).withColumn("kept", F.row_number().over(Window.orderBy(F.desc("draw"), "id")) <= need)
    return scored.filter(~edge).withColumn("kept", F.col("draw") > high).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, k: int, r: Resampling = Resampling(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, log_weight, draw, kept of every row of ``docs``; k rows are kept (all, if fewer).

    ``target``: a one-column table of good texts. Null and empty texts weigh nothing and are drawn by noise alone;
    repeated rows are drawn alike; no rows give no rows; no target text gives a flat target model.
    """
    ratios = log_ratios(counts(target, r.bits), counts(docs.select(text), r.bits), r.smooth)
    return greatest(materialize(weigh(docs, ratios, r, key, text), "draws"), k)


def query(spark, sf_dir: str) -> DataFrame:
    from ._base import table

    r, docs = Resampling(), table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct()
    good = labels.filter("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(r.seed)), "doc_id").limit(r.target_rows)
    # The limit bounds what is broadcast.
    target = docs.join(F.broadcast(good), "doc_id").select("text")
    share = labels.agg(F.avg("quality")).first()[0] or 0.0
    out = resample(docs, target, round(share * docs.count()), r)
    return out.select(F.col("id").alias("doc_id"), "log_weight", "draw", "kept")
