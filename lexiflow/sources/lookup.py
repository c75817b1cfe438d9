"""Lookup tables of chunks: by chunk, section and document, bucketed by each key, so a lookup moves no chunk.

A store is three tables of the same chunks in the session's catalogue, their files under one folder, each in buckets of
its key and sorted by it, with Bloom filters of the key in the files. A lookup of stated ids reads their buckets only;
one of a table of ids moves the ids to the buckets, never the chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("chunk_id", "section_id", "doc_id")


def store_chunks(chunks: DataFrame, name: str, path: str, buckets: int = 64) -> ChunkStore:
    """Write ``chunks`` (chunk_id, section_id, doc_id and further columns) as the store ``name`` under ``path``.

    Chunks without a section or document are in no answer about those; null chunk ids are found by no chunk id. Chunk
    ids may repeat. ``buckets`` are files of a table: choose them for 128 MB a file or so. A store of that name is
    replaced.
    """
    spark = chunks.sparkSession
    for key in KEYS:
        table = f"{name}_by_{key[:-3]}"
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        w = chunks.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        w.option("path", f"{path}/{table}").option(f"parquet.bloom.filter.enabled#{key}", "true").saveAsTable(table)
    return ChunkStore(spark, name)


@dataclass(frozen=True)
class ChunkStore:
    """Accessors of a store; DataFrames of chunks, in no order."""

    spark: SparkSession
    name: str

    def _table(self, key: str) -> DataFrame:
        return self.spark.table(f"{self.name}_by_{key[:-3]}")

    def _of(self, key: str, ids: list | DataFrame) -> DataFrame:
        t = self._table(key)
        if isinstance(ids, DataFrame):
            return t.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
        return t.filter(F.col(key).isin(list(ids)) if ids else F.lit(False))

    def chunks(self, ids: list | DataFrame) -> DataFrame:
        """The chunks of these ids (a list, or a table's first column); unknown ones give nothing."""
        return self._of("chunk_id", ids)

    def of_sections(self, ids: list | DataFrame) -> DataFrame:
        return self._of("section_id", ids)

    def of_documents(self, ids: list | DataFrame) -> DataFrame:
        return self._of("doc_id", ids)

    def section_ids(self) -> DataFrame:
        return self._table("section_id").filter("section_id is not null").select("section_id").distinct()

    def document_ids(self) -> DataFrame:
        return self._table("doc_id").filter("doc_id is not null").select("doc_id").distinct()

    def sections(self) -> DataFrame:
        """section_id, n: chunks of each section."""
        return self._table("section_id").filter("section_id is not null").groupBy("section_id").agg(F.count("*").alias("n"))

    def documents(self) -> DataFrame:
        """doc_id, n: chunks of each document."""
        return self._table("doc_id").filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))


def corpus_of(path: str, names: dict[str, str], default: str) -> str:
    """The corpus of an index folder: that of the first pattern inside the folder's name, any case."""
    folder = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return next((corpus for pattern, corpus in names.items() if pattern in folder), default)
