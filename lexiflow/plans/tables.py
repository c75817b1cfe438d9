"""Tables of a folder, and indexes of them that a session keeps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, shared_folder


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_BUILT: dict = {}


def built(spark: SparkSession, df: DataFrame, kind: str, make: Callable[[str], None]) -> str:
    """Folder of an index of ``df``, made by ``make(folder)`` once for a session and the files as they are: a file of
    another size or time makes a new index, and the old one goes."""
    files = df.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct()
    state = tuple(files.agg(F.count("*"), F.bit_xor("f")).first())
    name = (spark.sparkContext.applicationId, kind, str(sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]})))
    if name not in _BUILT or _BUILT[name][0] != state:
        if name in _BUILT:
            delete(spark, _BUILT.pop(name)[1])
        path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
        make(path)
        _BUILT[name] = state, path
    return _BUILT[name][1]
