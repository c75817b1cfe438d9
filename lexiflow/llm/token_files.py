"""Token ids as seekable binary files: independent zstandard frames, a trailing seek table, per-frame checksums.

File layout: data frames, each the little-endian unsigned 32-bit ids of consecutive documents; one frame with the
document index (count, doc ids, null flags, token counts, first data offset); a skippable frame holding the seek
table (compressed size, size, low 32 bits of the XXH64 of the content, for each frame; frame count, flags, magic).
Any zstandard reader can decompress the file; ours reads the table from the end and only the frames it needs.

Documents are range partitioned by id, so each task writes its files from a sorted stream with one frame in memory.
A file counts only once its task has reported it (lost or repeated attempts leave files that nothing refers to).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import fresh_path, idle, materialize, tidy
from ._pieces import Encoded, PieceTable

FRAME_BYTES = 1 << 18  # ids gathered in one frame, unless one document has more
READ_BYTES = 8 << 20  # ids that one task reads back, or one file
FILE_BYTES = 1 << 28  # ids in one file before the next is begun
# Fixed values of the seekable zstandard format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file, document after document."""

    def __init__(self, path: str):
        import zstandard

        files, inner = _fs(path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        self.path, self.out, self.zstd = path, files.open_output_stream(inner, compression=None), zstandard.ZstdCompressor(level=1)
        self.buffer: list[bytes] = []
        self.held = self.n_ids = 0
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.buffer))
            self.buffer, self.held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > FRAME_BYTES:
            self._flush()
        self.buffer.append(ids)
        self.held += len(ids)
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.n_ids += len(ids) // 4

    def close(self) -> tuple:
        self._flush()
        keys = np.array([i or 0 for i in self.ids], dtype="<i8")
        nulls = np.array([i is None for i in self.ids], dtype="<u1")
        self._frame(struct.pack("<q", len(keys)) + keys.tobytes() + nulls.tobytes() + np.array(self.counts, dtype="<i8").tobytes())
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        tail = entries + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(tail)) + tail)
        self.out.close()
        return self.path, self.ids[0], len(self.ids), self.n_ids


class Reader:
    """Reads documents of one file; only the frames asked for are read and decompressed."""

    def __init__(self, path: str):
        files, inner = _fs(path)
        self.file = files.open_input_file(inner)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        entries = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw, self.sums = entries.T
        self.at = np.cumsum(self.sizes) - self.sizes
        self.raw_at = np.cumsum(self.raw) - self.raw
        index = self.frame(n - 1)
        (d,) = struct.unpack("<q", index[:8])
        self.doc_ids = np.frombuffer(index, "<i8", d, 8)
        self.nulls = np.frombuffer(index, "<u1", d, 8 + 8 * d).astype(bool)
        self.counts = np.frombuffer(index, "<i8", d, 8 + 9 * d)
        self.starts = np.cumsum(self.counts) - self.counts
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(self.sizes[k])), max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"checksum of frame {k} differs")
        return data

    def tokens(self, i: int) -> bytes:
        """Ids of document number i of the file."""
        at, n = 4 * int(self.starts[i]), 4 * int(self.counts[i])
        if not n:
            return b""
        k = int(np.searchsorted(self.raw_at[:-1], at, side="right")) - 1
        if self.last[0] != k:
            self.last = k, self.frame(k)
        return self.last[1][at - int(self.raw_at[k]) :][:n]


CHUNK_BYTES = 1 << 20  # texts encoded together, unless one text has more
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the pieces of a text

_LIBRARY: dict[int, PieceTable] = {}


def _table(spec: str) -> PieceTable:
    """The library's encoding of whole texts, each distinct piece only once.

    Pieces are lower-cased already, so they go to the library's model in bulk, without its normaliser, and end where a
    token ends a word; words that need the normaliser or special tokens go to the whole library tokenizer. This holds
    for byte-level files with word ends that compose, lower-case and cut by ``PIECES``; of other files every word goes
    to the whole tokenizer, which is right for those that never join words across white space.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    d = json.loads(spec)
    full = Tokenizer.from_str(json.dumps(d | {"truncation": None, "padding": None}))
    cutters, changes = (d["pre_tokenizer"] or {}).get("pretokenizers", []), (d["normalizer"] or {}).get("normalizers", [])
    suffix, vocab = d["model"].get("end_of_word_suffix") or "", d["model"]["vocab"]

    def whole(words: list[bytes]) -> Encoded:
        some = [e.ids for e in full.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.array([i for x in some for i in x], dtype=np.uint32), np.array([len(x) for x in some], dtype=np.int64)

    if not suffix or [x["type"] for x in cutters] != ["Split", "ByteLevel"] or cutters[0]["pattern"].get("Regex") != PIECES or [x["type"] for x in changes][::2] != ["NFC", "Lowercase"]:
        return PieceTable(whole, whole, [])
    plain = {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, cutters[-1]]}}
    model = Tokenizer.from_str(json.dumps(d | plain))
    last = np.zeros(max(vocab.values()) + 1, dtype=bool)
    last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def bulk(pieces: list[bytes]) -> Encoded:
        ids, n = [], []
        for k in range(0, len(pieces), 2000):
            some = np.array(model.encode_batch_fast([b" ".join(pieces[k : k + 2000]).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ids.append(some)
            n.append(np.diff(np.flatnonzero(last[some]) + 1, prepend=0))
        if sum(map(len, n)) != len(pieces):
            raise ValueError("a piece is not one word to the model")
        return np.concatenate(ids), np.concatenate(n)

    return PieceTable(bulk, whole, [x["content"] for x in d["added_tokens"]])


def library(spec: str) -> PieceTable:
    key = hash(spec)
    if key not in _LIBRARY:
        _LIBRARY.clear()
        _LIBRARY[key] = _table(spec)
    return _LIBRARY[key]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    keys, texts, size = [], [], 0
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            keys.append(k)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def write_tokens(docs: DataFrame, spec: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` and write them in ascending order of the key; returns the manifest, one row per file.

    Manifest: part, number, path, first_id, n_docs, n_ids, start (ids of all files before it). Null text has only the
    end id; null keys come first; rows of one key are separate documents in the order of their texts' bytes (null
    first); other columns of ``docs`` are not read; no rows write no files.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(spec)
    folder = folder or fresh_path(spark, "token-files")
    ordered = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("binary").alias("t")).repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with idle(_LIBRARY):
            yield _written(batches, library(held.value))

    def _written(batches: Iterator[pa.RecordBatch], table: PieceTable) -> pa.RecordBatch:
        done, writer = [], None
        for keys, texts in _chunks(batches):
            ids, ends = table.encode(texts)
            data, at = np.insert(ids, ends, end_id).astype("<u4").tobytes(), 0
            for i, upto in zip(keys, (4 * (ends + np.arange(1, len(ends) + 1))).tolist(), strict=True):
                if writer is None:
                    writer = Writer(f"{folder}/{uuid.uuid4().hex}.ids.zst")
                writer.add(i, data[at:upto])
                at = upto
                if 4 * writer.n_ids >= file_bytes:
                    done.append((TaskContext.get().partitionId(), len(done), *writer.close()))
                    writer = None
        if writer is not None:
            done.append((TaskContext.get().partitionId(), len(done), *writer.close()))
        return pa.RecordBatch.from_pydict({n: pa.array([d[j] for d in done], t) for j, (n, t) in enumerate((("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())))})

    files = materialize(ordered.mapInArrow(tidy(write), "part int, number int, path string, first_id long, n_docs long, n_ids long"), "token-manifest")
    # One row per file of up to FILE_BYTES. Equal ids lie in one range partition, whose task numbers its files.
    before = F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of a manifest's files: doc_id, start (ids of all documents before it), ids (binary)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r, at, size, rows = Reader(path), 0, 0, []
                for i in range(len(r.counts)):
                    rows.append(r.tokens(i))
                    size += len(rows[-1])
                    if size >= 4 << 20 or i + 1 == len(r.counts):
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[at : i + 1], pa.int64(), mask=r.nulls[at : i + 1]), pa.array(r.starts[at : i + 1] + base, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "start", "ids"])
                        at, size, rows = i + 1, 0, []

    # A fixed count: adaptive execution would read all files in one task, the manifest itself being small.
    files, ids = manifest.agg(F.count("*"), F.sum("n_ids")).first()
    spread = manifest.select("path", "start").repartition(max(1, min(files, -(-4 * (ids or 0) // READ_BYTES))), F.col("path"))
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def read_documents(manifest: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, start, ids of the documents whose ids ``wanted`` (column ``key``) asks for.

    Files lie in order, so an id's files follow from the manifest's first ids (one number per file, sent to the tasks);
    each file that is asked for is opened once, and only the frames of its requested documents are decompressed. Ids
    that no file has and null ids give nothing; repeated requests count once; all documents of a repeated id are given.
    """
    rows = manifest.filter("n_docs > 0").orderBy("part", "number").select("path", "start", "first_id").collect()
    low = np.iinfo(np.int64).min
    held = manifest.sparkSession.sparkContext.broadcast((np.array([low if r.first_id is None else r.first_id for r in rows], np.int64), [(r.path, r.start) for r in rows]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, files = held.value
        for b in batches:
            ids = b.column(0).to_numpy()
            # From the last file that begins below the id (its end may hold it) to the last that begins with it.
            x, y = np.maximum(np.searchsorted(first, ids) - 1, 0), np.searchsorted(first, ids, side="right")
            file = np.concatenate([np.arange(a, z) for a, z in zip(x, y, strict=True)]).astype(int) if len(ids) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array([files[f][0] for f in file], pa.string()), pa.array([files[f][1] for f in file], pa.int64()), pa.array(np.repeat(ids, y - x))], ["path", "start", "doc_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, r = None, None
        for b in batches:
            out: list[tuple[int, int, bytes]] = []
            size = 0
            for p, base, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != path:
                    path, r = p, Reader(p)
                n = int(r.nulls.sum())  # they come first
                for k in range(n + int(np.searchsorted(r.doc_ids[n:], i)), n + int(np.searchsorted(r.doc_ids[n:], i, side="right"))):
                    out.append((i, base + int(r.starts[k]), r.tokens(k)))
                    size += len(out[-1][2])
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pydict({n: pa.array([x[j] for x in out], t) for j, (n, t) in enumerate((("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())))})
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array([x[j] for x in out], t) for j, (n, t) in enumerate((("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())))})

    ids = wanted.select(F.col(f"`{key}`").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    asked = ids.mapInArrow(place, "path string, start long, doc_id long")
    return asked.repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(read, "doc_id long, start long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ._base import table
    from .bpe import read_spec

    files = write_tokens(table(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("word_bpe_49k.json")), 2)
    back = read_tokens(files)
    return back.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
