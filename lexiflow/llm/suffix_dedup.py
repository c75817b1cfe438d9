"""Removal of byte strings that also occur in an earlier document, by sharded suffix arrays.

A byte goes if a window of 50 bytes that covers it also starts in a document with a smaller id. Suffix arrays of all
text would sort mostly what repeats nowhere, so windows are dealt to shards first, without losing any:

1. The code of a window is the least hash of its 26-byte substrings, so equal windows have equal codes, and
   neighbouring windows mostly share one. Codes that occur in two different texts are found shard by shard; where a
   chunk of documents has a code twice, that is decided on the spot and one of its texts speaks for it.
2. Runs of neighbouring windows with one such code are sent, as strings, to the shard of the code. Within a chunk of
   documents only the least document of each string is sent; the others are decided on the spot.
3. A shard sorts the strings whose code has several strings: induced sorting gives their suffix array, permuted common
   prefixes of 50 or more bound groups of equal windows, and the least document of a group decides the rest.

Whole copies are found by digest and never sorted. No document, passage or code is gathered whole in one task:
a very common code or passage reaches its shard once per chunk. Texts are told apart by 128 bits of their SHA-256,
documents by that and their id; strings of equal hash are compared byte by byte. Shards and buckets grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import discard, materialize, tidy
from ._words import _TABLE, blocks, mix, powers, string_hashes
from .suffix_array import common_prefixes, suffix_array

_U = np.uint64
GRAM = 26  # bytes of the substrings whose least hash is a window's code, for windows of 50
CHUNK = 1 << 20  # bytes hashed at once; longer texts are cut into overlapping pieces
SHARD_CODES = 1 << 20  # codes that one task should get
SORTED_BYTES = 1 << 18  # strings in one suffix array, unless one code has more
LAST = (1 << 63) - 1
_LOW = _U((1 << 40) - 1)


def codes(data: np.ndarray, width: int) -> np.ndarray:
    """Code of the window at each start 0 .. len - width."""
    n = len(data)
    up, down = powers(n + 1)
    gram = min(GRAM, width)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=_U)
        sums[0] = 0
        np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
        low = mix((sums[gram:] - sums[:-gram]) * down[: n + 1 - gram])
    span, need = 1, width - gram + 1
    while 2 * span <= need:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if need > span:
        low = np.minimum(low[: len(low) - (need - span)], low[need - span :])
    return mix(low)


def _names(data: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each string at these places: equal for equal strings only."""
    _, first, name = np.unique(string_hashes(data, at, size), return_index=True, return_inverse=True)
    owner, place, value = blocks(data, at, size)
    head = np.flatnonzero(place == 0)
    like = first[name]
    if np.array_equal(size, size[like]) and np.array_equal(value, value[head[like][owner] + place]):
        return name
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[x : x + n], len(known)) for x, n in zip(at.tolist(), size.tolist(), strict=True)], dtype=np.int64)


def pieces(texts: Iterator[tuple], width: int) -> Iterator[list[tuple]]:
    """Groups of (tag, offset, bytes) of bounded size; the windows of a text lie each in exactly one of its pieces."""
    group, size = [], 0
    for tag, t in texts:
        for at in range(0, max(0, len(t) - width + 1), CHUNK):
            part = t[at : at + CHUNK + width - 1]
            if group and size + len(part) > CHUNK + width:
                yield group
                group, size = [], 0
            group.append((tag, at, part))
            size += len(part)
    if group:
        yield group


def _windows(group: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of a group, starts of all windows that lie in one piece, and each one's piece."""
    data = np.frombuffer(b"".join([p for _, _, p in group]), dtype=np.uint8)
    lens = np.array([len(p) for _, _, p in group])
    first = np.cumsum(lens) - lens
    count = lens - width + 1
    piece = np.repeat(np.arange(len(group)), count)
    return data, np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + first[piece], piece


def _shard(code: np.ndarray, shards: int) -> np.ndarray:
    return ((code >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values (rows of equal values) begin, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    new = keys[1:] != keys[:-1]
    return np.flatnonzero(np.concatenate([[True], new.any(axis=1) if new.ndim > 1 else new, [True]]))


def _bucket(c: np.ndarray, buckets: int) -> np.ndarray:
    return (c % _U(buckets)).astype(np.int64)


def _pair_rows(c: np.ndarray, code: np.ndarray, shards: int, buckets: int) -> pa.RecordBatch | None:
    """One row per bucket of texts: packed (text, code), texts as two numbers. On their way they pass any shard."""
    if not len(c):
        return None
    bucket = _bucket(c[:, 0], buckets)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = np.column_stack([c, code])[order], bucket[order]
    cuts = _groups(bucket)
    data = [rows[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]] % shards, pa.int32()), pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(data, pa.binary())], ["shard", "bucket", "blob"])


def _code_blobs(texts: DataFrame, width: int, shards: int, buckets: int) -> DataFrame:
    """Rows of two kinds: bucket -1 with the codes of a chunk's texts for one shard, packed, a code that several of the
    texts have only once and marked; bucket >= 0 with those texts and codes, which are shared for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def fresh():
            for b in batches:
                for c, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if c not in seen:
                        seen.add(c)
                        yield c, t.as_py() or b""

        for group in pieces(fresh(), width):
            data, at, piece = _windows(group, width)
            code = codes(data, width)[at]
            names = list(dict.fromkeys(x for x, _, _ in group))
            number = {x: i for i, x in enumerate(names)}
            text = np.array([number[x] for x, _, _ in group], np.int32)[piece]
            first = _groups(np.column_stack([code, piece.astype(_U)]))[:-1]
            code, text = code[first], text[first]
            del at, piece, first
            order = np.lexsort((text, code))  # a shard is a range of codes
            code, text = code[order], text[order]
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])
            code, text = code[new], text[new]
            cuts = _groups(code)
            size = np.diff(cuts)
            c = np.frombuffer(b"".join(names), "<u8").reshape(-1, 2)
            several = np.repeat(size > 1, size)
            shard = _shard(code, shards)
            both = _pair_rows(c[text[several]], code[several] & _LOW | shard[several].astype(_U) << _U(40), shards, buckets)
            if both is not None:
                yield both
            code, text, shard, mark = code[cuts[:-1]], text[cuts[:-1]], shard[cuts[:-1]], size > 1
            cuts, out = _groups(shard), []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                some, place = np.unique(text[x:y], return_inverse=True)
                low = code[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                place = (2 * place + mark[x:y]).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                out.append(np.int64(y - x).tobytes() + low.tobytes() + place.tobytes() + c[some].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]], pa.int32()), pa.array(np.full(len(out), -1), pa.int64()), pa.array(out, pa.binary())], ["shard", "bucket", "blob"])

    return texts.mapInArrow(tidy(run), "shard int, bucket long, blob binary")


def _read_codes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a blob, the place of each one's text, marks, and the texts."""
    m = int(np.frombuffer(blob, "<i8", 1)[0])
    low, place = np.zeros((m, 8), np.uint8), np.zeros((m, 4), np.uint8)
    low[:, :5] = np.frombuffer(blob, np.uint8, 5 * m, 8).reshape(m, 5)
    place[:, :3] = np.frombuffer(blob, np.uint8, 3 * m, 8 + 5 * m).reshape(m, 3)
    place = place.view("<u4").ravel()
    return low.view("<u8").ravel(), (place >> 1).astype(np.int32), (place & 1).astype(bool), np.frombuffer(blob[8 + 8 * m :], "<u8").reshape(-1, 2)


def _shared_codes(blobs: DataFrame, shards: int, buckets: int) -> DataFrame:
    """c, codes: the codes of text c that another text has too (shard number above 40 low bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            ready = pa.compute.greater_equal(b.column(1), 0)
            yield b.filter(ready)
            left = b.filter(pa.compute.invert(ready))
            for s, blob in zip(left.column(0).to_pylist(), left.column(2), strict=True):
                held.setdefault(s, []).append(_read_codes(blob.as_py()))
        for s in list(held):
            parts = held.pop(s)
            texts = np.concatenate([p[3] for p in parts])
            starts = np.cumsum([0] + [len(p[3]) for p in parts])
            order = np.lexsort((texts[:, 1], texts[:, 0]))  # a text has one number, whichever task sent it
            cuts = _groups(texts[order])
            number = np.empty(len(texts), np.int32)
            number[order] = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            names = texts[order[cuts[:-1]]]
            low, mark = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
            text = np.concatenate([number[p[1] + x] for p, x in zip(parts, starts, strict=False)])
            del parts, texts, number
            order = np.lexsort((text, low))
            low, text, mark = low[order], text[order], mark[order]
            cuts = _groups(low)
            other = np.maximum.reduceat(text, cuts[:-1]) != np.minimum.reduceat(text, cuts[:-1])
            on = np.repeat(other | np.logical_or.reduceat(mark, cuts[:-1]), np.diff(cuts)) & ~mark
            rows = _pair_rows(names[text[on]], low[on] | _U(s << 40), shards, buckets)
            if rows is not None:
                yield rows

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [np.frombuffer(v.as_py(), "<u8").reshape(-1, 3) for b in batches for v in b.column(2)]
        if some:
            every = np.concatenate(some)
            del some
            every = every[np.lexsort((every[:, 1], every[:, 0]))]
            cuts = _groups(every[:, :2])
            found = [np.unique(every[x:y, 2]).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in every[cuts[:-1], :2]], pa.binary()), pa.array(found, pa.binary())], ["c", "codes"])

    packed = blobs.repartition(shards, "shard").mapInArrow(tidy(run), "shard int, bucket long, blob binary")
    return packed.repartition(buckets, "bucket").mapInArrow(tidy(gather), "c binary, codes binary")


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover (touching ones are one run)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[first], end[np.concatenate([first[1:] - 1, [len(end) - 1]])]


def _span_rows(row: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """One row per bucket of documents: packed (document as three numbers, start, end)."""
    if not len(row):
        return None
    bucket = _bucket(row[:, 1] ^ row[:, 0], buckets)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = np.column_stack([row, start.astype(_U), end.astype(_U)])[order], bucket[order]
    cuts = _groups(bucket)
    data = [rows[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(data), -1), pa.int32()), pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(data, pa.binary())], ["shard", "bucket", "data"])


def _gathered(rows: DataFrame, buckets: int) -> DataFrame:
    """order, c, spans: the merged (start, end) pairs of each document, from the packed rows of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(v.as_py(), "<u8").reshape(-1, 5) for b in batches for v in b.column(1)]
        if parts:
            every = np.concatenate(parts)
            del parts
            every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
            cuts = _groups(every[:, :3])
            spans = [np.stack(_merged(every[x:y, 3].view(np.int64), every[x:y, 4].view(np.int64)), axis=1).astype("<i8").tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(every[cuts[:-1], 0].view(np.int64), pa.int64()), pa.array([x.tobytes() for x in every[cuts[:-1], 1:3]], pa.binary()), pa.array(spans, pa.binary())], ["order", "c", "spans"])

    return rows.repartition(buckets, "bucket").mapInArrow(tidy(run), "order long, c binary, spans binary")


def _strings(candidates: DataFrame, width: int, shards: int, routes: int, buckets: int) -> DataFrame:
    """Rows of two kinds: shard >= 0 with packed strings for that shard; shard -1 with spans that are
    decided already, since the same string stands in a smaller document of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts():
            for b in batches:
                for order, c, t, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                    yield (order, c, some.as_py()), t.as_py() or b""

        for group in pieces(texts(), width):
            data, at, piece = _windows(group, width)
            code = codes(data, width)[at]
            cuts = _groups(np.column_stack([code, piece.astype(_U)]))
            first, size = cuts[:-1], np.diff(cuts) + width - 1
            code, piece, at = code[first], piece[first], at[first]
            mine = (code & _LOW) | (_shard(code, shards).astype(_U) << _U(40))
            wanted = np.zeros(len(code), dtype=bool)
            cut = np.searchsorted(piece, np.arange(len(group) + 1))
            for i, ((_, _, some), _, _) in enumerate(group):
                wanted[cut[i] : cut[i + 1]] = np.isin(mine[cut[i] : cut[i + 1]], np.frombuffer(some, "<u8"))
            code, piece, at, size = code[wanted], piece[wanted], at[wanted], size[wanted]
            if not len(code):
                continue
            name = _names(data.tobytes(), at, size)
            row = np.array([(x & ((1 << 64) - 1), *np.frombuffer(c, "<u8").tolist()) for (x, c, _), _, _ in group], dtype=_U)[piece]
            owner = row[:, 0].astype(np.int64)
            offset = np.array([x for _, x, _ in group], dtype=np.int64)[piece]
            begin = np.cumsum([0] + [len(p) for _, _, p in group])[piece]
            start = at - begin + offset
            order = np.lexsort((owner, name))
            new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
            least = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            over = order[owner[order] > least]
            decided = _span_rows(row[over], start[over], (start + size)[over], buckets)
            if decided is not None:
                yield decided
            keep = order[owner[order] == least]
            new = np.concatenate([[True], name[keep][1:] != name[keep][:-1]])
            route = _shard(mix(code[keep]), routes)
            by = np.argsort(route, kind="stable")
            keep, new, route = keep[by], new[by], route[by]  # equal strings have one code, so stay together
            cuts = _groups(route)
            out = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                k, one = keep[x:y], keep[x:y][new[x:y]]
                ends = np.cumsum(size[one])
                text = data[np.repeat(at[one] - (ends - size[one]), size[one]) + np.arange(ends[-1])]
                number = (np.cumsum(new[x:y]) - 1).astype("<i4")
                head = np.array([len(one), len(k)], dtype="<i8").tobytes()
                out.append(head + code[one].astype("<u8").tobytes() + size[one].astype("<u4").tobytes() + number.tobytes() + row[k].astype("<u8").tobytes() + start[k].astype("<i8").tobytes() + text.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(route[cuts[:-1]], pa.int32()), pa.array(np.zeros(len(out)), pa.int64()), pa.array(out, pa.binary())], ["shard", "bucket", "data"])

    return candidates.mapInArrow(tidy(run), "shard int, bucket long, data binary")


class Shard:
    """Strings of one shard with the documents that hold them."""

    def __init__(self, blobs: list[bytes]):
        code, size, number, row, start, text, n = [], [], [], [], [], [], 0
        while blobs:
            b = blobs.pop()
            u, m = np.frombuffer(b, "<i8", 2)
            at = 16
            for kind, count, into in (("<u8", u, code), ("<u4", u, size), ("<i4", m, number), ("<u8", 3 * m, row), ("<i8", m, start)):
                into.append(np.frombuffer(b, kind, int(count), at))
                at += into[-1].nbytes
            number[-1] = number[-1].astype(np.int64) + n
            n += int(u)
            text += [b[at + e - s : at + e] for s, e in zip(size[-1].tolist(), np.cumsum(size[-1].astype(np.int64)).tolist(), strict=True)]
        # One number per distinct string.
        known: dict[bytes, int] = {}
        to = np.array([known.setdefault(t, len(known)) for t in text], dtype=np.int64)
        self.texts = list(known)
        self.code = np.zeros(len(known), _U)
        self.code[to] = np.concatenate(code)
        self.number, self.row, self.start = to[np.concatenate(number)], np.concatenate(row).reshape(-1, 3), np.concatenate(start)
        self.owner = self.row[:, 0].astype(np.int64)
        self.least = np.full(len(known), LAST, dtype=np.int64)
        np.minimum.at(self.least, self.number, self.owner)

    def spans(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrence, start, end) of what is to go from the documents."""
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        over = np.flatnonzero(self.owner > self.least[self.number])
        found = [(over, self.start[over], self.start[over] + sizes[self.number[over]])]
        # Strings whose code has others: their windows are grouped by suffix arrays, the strings of a code in one.
        order = np.argsort(self.code, kind="stable")
        cuts = _groups(self.code[order])
        total = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
        at = np.flatnonzero(self.owner == self.least[self.number])  # occurrences in a string's least document (others
        at = at[np.argsort(self.number[at], kind="stable")]  # lose the whole string already)
        some, held = [], 0
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if y - x > 1:
                size = int(total[y] - total[x])
                if some and held + size > SORTED_BYTES:
                    found.append(self._windows(np.concatenate(some), sizes, width, at))
                    some, held = [], 0
                some.append(order[x:y])
                held += size
        if some:
            found.append(self._windows(np.concatenate(some), sizes, width, at))
        return tuple(np.concatenate([f[j] for f in found]) for j in range(3))

    def _windows(self, several: np.ndarray, sizes: np.ndarray, width: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The part of ``spans`` that one suffix array over the strings ``several`` tells."""
        s = np.frombuffer(b"".join([self.texts[i] + b"\0" for i in several]), np.uint8).astype(np.int16) + np.int16(1)
        lens = sizes[several]
        ends = np.cumsum(lens + 1) - 1
        s[ends] = 0
        of = np.repeat(np.arange(len(several), dtype=np.int32), lens + 1)
        sa = suffix_array(s, 257)
        shared = common_prefixes(s, sa)
        first = np.flatnonzero(shared[sa] < width)  # the first suffix of each group of equal windows
        least = self.least[several]
        low = np.minimum.reduceat(least[of[sa]], first)
        gone = np.empty(len(s), dtype=bool)
        gone[sa] = np.repeat(low, np.diff(np.append(first, len(sa)))) < least[of[sa]]
        p = np.flatnonzero(gone & (np.arange(len(s)) + width <= ends[of]))
        new = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (of[p[1:]] != of[p[:-1]])]) if len(p) else np.zeros(0, dtype=bool)
        x, y = p[new], p[np.append(new[1:], True)] if len(p) else p
        begin = ends - lens
        string, x, y = several[of[x]], x - begin[of[x]], y - begin[of[y]] + width
        lo, hi = np.searchsorted(self.number[at], string), np.searchsorted(self.number[at], string, side="right")
        run = np.repeat(np.arange(len(string)), hi - lo)
        which = at[np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[run]]
        return which, self.start[which] + x[run], self.start[which] + y[run]


def _decided(strings: DataFrame, width: int, routes: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                held.setdefault(s, []).append(blob.as_py())
        for s in list(held):
            shard = Shard(held.pop(s))
            at, start, end = shard.spans(width)
            rows = _span_rows(shard.row[at], start, end, buckets)
            if rows is not None:
                yield rows

    return strings.repartition(routes, "shard").mapInArrow(tidy(run), "shard int, bucket long, data binary")


def _identity(key: str, text: str) -> list:
    """Columns that tell a row's verdict: its id (null: the greatest) and 128 bits of its text's digest."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return [F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("__r_order"), F.unhex(F.substring(F.sha2(t, 256), 1, 32)).alias("__r_c")]


def repeated_spans(docs: DataFrame, width: int = 50, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """What goes: (order, c, spans) with packed, merged (start, end) byte pairs, and (order, c) of documents whose whole
    text stands in a smaller document; and the written tables that both read. order and c are those of ``_identity``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    long = docs.filter(F.octet_length(t) >= width).select(*_identity(key, text), t.alias("t")).toDF("order", "c", "t")
    known = materialize(long.select("order", "c", F.octet_length("t").cast("long").alias("n")), "repeat-known")
    least = materialize(known.groupBy("c").agg(F.min("order").alias("least")), "repeat-least")
    # Written tables on both sides: adaptive execution splits the rows of a text with very many copies.
    copies = materialize(known.join(least, "c").filter("order > least").select("order", "c"), "repeat-copies")
    total = known.agg(F.sum("n")).first()[0] or 0
    shards = max(12, -(-2 * total // ((width - min(GRAM, width) + 2) * SHARD_CODES)))
    shared = materialize(_shared_codes(_code_blobs(long.select("c", "t"), width, shards, shards), shards, shards), "repeat-codes")
    wanted = shared.join(least.withColumnRenamed("least", "order"), "c")
    candidates = long.join(wanted, ["order", "c"]).select("order", "c", "t", "codes")
    strings = materialize(_strings(candidates, width, shards, shards, shards), "repeat-strings")
    discard(shared, known, least)
    spans = strings.filter("shard < 0").select("bucket", "data").unionByName(_decided(strings.filter("shard >= 0"), width, shards, shards).select("bucket", "data"))
    return _gathered(spans, shards), copies.distinct(), [strings, copies]


def remove_repeats(docs: DataFrame, width: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a struct column ``repeats`` (an input column of that name is replaced).

    Fields: n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the bytes left). Null text is empty;
    texts shorter than the width lose nothing. Null ids count as the greatest. Rows with equal ids do not make each
    other lose anything, so repeated rows are judged alike. No rows give no rows. Strings are judged on the input.
    """
    names = [c for c in docs.columns if c != "repeats"]
    spans, copies, held = repeated_spans(docs, width, key, text)
    row = ["order", "c"]
    verdict = spans.join(copies, row, "left_anti").withColumn("copy", F.lit(False)).unionByName(copies.select(*row, F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("copy")))
    verdict = materialize(verdict.toDF("__r_order", "__r_c", "__r_spans", "__r_copy"), "repeat-spans")
    discard(*held)
    joined = docs.select(*[F.col(f"`{c}`") for c in names], *_identity(key, text)).join(verdict, ["__r_order", "__r_c"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], _cut(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), F.col("__r_spans"), F.coalesce("__r_copy", F.lit(False))).alias("repeats"))


def _kept(t: pd.Series, spans: pd.Series, copy: pd.Series) -> pd.DataFrame:
    out = []
    for x, some, whole in zip(t, spans, copy, strict=True):
        if whole:
            out.append((len(x), len(x), 1, b""))
        elif some is None or not len(some):
            out.append((len(x), 0, 0, bytes(x)))
        else:
            start, end = np.frombuffer(some, "<i8").reshape(-1, 2).T
            edges = zip([0, *end.tolist()], [*start.tolist(), len(x)], strict=True)
            out.append((len(x), int((end - start).sum()), len(start), b"".join([x[a:b] for a, b in edges])))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def _cut(text, spans, copy):
    return F.pandas_udf(_kept, "n_bytes long, n_removed long, n_spans long, kept binary")(text, spans, copy)


def query(spark, sf_dir: str) -> DataFrame:
    from ._base import table

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM d, LATERAL (SELECT unnest(range(0, n - 49)) AS p) WHERE n >= 50),
g AS (SELECT doc_id, p FROM w QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
i AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM g),
j AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM j GROUP BY doc_id, k),
u AS (SELECT s.*, d.h, lag(b, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY a) AS before FROM s JOIN d ON s.doc_id = d.doc_id),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM u GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
