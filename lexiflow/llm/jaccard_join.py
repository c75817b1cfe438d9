"""Exact Jaccard similarity join of shingle sets by parity sketches.

A shingle's hash is a place: a block, and a bit of 2 ** 32 in it. Each shingle of a set toggles its bit, so the Hamming
distance of two sketches is at most the size of the symmetric difference of the sets. A block is kept as the XOR of
the hashes of its odd bits, which tells whether it equals another one. Sets are joined within size bands only. If a
band allows a symmetric difference of at most D and its sketches have D + 1 + s blocks, two linked sets agree in at
least s + 1 blocks: each set may leave out its s least telling blocks (fewest bits; both sets leave out alike) and
still meets the other in a block that both kept. Sets that meet compare whole sketches, all blocks folded to
``SKETCH_BITS`` bits (a fold toggles a bit a shingle as well, so its distance is a bound too); pairs whose Hamming
distance passes what their sizes allow go, and the rest is verified on the whole shingle sets.

Documents with equal sets are one class from the start and never paired. Classes that meet in a block form a list,
and classes that lists connect a family. Families are cut into tiles of bounded size around hubs, the heaviest
classes; a tile of a hub has the hub as well. Tiles are compared within; then only
lists that still hold several components go on, and only with sketches: those whose sketches leave room for a link are
candidates, and only candidates meet whole sets again, first one pair of any two components, then what that leaves
apart. So texts that share a passage without linking cost a sketch for each of their lists, not their sets in every tile.

Blocks travel as packed arrays. Nothing is capped, and no table but those of one task's share is held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import discard, few, materialize, tidy
from ._graph import components
from ._words import mix, shingles

_U = np.uint64
CHUNK_BYTES = 2 << 20  # text hashed at once, unless one text has more
SHARD_BYTES = 12 << 20  # packed block keys that one task should get
TILE, TILE_SHINGLES = 256, 1 << 19  # sets, and shingles of all its sets, that a tile should have
KEY_BYTES = 7  # of a packed block: 5 of its key, 2 of its class
SKETCH_BITS = 2048
#: Sets, and bytes of their sketches, of a list that are compared at once.
MEET, MEET_BYTES = 1024, 1 << 20


class Bands:
    """Size bands for links at ``percent`` or more: linked sets lie in one band or in neighbours.

    Group g joins band g with itself and with band g + 1.
    """

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, -(-100 * edges[-1] // percent)))
        self.edges = np.array(edges, dtype=np.int64)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, side="right") - 1

    def differ(self, total: int) -> int:
        """Greatest symmetric difference of linked sets with ``total`` elements together."""
        need = -(-self.percent * total // (100 + self.percent))
        return total - 2 * need

    def blocks(self, group: int) -> tuple[int, int]:
        """Blocks of the group's sketches, and how many of them a set leaves out. No blocks: equal sets only."""
        a = int(self.edges[group + 1]) - 1
        most = a + min(int(self.edges[group + 2]) - 1, 100 * a // self.percent)
        d = max(self.differ(t) for t in range(max(2, most - 4 * (100 + self.percent)), most + 1))
        if d == 0:
            return 0, 0
        spare = max(2, -(-(d + 1) * 15 // 100))
        return d + 1 + spare, spare


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of lower-cased texts of bounded size, with the place of the first."""
    at, part, size = 0, [], 0
    for i, v in enumerate(column.cast(pa.binary())):
        part.append((v.as_py() or b"").lower())
        size += len(part[-1])
        if size >= CHUNK_BYTES:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


def set_ids(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A 64-bit id and a 128-bit digest of each set of ascending hashes."""
    import hashlib

    ends = np.cumsum(n)
    digests = [hashlib.blake2b(hashes[e - k : e].tobytes(), digest_size=16).digest() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), dtype="<i8")[::2].copy() if digests else np.zeros(0, "<i8"), digests


def block_keys(hashes: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of every kept block of every set, for both groups that its band takes part in."""
    owners, keys = [], []
    band = bands.band(np.maximum(n, 1))
    owner = np.repeat(np.arange(len(n)), n)
    for shift in (0, 1):
        for g in np.unique(band[n > 0] - shift):
            count, spare = bands.blocks(int(g)) if g >= 0 else (0, 0)
            if not count:
                continue
            sets = np.flatnonzero((band == g + shift) & (n > 0))
            of = np.full(len(n), -1)
            of[sets] = np.arange(len(sets))
            on = of[owner] >= 0
            with np.errstate(over="ignore"):
                h = mix(hashes[on] ^ _U(0xA5A5 + 977 * int(g)))
            place = of[owner[on]] * count + ((h >> _U(32)) * _U(count) >> _U(32)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, bits = place[order], mix(h[order] & _U((1 << 32) - 1))  # the hash of the bit's number in its block
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            parity, weight = np.zeros(len(sets) * count, _U), np.zeros(len(sets) * count, np.int64)
            parity[place[first]] = np.bitwise_xor.reduceat(bits, first)
            weight[place[first]] = np.diff(np.concatenate([first, [len(place)]]))
            block = np.tile(np.arange(count), len(sets))
            rank = np.lexsort((block, weight, np.repeat(np.arange(len(sets)), count))).reshape(len(sets), count)[:, spare:].ravel()
            with np.errstate(over="ignore"):
                keys.append(mix(parity[rank] + mix(block[rank].astype(_U) * _U(1 << 20) + _U(int(g)))))
            owners.append(sets[rank // count])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(owners), np.concatenate(keys)


def sketches(owner: np.ndarray, hashes: np.ndarray, count: int) -> np.ndarray:
    """Parity sketches of sets, given as (set number, element) pairs: 64-bit words, a row for each of ``count`` sets."""
    at = (mix(hashes) >> _U(40)).astype(np.int64) % SKETCH_BITS
    odd = (np.bincount(owner * SKETCH_BITS + at, minlength=count * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(count, SKETCH_BITS), axis=1).view(_U)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each sketch of ``a`` from each of ``b``."""
    out = np.empty((len(a), len(b)), np.int64)
    step = max(1, (1 << 20) // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.bitwise_count(a[i : i + step, None, :] ^ b[None, :, :]).sum(2)
    return out


def sized_sketch(hashes: np.ndarray) -> bytes:
    """A parity sketch of twice to four times as many bits as the set has elements, 512 to 65,536."""
    bits = 1 << min(16, max(9, (2 * len(hashes) - 1).bit_length()))
    at = (mix(hashes) >> _U(40)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(rows: list[bytes], width: int) -> np.ndarray:
    """Sketches of one width as 64-bit words, folded to ``width`` bytes."""
    x = np.frombuffer(b"".join(rows), _U).reshape(len(rows), -1)
    while 8 * x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def candidates(part: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places of sets with different labels whose sketches leave room for a link, and their distance as a share
    of both sizes; with several parts, pairs between parts only."""
    width, out = np.array([len(s) for s in sketch]), []
    within = part.min() == part.max()
    for u in np.unique(width).tolist():
        for v in np.unique(width[width >= u]).tolist():
            i, j = np.flatnonzero(width == u), np.flatnonzero(width == v)
            if 100 * min(n[i].max(), n[j].max()) < percent * max(n[i].min(), n[j].min()):
                continue
            x, y = _folded([sketch[k] for k in i], u), _folded([sketch[k] for k in j], u)
            for at in range(0, len(i), 256):
                some = i[at : at + 256]
                apart = label[some][:, None] != label[j][None, :]
                if not within:
                    apart &= part[some][:, None] != part[j][None, :]
                if u == v:
                    apart &= some[:, None] < j[None, :]
                rows, columns = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
                if not len(rows):
                    continue
                some, other = some[rows], j[columns]
                distance = hamming(x[at : at + 256][rows], y[columns])
                a, b = np.nonzero(may_link(distance, n[some], n[other], percent) & apart[np.ix_(rows, columns)])
                out.append((some[a], other[b], distance[a, b] / (n[some[a]] + n[other[b]])))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def may_link(distance: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether a distance leaves room for a link of sets of these sizes."""
    total = n[:, None] + m[None, :]
    return distance <= total - 2 * -(-percent * total // (100 + percent))


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, c (64-bit id of the set) and digest of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _texts(b.column(1)):
                h, n = shingles(texts, k)
                c, digests = set_ids(h, n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "n", "c", "digest"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, c long, digest binary")


def _blobs(docs: DataFrame, k: int, bands: Bands, shards: int) -> DataFrame:
    """shard, keys: packed blocks of the shard from one chunk of documents (classes, 5-byte keys, class numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes that this task has sent: copies add nothing
        for b in batches:
            for _, texts in _texts(b.column(0)):
                h, n = shingles(texts, k)
                c, _ = set_ids(h, n)
                fresh = np.zeros(len(n), dtype=bool)
                for i, x in enumerate(c.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                h, n, c = h[np.repeat(fresh, n)], n[fresh], c[fresh]
                for part in range(0, len(n), 1 << 16):
                    lo, hi = n[:part].sum(), n[: part + (1 << 16)].sum()
                    owner, key = block_keys(h[lo:hi], n[part : part + (1 << 16)], bands)
                    shard = ((key >> _U(32)) * _U(shards) >> _U(32)).astype(np.int32)
                    order = np.lexsort((key, shard))
                    shard, key, owner = shard[order], key[order], owner[order]
                    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, int)
                    ids, out = c[part : part + (1 << 16)], []
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                        some, number = np.unique(owner[x:y], return_inverse=True)
                        low = (key[x:y] & _U((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                        out.append((int(shard[x]), np.int64(y - x).tobytes() + low.tobytes() + number.astype("<u2").tobytes() + ids[some].astype("<i8").tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([o for _, o in out], pa.binary())], ["shard", "keys"])

    return docs.select("text").mapInArrow(tidy(run), "shard int, keys binary")


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int(np.frombuffer(blob, "<i8", 1)[0])
    wide = np.zeros((m, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * m, 8).reshape(m, 5)
    ids = np.frombuffer(blob[8 + 7 * m :], "<i8")
    return wide.view("<u8").ravel(), ids[np.frombuffer(blob, "<u2", m, 8 + 5 * m)]


def _lists(blobs: DataFrame, shards: int) -> DataFrame:
    """members: ascending class ids that share a block, two or more; each list once per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(s, []).append(_unpack(blob.as_py()))
        for s in list(held):
            parts = held.pop(s)
            key, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((c, key))
            key, c = key[order], c[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (c[1:] != c[:-1])])
            key, c = key[new], c[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            found, out, room = set(), [], 0
            for x, y in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                members = c[x : x + y].tobytes()
                if members not in found:
                    found.add(members)
                    out.append(c[x : x + y])
                    room += y
                if room > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["members"])
                    out, room = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["members"])

    return blobs.repartition(shards, "shard").mapInArrow(tidy(run), "members array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """c, digest, n, hashes of the classes in ``wanted`` (doc_id of one document each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in _texts(b.column(1)):
                h, n = shingles(texts, k)
                c, digests = set_ids(h, n)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array([h[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], ["c", "digest", "n", "hashes"])

    return docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidy(run), "c long, digest binary, n long, hashes binary").dropDuplicates(["c", "digest"])


def _forest(numbers: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what the given links (pairs of places in ``numbers``) connect, without cycles."""
    root = list(range(len(numbers)))
    out: tuple[list[int], list[int]] = ([], [])
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = i, j
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            out[0].append(int(numbers[i]))
            out[1].append(int(numbers[j]))
    return out


def _shared(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, each side given as (set number, element) pairs; by products of 0/1 blocks
    over the elements that both sides have."""
    rows, columns = int(left[0].max()) + 1, int(right[0].max()) + 1
    known, at = np.unique(left[1], return_inverse=True)
    place = np.searchsorted(known, right[1])
    place[place == len(known)] = 0
    both = known[place] == right[1]
    used, col_r = np.unique(place[both], return_inverse=True)
    row_r = right[0][both]
    slot = np.full(len(known), -1)
    slot[used] = np.arange(len(used))
    on = slot[at] >= 0
    row_l, col_l = left[0][on], slot[at[on]]
    out = np.zeros((rows, columns), dtype=np.float32)
    order_l, order_r = np.argsort(col_l, kind="stable"), np.argsort(col_r, kind="stable")
    row_l, col_l, row_r, col_r = row_l[order_l], col_l[order_l], row_r[order_r], col_r[order_r]
    for k in range(0, len(used), 4096):
        a, b = np.zeros((rows, 4096), np.float32), np.zeros((columns, 4096), np.float32)
        x, y = np.searchsorted(col_l, [k, k + 4096])
        a[row_l[x:y], col_l[x:y] - k] = 1
        x, y = np.searchsorted(col_r, [k, k + 4096])
        b[row_r[x:y], col_r[x:y] - k] = 1
        out += a @ b.T
    return out.astype(np.int64)


class Tile:
    """Sets that are compared together."""

    def __init__(self, blob: bytes):
        m = int(np.frombuffer(blob, "<i8", 1)[0])
        self.reps, self.families, self.n = (np.frombuffer(blob, "<i8", m, 8 + 8 * m * j) for j in range(3))
        self.hashes = np.frombuffer(blob, "<u8", -1, 8 + 24 * m)
        self.ends = np.cumsum(self.n)
        self.sketches = sketches(np.repeat(np.arange(m), self.n), self.hashes, m)

    @staticmethod
    def pack(reps, families, n, hashes: list[bytes]) -> bytes:
        order = np.argsort(families, kind="stable")
        head = [np.array(x, dtype="<i8")[order].tobytes() for x in (reps, families, n)]
        return np.int64(len(order)).tobytes() + b"".join(head) + b"".join([hashes[i] for i in order])

    def part(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[some]
        at = np.repeat(self.ends[some] - np.cumsum(n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(some)), n), self.hashes[at]

    def inner(self, percent: int) -> tuple[list[int], list[int]]:
        """Links within each family of the tile."""
        out: tuple[list[int], list[int]] = ([], [])
        cuts = np.flatnonzero(np.concatenate([[True], self.families[1:] != self.families[:-1], [True]]))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if y - x > 1:
                near = may_link(hamming(self.sketches[x:y], self.sketches[x:y]), self.n[x:y], self.n[x:y], percent)
                np.fill_diagonal(near, False)
                some = x + np.flatnonzero(near.any(1))
                if len(some):
                    p = self.part(some)
                    a, b = np.nonzero(np.triu(_linked(_shared(p, p), self.n[some], self.n[some], percent), 1))
                    found = _forest(self.reps[some], a, b)
                    out[0].extend(found[0])
                    out[1].extend(found[1])
        return out

    def across(self, percent: int) -> tuple[list[int], list[int]]:
        """Links between the tile's families, which are components here."""
        apart = self.families[:, None] != self.families[None, :]
        some = np.flatnonzero((may_link(hamming(self.sketches, self.sketches), self.n, self.n, percent) & apart).any(1))
        if not len(some):
            return [], []
        p, n = self.part(some), self.n[some]
        a, b = np.nonzero(np.triu(_linked(_shared(p, p), n, n, percent) & apart[np.ix_(some, some)], 1))
        numbers, at = np.unique(self.families[some], return_inverse=True)
        return _forest(numbers, at[a], at[b])


def _linked(shared: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n[:, None] + m[None, :] - shared)


def _tiled(members: DataFrame) -> DataFrame:
    """rep, family, tile, large, hub, of every class that shares a list. Classes that lists connect are a family. A small
    family lies in one tile; a larger one is cut by the hub (the heaviest class met) and, for a large hub, by hash."""
    size = members.groupBy("list").agg(F.count("*").alias("size"))
    weight = members.join(size, "list").groupBy("rep").agg(F.sum("size").alias("weight"))
    hub = members.join(weight, "rep").groupBy("list").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    met = members.join(hub, "list").groupBy("rep", "hub").agg(F.count("*").alias("times"), F.first("n").alias("n"))
    met = materialize(met, "join-met")
    family = components(met.select(F.col("rep").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    own = met.groupBy("rep").agg(F.max_by("hub", F.struct(F.col("times"), -F.col("hub"))).alias("hub"), F.first("n").alias("n")).join(family, "rep")
    need = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).alias("tiles")
    of_family = own.groupBy("family").agg(need, F.count("*").alias("count"), F.sum("n").alias("sum")).withColumnRenamed("tiles", "family_tiles")
    of_hub = own.groupBy("family", "hub").agg(need).withColumnRenamed("tiles", "hub_tiles")
    small = of_family.filter("family_tiles <= 1").agg(F.ceil(F.greatest(F.sum("count") / TILE, F.sum("sum") / TILE_SHINGLES)).alias("t")).first()[0] or 1
    some = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 62))
    tile = (
        F.when(F.col("family_tiles") <= 1, F.xxhash64(F.lit(0), some("family") % int(small)))
        .when(F.col("hub_tiles") <= 1, F.xxhash64(F.lit(1), "family", some("hub") % F.col("family_tiles")))
        .otherwise(F.xxhash64(F.lit(2), "family", "hub", some("rep") % F.col("hub_tiles")))
    )
    return own.join(of_family, "family").join(of_hub, ["family", "hub"]).select("rep", "family", tile.alias("tile"), (F.col("family_tiles") > 1).alias("large"), "hub")


_CELL = ["g", "lo", "hi"]


def _chunks(count: int, sum_of: str, room: int):
    return F.ceil(F.greatest(F.count("*") / count, F.sum(sum_of) / room)).cast("int").alias("chunks")


def _cell(i, j) -> list:
    return [F.least(i, j).cast("int").alias("lo"), F.greatest(i, j).cast("int").alias("hi")]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, given in the order of the cells."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cell = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1), [True]])).tolist()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(cell[x]) != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
            key = tuple(cell[x])
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with the cells' columns, a cell in one task and in one piece."""
    return rows.select(*_CELL, *columns).repartition(*_CELL).sortWithinPartitions(*_CELL)


def _candidates(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, la, lb, d: classes of different components (labels: rep, label) that share a list and whose sketches leave
    room for a link; la < lb. Parts of a long list meet in pairs."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sized_sketch(np.frombuffer(h.as_py(), "<u8")) for h in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(x) for x in made], pa.int64()), pa.array(made, pa.binary())], ["rep", "label", "n", "bytes", "sketch"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            part, rep, label, n = (t[c].to_numpy() for c in ("part", "rep", "label", "n"))
            a, b, d = candidates(part, label, n, t["sketch"].to_pylist(), percent)
            swap = label[a] > label[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            for x in range(0, len(a), 1 << 16):
                u, v = a[x : x + (1 << 16)], b[x : x + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in (rep[u], rep[v], label[u], label[v], d[x : x + (1 << 16)])], ["a", "b", "la", "lb", "d"])

    own = members.select("list", "rep").join(few(labels), "rep")
    mixed = own.groupBy("list").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("list")
    own = materialize(own.join(mixed, "list").select("list", "rep"), "join-mixed")
    made = sets.join(few(labels), "rep").select("rep", "label", "n", "hashes")
    made = materialize(made.mapInArrow(tidy(sketch), "rep long, label long, n long, bytes long, sketch binary"), "join-sketches")
    chunks = own.join(made.select("rep", "bytes"), "rep").groupBy(F.col("list").alias("g")).agg(_chunks(MEET, "bytes", MEET_BYTES))
    placed = own.select(F.col("list").alias("g"), "rep", F.xxhash64("rep").alias("h")).join(chunks, "g").withColumn("part", F.pmod("h", "chunks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("g", *_cell("part", "other"), "part", "rep")
    found = _dealt(placed.join(made, "rep"), "part", "rep", "label", "n", "sketch").mapInArrow(tidy(near), "a long, b long, la long, lb long, d double")
    found = materialize(found.dropDuplicates(["a", "b"]), "join-near")
    discard(own, made)
    return found


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between components, of candidates (a, b, la, lb). Classes that candidates connect are a group, cut by
    hash; two parts of it meet in their classes that have a candidate there."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            found = Tile(Tile.pack(*(t[c].to_pylist() for c in ("rep", "label", "n", "hashes")))).across(percent)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["a", "b"])

    node = components(pairs.select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("g")).join(sets.select("rep", "n"), "rep")
    node = node.join(node.groupBy("g").agg(_chunks(TILE, "n", TILE_SHINGLES)), "g").select("rep", "g", F.pmod(F.xxhash64("rep"), "chunks").alias("c"))
    node = materialize(node, "join-group")
    met = pairs.join(node.select(F.col("rep").alias("a"), "g", F.col("c").alias("ca")), "a").join(node.select(F.col("rep").alias("b"), F.col("c").alias("cb")), "b")
    both = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("la").alias("label")), F.struct(F.col("b").alias("rep"), F.col("lb").alias("label"))))
    cells = materialize(met.select("g", *_cell("ca", "cb"), both.alias("x")).select(*_CELL, "x.rep", "x.label").distinct(), "join-cells")
    links = _dealt(sets.join(few(cells), "rep"), "rep", "label", "n", "hashes").mapInArrow(tidy(across), "a long, b long")
    links = materialize(links.distinct(), "join-links")
    discard(node, cells)
    return links


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between components (labels: rep, label) of classes that share a list."""
    near = _candidates(members, labels, sets, percent)
    # Many copies of two components pass, and one link joins them: one pair of any two first, then what stays apart.
    first = near.groupBy("la", "lb").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("x"))
    first = materialize(first.select("x.a", "x.b", "la", "lb"), "join-first")
    links = _verified(first, sets, percent)
    now = components(links)
    x, y = (now.select(F.col("node").alias(f"l{c}"), F.col("component").alias(f"n{c}")) for c in "ab")
    rest = near.join(x, "la", "left").join(y, "lb", "left").select("a", "b", F.coalesce("na", "la").alias("la"), F.coalesce("nb", "lb").alias("lb"))
    rest = materialize(rest.filter("la <> lb").join(first.select("a", "b"), ["a", "b"], "left_anti"), "join-rest")
    discard(near, first)
    return links if rest.isEmpty() else links.unionByName(_verified(rest, sets, percent))


def _connected(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, component (the least node) of the classes that links connect, found among the classes that share a list."""
    tiles = materialize(_tiled(members), "join-tiles")

    def pack(t: pa.Table) -> pa.Table:
        blob = Tile.pack(t["rep"].to_pylist(), t["family"].to_pylist(), t["n"].to_pylist(), t["hashes"].to_pylist())
        return pa.table({"tile": t["tile"][:1], "blob": pa.array([blob], pa.binary())})

    def packed(some: DataFrame, label: str) -> DataFrame:
        some = materialize(some, f"{label}-of")  # hashes are not shuffled for these while they are few
        return materialize(sets.join(few(some), "rep").groupBy("tile").applyInArrow(pack, "tile long, blob binary"), label)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                found = Tile(blob.as_py()).inner(percent)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["a", "b"])

    own = tiles.select("rep", "family", "tile")
    hubs = tiles.filter("large").select(F.col("hub").alias("rep"), "family", "tile")
    blobs = packed(own.unionByName(hubs).distinct(), "join-blobs")
    within = materialize(blobs.select("blob").mapInArrow(tidy(inner), "a long, b long"), "join-links")
    near = components(within)
    large = tiles.filter("large").select("rep")
    if large.isEmpty():
        discard(tiles, blobs, within)
        return near
    labels = materialize(large.join(near.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("label")), "join-labels")
    discard(tiles, blobs, within)
    links = _across(members, labels.select("rep", "label"), sets, percent)
    nodes = near.unionByName(labels.filter("label = rep").select(F.col("rep").alias("node"), F.col("label").alias("component"))).distinct()
    joined = components(links).select(F.col("node").alias("component"), F.col("component").alias("least"))
    return nodes.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def similar(docs: DataFrame, percent: int = 85, k: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set holds its distinct k-word shingles (ASCII lower-cased words between ASCII white space), or its
    whole word sequence if it has fewer words. Documents link if 100 * shared >= percent * union;
    component_id is the least doc_id that links reach. Null, empty and blank texts have no set and link with
    nothing. Null doc_ids: their rows are given, linked with nothing, with a null component. Repeated rows are one
    document that appears as often. Sets are compared as sets of 64-bit hashes. Other columns of ``docs`` are not read
    or returned, whatever their names. No rows give no rows.
    """
    bands = Bands(percent)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = materialize(_classes(rows, k), "join-classes")
    classes = materialize(known.filter("n > 0 and doc_id is not null").groupBy("c", "digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "join-reps")
    total = known.agg(F.sum("n")).first()[0] or 0
    shards = max(12, -(-int(total * 0.45 * KEY_BYTES) // SHARD_BYTES))
    lists = materialize(_lists(_blobs(rows.filter("doc_id is not null"), k, bands, shards), shards).distinct().withColumn("list", F.monotonically_increasing_id()), "join-lists")
    members = lists.select("list", F.explode("members").alias("c")).join(classes.select("c", "rep", "n"), "c").select("list", "rep", "n")
    members = materialize(members, "join-members")
    discard(lists)
    # Texts are not shuffled while the ids are few.
    wanted = materialize(members.select(F.col("rep").alias("doc_id")).distinct(), "join-wanted")
    sets = _sets(rows, few(wanted), k).join(classes.select("c", "digest", "rep"), ["c", "digest"])
    sets = materialize(sets.select("rep", "n", "hashes"), "join-sets")
    discard(wanted)
    component = _connected(members, sets, percent)
    # One row per class, written: the join of all documents has plain exchanges below it, so adaptive execution splits
    # the documents of a class that has very many.
    placed = materialize(classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("c", "digest", F.coalesce("component", "rep").alias("component")), "join-placed")
    discard(classes, members, sets)
    out = known.join(placed, ["c", "digest"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    from ._base import table

    return similar(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * shared >= 85 * (u.n + v.n - shared)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""
