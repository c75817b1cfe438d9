"""Token ids of whole texts from a table of distinct pieces, as array operations.

For tokenizers that lower-case a text and cut it into runs of letters, single digits and runs of marks, none of which
crosses ASCII white space. Pieces of ASCII and Latin-1 letters, digits and ASCII marks are found in the bytes of a
chunk of texts; a piece of up to 16 bytes is two 64-bit numbers, which are compared whole (a hash only sorts them).
Each distinct piece is encoded once. What needs the tokenizer's own normalisation or cutting (apostrophes, control and
other characters, special tokens) is handed over as a whole word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ._words import mix

_U = np.uint64
SPACE, LETTER, DIGIT, MARK, HARD = range(5)
WIDE = 16  # bytes of a piece that its two numbers hold
#: Pieces that a table remembers; a full table is emptied, so memory stays bounded.
TABLE_PIECES = 200_000
#: Bytes of text taken at once; longer texts are cut at white space.
PART_BYTES = 1 << 18

_KIND = np.full(256, HARD, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[33:127] = MARK
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[39] = HARD  # an apostrophe may begin a contraction
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)

Encoded = tuple[np.ndarray, np.ndarray]  # ids of all given pieces, and their number for each piece


def parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of bounded size that end before white space (a longer run without any is one part)."""
    at = 0
    while len(text) - at > PART_BYTES:
        cut = max(text.rfind(g, at + 1, at + PART_BYTES) for g in (b" ", b"\n", b"\t"))
        if cut < 0:
            cut = min((x for g in (b" ", b"\n", b"\t") if (x := text.find(g, at + PART_BYTES)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class PieceTable:
    """``bulk`` encodes lower-cased pieces, ``whole`` words as they stand; words with a special token are of the latter."""

    def __init__(self, bulk: Callable[[list[bytes]], Encoded], whole: Callable[[list[bytes]], Encoded], special: list[str]):
        self.bulk, self.whole, self.special = bulk, whole, [s.encode() for s in special]
        if any(not s or _KIND[np.frombuffer(s, np.uint8)].min() == SPACE for s in self.special):
            raise ValueError("special tokens with white space are not read")
        self.clear()

    def clear(self) -> None:
        self.hash, self.entry = np.zeros(0, _U), np.zeros(0, np.int64)  # ascending hashes, and their entries
        self.low, self.high = np.zeros(0, _U), np.zeros(0, _U)  # of an entry: its bytes
        self.at, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.other: dict[tuple[bool, bytes], int] = {}
        self.held = 0  # bytes of its words

    def _store(self, encoded: Encoded) -> np.ndarray:
        """New entries for encoded pieces."""
        ids, n = encoded
        entries = np.arange(len(self.n), len(self.n) + len(n))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.n, self.ids = np.concatenate([self.n, n]), np.concatenate([self.ids, ids])
        self.low, self.high = (np.concatenate([x, np.zeros(len(n), _U)]) for x in (self.low, self.high))
        return entries

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each one's ids end."""
        ids, ends, at, group, size = [], [], 0, [], 0

        def flush() -> None:
            nonlocal at, group, size
            if group:
                some, upto = self._encode([p for p, _ in group])
                ids.append(some)
                ends.extend((at + upto[[last for _, last in group]]).tolist())
                at, group, size = at + len(some), [], 0

        for t in texts:
            pieces = list(parts(t)) if len(t) > PART_BYTES else [t]
            for i, p in enumerate(pieces):
                if size + len(p) > 2 * PART_BYTES:
                    flush()
                group.append((p, i + 1 == len(pieces)))
                size += len(p)
        flush()
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.array(ends, dtype=np.int64)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        kind = _KIND[raw]
        low = np.zeros(n + 2 * WIDE, np.uint8)
        low[:n] = _LOWER[raw]
        lead = np.flatnonzero(raw == 0xC3)  # of a Latin-1 letter in UTF-8
        if len(lead):
            tail = raw[lead + 1]
            lead, tail = lead[(tail != 0x97) & (tail != 0xB7)], tail[(tail != 0x97) & (tail != 0xB7)]
            kind[lead] = kind[lead + 1] = LETTER
            low[lead[tail <= 0x9E] + 1] += 32
        for s in self.special:
            x = data.find(s)
            while x >= 0:
                kind[x] = HARD
                x = data.find(s, x + 1)
        hard = np.flatnonzero(kind == HARD)
        if len(hard):
            edge = np.flatnonzero(np.diff(np.concatenate([[True], kind == SPACE]).astype(np.int8)))  # a text ends with a gap
            word = np.unique(np.searchsorted(edge[0::2], hard, side="right") - 1)
            step = np.zeros(n + 1, np.int8)
            step[edge[0::2][word]] = 1
            step[edge[1::2][word]] = -1
            kind[np.cumsum(step[:n], dtype=np.int8) > 0] = HARD
        start = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)]))
        end = np.append(start[1:], n)
        on = kind[start] != SPACE
        start, end = start[on], end[on]
        entry = self._entries(data, low, start, end, kind[start] == HARD)
        count = self.n[entry]
        upto = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.at[entry] - upto[:-1], count) + np.arange(upto[-1])]
        stops = np.cumsum([len(t) + 1 for t in texts])
        return flat, upto[np.searchsorted(start, stops)]

    def _entries(self, data: bytes, low: np.ndarray, start: np.ndarray, end: np.ndarray, hard: np.ndarray) -> np.ndarray:
        """The entry of each piece (or whole word, if ``hard``); new ones are learnt."""
        size = end - start
        easy = np.flatnonzero(~hard & (size <= WIDE))
        if len(self.n) > TABLE_PIECES or len(self.ids) + self.held > 8 * TABLE_PIECES:
            self.clear()
        number = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        at, long = start[easy], size[easy]
        a = number[at] & _MASK[np.minimum(long, 8)]
        b = number[at + 8] & _MASK[np.maximum(long - 8, 0)]
        with np.errstate(over="ignore"):
            h = mix(a + mix(b + _U(0x9E3779B97F4A7C15)))
        out = np.full(len(start), -1, np.int64)
        if len(h):
            order = np.argsort(h)
            sorted_h = h[order]
            new_group = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
            group = np.empty(len(h), np.int64)
            group[order] = np.cumsum(new_group) - 1
            first = order[new_group]
            u, ua, ub = h[first], a[first], b[first]
            found = np.full(len(u), -1, np.int64)
            if len(self.hash):
                place = np.minimum(np.searchsorted(self.hash, u), len(self.hash) - 1)
                entry = self.entry[place]
                met = self.hash[place] == u
                same = met & (self.low[entry] == ua) & (self.high[entry] == ub)
                found[same] = entry[same]
                fresh = np.flatnonzero(~met)  # another piece of the same hash is left to the names below
            else:
                fresh = np.arange(len(u))
            if len(fresh):
                text = low.tobytes()
                some = at[first[fresh]], at[first[fresh]] + long[first[fresh]]
                entries = self._store(self.bulk([text[x:y] for x, y in zip(some[0].tolist(), some[1].tolist(), strict=True)]))
                self.low[entries], self.high[entries] = ua[fresh], ub[fresh]
                found[fresh] = entries
                where = np.searchsorted(self.hash, u[fresh])
                self.hash, self.entry = np.insert(self.hash, where, u[fresh]), np.insert(self.entry, where, entries)
            same = (a == ua[group]) & (b == ub[group])
            out[easy[same]] = found[group[same]]
        rest = np.flatnonzero(out < 0)
        if len(rest):
            bytes_low = low.tobytes()
            names = [(h, data[x:y] if h else bytes_low[x:y]) for h, x, y in zip(hard[rest].tolist(), start[rest].tolist(), end[rest].tolist(), strict=True)]
            for kind, f in ((True, self.whole), (False, self.bulk)):
                need = list({m: None for m in names if m[0] == kind and m not in self.other})
                for k in range(0, len(need), 1000):
                    some = need[k : k + 1000]
                    self.other.update(zip(some, self._store(f([w for _, w in some])).tolist(), strict=True))
                    self.held += sum(len(w) for _, w in some)
            out[rest] = [self.other[m] for m in names]
        return out


def binary(data: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The bytes of an array cut at ``ends`` (places in the array), as one value for each text."""
    offsets = np.concatenate([[0], data.itemsize * ends]).astype(np.int32)
    return pa.Array.from_buffers(kind or pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
