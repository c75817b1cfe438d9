"""Vectorised hashing of words and word shingles of whole texts (one definition for all shingle operators)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_TABLE = np.frombuffer(np.random.default_rng(20240607).bytes(256 * 8), dtype=_U)  # a random value per byte
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, base, dtype=_U)
        if n:
            p[0] = 1
        return np.cumprod(p, dtype=_U)


_held: list = [np.zeros(0, _U), np.zeros(0, _U)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n or more of each."""
    if len(_held[0]) < n:
        _held[:] = [_powers(_BASE, n), _powers(_INVERSE, n)]
    return _held


def release() -> None:
    _held[:] = [np.zeros(0, _U), np.zeros(0, _U)]


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)


def blocks(data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``data`` as numbers of eight bytes each, the last filled with zeros: the string and the place in it
    of each number, and the number."""
    number = np.ndarray((len(data) + 1,), "<u8", data + b"\0" * 8, strides=(1,))
    n = (size + 7) // 8
    owner = np.repeat(np.arange(len(size)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = 8 * place
    return owner, place, number[start[owner] + at] & _MASK[np.minimum(size[owner] - at, 8)]


def string_hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings at these places, each of a byte or more. Every eight bytes are mixed with their
    place before they are summed, so no regular pattern of bytes cancels out."""
    if not len(size):
        return np.zeros(0, _U)
    owner, place, v = blocks(data, start, size)
    with np.errstate(over="ignore"):
        v = mix(mix(v + _BASE) ^ mix(place.astype(_U) * _BASE + _U(0x51ED270B)))
        sums = np.add.reduceat(v, np.flatnonzero(place == 0))
        return mix(sums + size.astype(_U) * _BASE)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (maximal run of bytes other than ASCII white space) of texts, and words per text."""
    data = b"\n".join(texts) + b"\n"
    gap = _GAP[np.frombuffer(data, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    stops = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, stops)
    return string_hashes(data, starts, ends - starts), np.diff(np.concatenate([[0], upto]))


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, ascending, and their number per text. A text of fewer
    words, but at least one, has its whole word sequence as its one shingle."""
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) - first[owner]
    size = np.minimum(n, k)[owner]
    starts = np.flatnonzero(at + size <= n[owner])
    s = np.zeros(len(starts), dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(k):
            on = size[starts] > j
            s[on] = mix(s[on] * _BASE + h[starts[on] + j])
        s = mix(s + size[starts].astype(_U))
    doc = owner[starts]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.bincount(doc[new], minlength=len(n))
