"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

For each start of a piece an Aho-Corasick automaton gives the longest token. Tokens are placed from left to right;
a token is accepted only if it is compatible with the one before it, that is, if merging by rank would leave that
boundary standing (remembered in a pair table). If no token fits, the last one is taken back for its next shorter
prefix, and the position is marked dead, so each position fails at most once and work stays linear. The result is
that of rank-order merging.

The vocabulary (a bounded file) is broadcast as text; each Python worker builds its tables once.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._base import idle, tidy
from ._pieces import Encoded, PieceTable, binary

#: Pairs of tokens that a worker remembers; a full table is emptied, so memory stays bounded.
CACHE_PAIRS = 60_000
#: Texts, or ids, taken at once, unless one value has more.
CHUNK_BYTES = 1 << 18


class Backtracking:
    """Exact BPE of one piece, given base symbols and ranked merges over strings of single-character symbols."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]]):
        import ahocorasick

        self.ids = tokens
        self.rank = {a + b: k for k, (a, b) in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        self.pairs = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for t in tokens:
            self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()

    def _stands(self, a: str, b: str) -> bool:
        """Whether the boundary between two tokens survives merging: undo the later of both until only base
        symbols face each other; at no time may the facing symbols merge before what was undone."""
        left, right, limit, good = a, b, 1 << 60, True
        while True:
            k = self.pairs.get((left, right))
            if k is not None and k < limit:
                good = False
                break
            p, q = self.rank.get(left, -1), self.rank.get(right, -1)
            if p < 0 and q < 0:
                break
            if p > q:  # the left token was formed later; at equal rank what stands further left goes first
                limit, left = p, self.parts[left][1]
            else:
                limit, right = q + 1, self.parts[right][0]
        if len(self.compatible) >= CACHE_PAIRS:
            self.compatible.clear()
        self.compatible[a, b] = good
        return good

    def _prefix(self, t: str) -> str:
        """The next shorter token that ``t`` begins with; empty if there is none."""
        if t not in self.shorter:
            self.shorter[t] = next((t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), "")
        return self.shorter[t]

    def encode(self, piece: str) -> list[int]:
        n = len(piece)
        longest = [0] * n
        for end, length in self.automaton.iter(piece):
            longest[end + 1 - length] = length  # ends ascend, so the last one seen from a start is the longest
        dead, placed, at = bytearray(n + 1), [], 0
        t = piece[: longest[0]] if n else ""
        compatible = self.compatible
        while at < n:
            if t:
                end = at + len(t)
                if not dead[end]:
                    fits = not placed or compatible.get((placed[-1], t))
                    if fits is None:
                        fits = self._stands(placed[-1], t)
                    if fits:
                        placed.append(t)
                        at = end
                        if at < n:
                            t = piece[at : at + longest[at]]
                        continue
                t = self._prefix(t)
                continue
            if not placed:
                raise ValueError(f"no token covers {piece!r}")
            dead[at] = 1
            t = placed.pop()
            at -= len(t)
        ids = self.ids
        return [ids[t] for t in placed]


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends over lower-cased pieces, read from the text of its tokenizer file."""

    # Fixed value: the pieces of a text.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END = 0xE000  # the last symbol of a word is its letter plus this

    def __init__(self, spec: str):
        import regex

        d = json.loads(spec)
        model, self.suffix = d["model"], d["model"]["end_of_word_suffix"]
        if d["normalizer"] is None or model["type"] != "BPE" or not self.suffix or model.get("ignore_merges") or d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != self.PIECES:
            raise ValueError("only byte-level BPE files with word ends and these pieces are read")
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = Backtracking({self._symbols(t): i for t, i in model["vocab"].items()}, [(self._symbols(a), self._symbols(b)) for a, b in merges])
        self.pieces = regex.compile(self.PIECES)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda s: [s]
        self.letters = byte_letters()
        by_id = {i: t for t, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        table = [by_id.get(i, "").encode() + b" " for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(t) for t in table], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.assigned: set[str] = set()
        self.table = PieceTable(self._bulk, self._whole, list(self.special))

    def _symbols(self, t: str) -> str:
        if t.endswith(self.suffix) and len(t) > len(self.suffix):
            t = t[: -len(self.suffix)]
            return t[:-1] + chr(ord(t[-1]) + self.END)
        return t

    def word(self, w: bytes) -> list[int]:
        """Ids of a run without ASCII white space."""
        text, out = w.decode(), []
        for part in self.cut(text) if any(x in text for x in self.special) else (text,):
            if part in self.special:
                out.append(self.special[part])
            else:
                for piece in self._pieces(part):
                    out += self._piece(piece.encode())
        return out

    def _piece(self, piece: bytes) -> list[int]:
        symbols = "".join([self.letters[b] for b in piece])
        return self.bpe.encode(symbols[:-1] + chr(ord(symbols[-1]) + self.END))

    def _bulk(self, pieces: list[bytes]) -> Encoded:
        return self._joined([self._piece(p) for p in pieces])

    def _whole(self, words: list[bytes]) -> Encoded:
        return self._joined([self.word(w) for w in words])

    @staticmethod
    def _joined(ids: list[list[int]]) -> Encoded:
        n = np.array([len(x) for x in ids], dtype=np.int64)
        return np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(n.sum())), n

    def _pieces(self, s: str) -> list[str]:
        """Pieces of a run after normalisation. Code points that Python's Unicode tables do not know yet are normalised
        and classified as the library does, so results do not hang on the versions of tables."""
        if s.isascii():
            return self.pieces.findall(s.lower())
        new = set(s) - self.assigned
        if not any(unicodedata.category(c) == "Cn" for c in new):
            self.assigned |= new
            return self.pieces.findall(unicodedata.normalize("NFC", s).replace("Σ", "σ").lower())
        from tokenizers import normalizers

        s = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(s)
        seen = "".join([self._stand_in(c) if unicodedata.category(c) == "Cn" else c for c in s])
        return [s[m.start() : m.end()] for m in self.pieces.finditer(seen)]

    def _stand_in(self, c: str) -> str:
        """A known character of the class of ``c``: letter, number, space or mark."""
        from tokenizers import Regex, pre_tokenizers

        for kind, known in ((r"\p{L}", "q"), (r"\p{N}", "0"), (r"\s", " ")):
            if pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(c):
                return known
        return "\u2603"

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        return self.table.encode([text])[0].astype("<u4").tobytes()

    def _texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Token texts joined by one space, gathered by offset and length of each id, for each run of ids. In pieces of
        bounded size."""
        out = []
        for k in range(0, len(ids), 1 << 16):
            part = ids[k : k + (1 << 16)]
            n = self.lengths[part]
            upto = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.starts[part] - (upto - n), n) + np.arange(upto[-1])])
        data = np.concatenate(out) if out else np.zeros(0, np.uint8)
        upto = np.concatenate([[0], np.cumsum(self.lengths[ids])])[ends]
        some = np.diff(ends, prepend=0) > 0  # the space behind the last token goes
        return binary(np.delete(data, upto[some] - 1), upto - np.cumsum(some), pa.string())

    def encoded(self, texts: list[bytes]) -> list[pa.Array]:
        ids, ends = self.table.encode(texts)
        return [binary(ids.astype("<u4"), ends)]

    def decoded(self, values: list[bytes]) -> list[pa.Array]:
        return [self._texts(np.frombuffer(b"".join(values), "<u4"), np.cumsum([len(v) // 4 for v in values], dtype=np.int64))]

    def both(self, texts: list[bytes]) -> list[pa.Array]:
        ids, ends = self.table.encode(texts)
        return [binary(ids.astype("<u4"), ends), self._texts(ids, ends)]


_MODELS: dict[int, WordBpe] = {}


def _model(spec: str) -> WordBpe:
    key = hash(spec)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = WordBpe(spec)
    return _MODELS[key]


def read_spec(path: str) -> str:
    """The tokenizer file, read by the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _in_parts(batch: pa.RecordBatch, column: str, f, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``batch`` with more columns f(values), cut into batches of bounded size."""
    at, some, size = 0, [], 0
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    for i, v in enumerate(values):
        some.append(v.as_py() or b"")
        size += len(some[-1])
        if size >= CHUNK_BYTES or i + 1 == len(values):
            part = batch.slice(at, i + 1 - at)
            yield pa.RecordBatch.from_arrays([*part.columns, *f(some)], [*batch.schema.names, *names])
            at, some, size = i + 1, [], 0


def _apply(df: DataFrame, column: str, spec: str, method: str, out: list[tuple[str, T.DataType]]) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(spec)
    names = [n for n, _ in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with idle(_MODELS):
            f = getattr(_model(held.value), method)
            for b in batches:
                yield from _in_parts(b, column, f, names)

    df = df.select(*[c for c in df.columns if c not in names])
    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in out]]))


def encode(df: DataFrame, spec: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with binary column ``ids``: little-endian unsigned 32-bit ids of each whole text.

    Null and empty texts give no ids. Special tokens' strings in a text become their ids. A column named ``ids``
    is replaced; other columns, repeated rows and empty tables pass through.
    """
    return _apply(df, text, spec, "encoded", [(ids, T.BinaryType())])


def decode(df: DataFrame, spec: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with string column ``decoded``: the texts of the ids' tokens, word ends kept, joined by a space.

    Null counts as no ids and gives the empty text. A column named ``decoded`` is replaced.
    """
    return _apply(df, ids, spec, "decoded", [(decoded, T.StringType())])


def round_trip(df: DataFrame, spec: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both in one pass through one Python worker: ``ids`` of the text, and ``decoded`` from those ids."""
    return _apply(df, text, spec, "both", [(ids, T.BinaryType()), (decoded, T.StringType())])


def digest(df: DataFrame, spec: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = round_trip(df.select("doc_id", "text"), spec)
    return out.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ._base import table

    return digest(table(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("word_bpe_49k.json")))
