"""Operators against brute force, exact round trips and edge cases, on small fixtures."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiflow.llm import bpe, chat_format, importance, jaccard_join, mixing, quality_rules, suffix_array, suffix_dedup, token_files, toxicity, va_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3), (2, None), (3, ""), (4, "\n \t"), (5, "é" * 100 + " ß"), (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3), (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3), (None, "no id here, but words"), (None, None), (7, "word " * 30_000), (8, "<|endoftext|>İΣΣ a's 12 😀")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "x", 1, "q") for i, t in ODD], "doc_id long, text string, quality string, ids int, score string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def spec():
    return bpe.read_spec(public_tokenizers.path("word_bpe_49k.json"))


# --- quality rules


def base(text):
    words, seen, dup, at = WORD.findall(text or ""), set(), 0, collections.defaultdict(list)
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_base(spark, docs, odd, empty):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df in (docs, odd):
        rows = quality_rules.assess(df).select("text", "quality.*").collect()
        assert len(rows) == df.count()
        for r in rows:
            want = base(r.text)
            assert tuple(r[f] for f in fields) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r.base_failed and r.kept)
    assert quality_rules.assess(empty).count() == 0


def test_quality_lines(spark):
    good = "A sentence of plain words stands here, as it should.\nAnother one follows it, and says no more.\n"
    rows = [good, good + "All rights reserved.\n", good + "A!! B!! C!! D!! E!! F!! G!! H!! I!! J!! K!! L!! M!! N!! O!!", "Home | About us | Contact | Login\nNews | Sports | Weather | More here\n" + "x y z"]
    out = quality_rules.assess(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").select("quality.*").collect()
    assert [r.kept for r in out] == [True, True, False, False]
    assert out[0].cleaned_text == good and "rights" not in out[1].cleaned_text


def test_quality_agrees_with_labels(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {(r.quality, r.kept): r["count"] for r in quality_rules.assess(docs).select("doc_id", F.col("quality.kept").alias("kept")).join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert got.get((1, True), 0) >= 0.95 * (got.get((1, True), 0) + got.get((1, False), 0))
    assert got.get((0, False), 0) >= 0.8 * (got.get((0, True), 0) + got.get((0, False), 0))


# --- chat formatting


def test_chat_round_trip(spark):
    r = random.Random(3)
    texts = ["", "<|im_end|>", "<\\|x", "<", "\\", "|>\n", "plain", "<|im_sep|><|im_start|>assistant\n", "a\n\nb", "<\\\\|im_end|>\n"]
    rows = [(c, t, r.choice(["user", "assistant", "a\nb", "", None]), r.choice([*texts, None])) for c in [*range(30), None] for t in range(r.randint(1, 9))]
    rows += [(99, t, r.choice(["user", "assistant"]), r.choice(texts)) for t in range(1000)]  # over several blocks
    rows += [(98, None, "user", "x"), (98, 1, "user", "b"), (98, 1, "user", "b"), (98, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df).withColumn("runs", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"))).collect()
    want = collections.defaultdict(list)
    for c, t, role, x in sorted(rows, key=lambda y: (y[1] is not None, y[1] or 0, y[2] or "", y[3] or "")):
        want[c].append((role or "", x or ""))
    assert len(out) == len(want)
    for o in out:
        assert [(run.role, x) for run in o.runs for x in run.texts] == want[o.conv_id]
        assert all(a.role != b.role for a, b in zip(o.runs, o.runs[1:]))
        assert o.loss == "".join(x for role, x in want[o.conv_id] if role == "assistant") and o.n_rows == len(want[o.conv_id])
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# --- suffix arrays and their dedup


@pytest.mark.parametrize("block, depth", [(4, 1), (4, 24), (4096, 24)])
def test_suffix_arrays(monkeypatch, block, depth):
    monkeypatch.setattr(suffix_array, "BLOCK", block)
    monkeypatch.setattr(suffix_array, "DEPTH", depth)
    r = np.random.default_rng(1)
    for t in range(400):
        k, n = int(r.integers(1, 6)), int(r.integers(1, 60))
        s = r.integers(0, k, n)
        if t % 3 == 0:
            s = np.tile(s[: max(1, n // 4)], 6)[:n]
        n = len(s)
        b = s.astype(np.uint8).tobytes()
        sa = suffix_array.suffix_array(s, k)
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        shared = suffix_array.common_prefixes(s, sa)
        for x, y in zip(sa, sa[1:]):
            c = 0
            while max(x, y) + c < n and s[x + c] == s[y + c]:
                c += 1
            assert shared[y] == c
    assert suffix_array.suffix_array(np.arange(9000)[::-1].copy(), 9000).tolist() == list(range(9000))[::-1]


def cut(rows, width):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        i, t = rows[k][0], (rows[k][1] or "").encode()
        i = (1 << 63) - 1 if i is None else i
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            f = first.setdefault(t[p : p + width], i)
            if f < i:
                gone[p : p + width] = b"\1" * width
        out.append((rows[k][0], len(t), sum(gone), len(re.findall(b"\1+", gone)), bytes(x for x, g in zip(t, gone) if not g)))
    return collections.Counter(out)


def removed(df, width):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, width).select("doc_id", "repeats.*").collect())


def test_suffix_dedup(spark, docs, odd, empty):
    rows = [(r.doc_id, r.text) for r in docs.limit(120).collect()]
    assert removed(docs.limit(120), 50) == cut(rows, 50)
    assert removed(odd, 50) == cut(ODD, 50)
    r = random.Random(5)
    some = ["".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(40)]
    rows = [(i // 2, "".join(r.choice(some) for _ in range(r.randint(0, 6)))) for i in range(120)]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), 20) == cut(rows, 20)
    assert removed(empty, 50) == collections.Counter()


def test_shard_of_many_arrays(monkeypatch):
    """Strings of a shard in many small suffix arrays: the spans of each are those of brute force."""
    r, width = random.Random(9), 8
    code, owner = [r.randrange(12) for _ in range(60)], [r.randrange(9) for _ in range(60)]
    some = [bytes(97 + 2 * c + r.randrange(2) for _ in range(r.randint(8, 30))) for c in code]  # equal windows have equal codes
    n = len(some)
    blob = np.array([n, n], "<i8").tobytes() + np.array(code, "<u8").tobytes() + np.array([len(x) for x in some], "<u4").tobytes() + np.arange(n, dtype="<i4").tobytes()
    blob += np.array([[o, 0, 0] for o in owner], "<u8").tobytes() + np.zeros(n, "<i8").tobytes() + b"".join(some)
    for size in (16, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", size)
        shard = suffix_dedup.Shard([blob])
        got = collections.defaultdict(set)
        for at, x, y in zip(*(v.tolist() for v in shard.spans(width))):
            got[at] |= set(range(x, y))
        same = [{j for j in range(n) if some[j] == some[i] or code[j] == code[i]} for i in range(n)]
        for i in range(n):
            want = set()
            for p in range(len(some[i]) - width + 1):
                if any(owner[j] < owner[i] and some[i][p : p + width] in some[j] for j in same[i]):
                    want |= set(range(p, p + width))
            assert got[i] == want


def test_pieces_cover_all_windows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)
    t = bytes(random.Random(1).choices(range(256), k=1234))
    seen = sorted((at + p, part[p : p + 50]) for g in suffix_dedup.pieces(iter([((), t)]), 50) for _, at, part in g for p in range(len(part) - 49))
    assert seen == [(p, t[p : p + 50]) for p in range(len(t) - 49)]


# --- Jaccard join


def linked(rows, percent, k):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][0] is not None and rows[b][0] is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                root[q] = p
    return collections.Counter((i, len(s), None if i is None else find(i) if s else i) for (i, _), s in zip(rows, sets))


def joined(df, percent=85, k=4):
    return collections.Counter(tuple(r) for r in jaccard_join.similar(df, percent, k).collect())


def test_jaccard_join(spark, odd, empty):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(25):
        words = r.choices(vocabulary, k=r.choice([1, 3, 5, 8, 12, 20, 40, 90, 200]))
        for _ in range(r.randint(1, 9)):
            some = list(words)
            for _ in range(r.randint(0, max(1, len(some) // 25))):
                some[r.randrange(len(some))] = r.choice(vocabulary)
            rows.append((len(rows), r.choice(["{}", " {}\n", "{}"]).format((" " if r.random() < 0.8 else "\t\n").join(some)).upper() if r.random() < 0.2 else " ".join(some)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df) == linked(rows, 85, 4)
    assert joined(df, 80, 5) == linked(rows, 80, 5)
    assert joined(odd) == linked(ODD, 85, 4)
    assert joined(empty) == collections.Counter()


def test_large_families_are_tiled(spark, monkeypatch):
    """More near copies than a tile holds are still linked exactly."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        some = list(words)
        for _ in range(r.randint(0, 2)):
            some[r.randrange(60)] = f"v{r.randrange(40)}"
        rows.append((i, " ".join(some)))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == linked(rows, 85, 4)


def test_chains_over_many_tiles(spark, monkeypatch):
    """Components of families cut into very small tiles, whose members hang together by chains and by hubs."""
    monkeypatch.setattr(jaccard_join, "TILE", 5)
    r, rows = random.Random(9), []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(50)]
        for i in range(60):
            if family == 0:  # a chain: far apart at its ends
                words[i % 50] = f"c{i}"
                some = list(words)
            else:
                some = list(words)
                for _ in range(r.randint(0, 3)):
                    some[r.randrange(50)] = f"v{r.randrange(9)}"
            rows.append((len(rows), " ".join(some)))
    r.shuffle(rows)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == linked(rows, 85, 4)


def test_hamming_distance_is_a_lower_bound():
    """Sketch distances never pass the symmetric difference, and spare the comparison of most pairs that do not link."""
    r, pool = np.random.default_rng(8), np.random.default_rng(9).integers(0, 1 << 63, 900, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(r.choice(pool, int(r.integers(1, 300)))) for _ in range(60)]
    sets += [np.unique(np.append(s[3:], r.choice(pool, 2))) for s in sets if len(s) > 60]
    n = np.array([len(s) for s in sets])
    sketch = jaccard_join.sketches(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), len(sets))
    distance = jaccard_join.hamming(sketch, sketch)
    shared = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (distance <= n[:, None] + n[None, :] - 2 * shared).all()
    room, links = jaccard_join.may_link(distance, n, n, 85), jaccard_join._linked(shared, n, n, 85)
    assert (room | ~links).all() and links.sum() > len(sets) and (room & ~links).sum() < 0.05 * (~links).sum()


def test_regular_words_do_not_collide(spark):
    """Thue-Morse words and their complements cancel out in polynomial hashes modulo a power of two."""
    a = ["ab"[bin(i).count("1") % 2] for i in range(2048)]
    rows = [(1, "".join(a)), (2, "".join("ba"["ab".index(x)] for x in a)), (3, "".join(a) + "a"), (4, "".join(a))]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == collections.Counter([(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 1)])


def test_sketch_bound():
    """Linked sets always agree in a block that both keep."""
    bands, r = jaccard_join.Bands(85), np.random.default_rng(4)
    for _ in range(200):
        n = int(r.integers(7, 400))
        common = r.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        a = b = common
        while True:  # drift apart as far as the link allows
            c, d = (np.append(a, np.uint64(r.integers(1 << 62))), b) if r.random() < 0.5 else (a, np.append(b, np.uint64(r.integers(1 << 62))))
            if 100 * len(common) < 85 * len(np.union1d(c, d)):
                break
            a, b = c, d
        both, sizes = np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)])
        owner, key = jaccard_join.block_keys(both, sizes, bands)
        assert set(key[owner == 0]) & set(key[owner == 1]) or set(a.tolist()) == set(b.tolist())


# --- mixing


def test_quotas():
    q = mixing.quotas({"b": 100, "a": 10, None: 50, "c": 40}, 300)
    assert math.isclose(sum(q.values()), 300) and q["a"] == 20 and all(q[s] <= 2 * n + 1e-9 for s, n in {"b": 100, "a": 10, None: 50, "c": 40}.items())
    assert mixing.quotas({}, 0) == {}


def test_route_prefers_unrepeated_tokens():
    flows = mixing.route([(("a",), 10), (("a", "b"), 100)], {"a": 50.0, "b": 30.0})
    assert flows[0, "a"] == 10 and flows[1, "a"] == 40 and flows[1, "b"] == 30  # cheaper than a second copy of the first


def test_route_costs_least():
    """Against all flows of small networks: as many tokens as possible, then as few second copies as possible."""
    r = random.Random(7)
    for _ in range(60):
        some = [m for m in (("a",), ("b",), ("a", "b"), ("a", "b", "c"), ("c",)) if r.random() < 0.6][:3] or [("a", "b")]
        patterns = [(m, r.randint(0, 3)) for m in some]
        target = {s: r.randint(0, 5) for s in "abc"}
        ways = []
        for m, size in patterns:
            ways.append([dict(zip(m, x, strict=True)) for x in itertools.product(range(2 * size + 1), repeat=len(m)) if sum(x) <= 2 * size])

        def told(flows, patterns=patterns):
            each = [sum(f.values()) for f in flows]
            return sum(each), -sum(max(0, e - size) for e, (_, size) in zip(each, patterns, strict=True))

        best = max(told(f) for f in itertools.product(*ways) if all(sum(x.get(s, 0) for x in f) <= t for s, t in target.items()))
        flows = mixing.route(patterns, {s: float(t) for s, t in target.items()})
        got = [{s: flows[i, s] for s in m} for i, (m, _) in enumerate(patterns)]
        assert told(got) == best
        assert all(sum(x.get(s, 0) for x in got) <= t for s, t in target.items())


def test_mix(spark, docs, odd, empty):
    one = mixing.mix(docs, F.array("source"))
    rows = one.select("doc_id", "source", "text", "mix.*").collect()
    assert all(r["size"] == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 2 * r["size"] for r in rows)
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = next(iter(r.targets.values()))
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    again = mixing.mix(docs.repartition(7), F.array("source")).select("doc_id", "mix.taken")
    assert again.exceptAll(one.select("doc_id", "mix.taken")).count() == 0
    words = sum(len(WORD.findall(r.text)) for r in mixing.take(one).select("text").collect())
    assert words == sum(taken.values())
    assert mixing.mix(odd, F.array("quality")).count() == len(ODD)
    assert mixing.mix(empty, F.array("quality")).count() == 0


# --- BPE


def test_bpe_matches_the_library(spark, docs, odd, empty, spec):
    library = Tokenizer.from_str(spec)
    for df in (docs, odd):
        out = bpe.decode(bpe.encode(df, spec), spec).select("text", "ids", "decoded").collect()
        assert len(out) == df.count()
        for r in out:
            want = library.encode(r.text or "", add_special_tokens=False).ids
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want
            assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty, spec).count() == 0


def test_bpe_odd_words(spec):
    mine, library, r = bpe.WordBpe(spec), Tokenizer.from_str(spec), random.Random(1)
    letters = "abcdeeth'srtiong.!?-_  \nńÉΣİA9<|endoftext|> é中😀́\x1c\x85"
    for _ in range(3000):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 50))) + r.choice(["", "<|endoftext|>x", "a<|startoftext|>"])
        assert np.frombuffer(mine.encode(s.encode()), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, s


# --- token files


def test_token_files(spark, odd, empty, spec, tmp_path):
    library = Tokenizer.from_str(spec)
    files = token_files.write_tokens(odd, spec, 2, folder=f"file://{tmp_path}/t")
    out = token_files.read_tokens(files).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    want = collections.Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in ODD)
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in out) == want
    at = 0
    for r in out:
        assert r.start == at
        at += len(r.ids) // 4
    assert token_files.read_tokens(token_files.write_tokens(empty, spec, 2)).count() == 0


def test_requested_documents(spark, spec):
    """By id over the files' index: many small files, repeated, missing and null ids."""
    rows = [(i // 2 if i % 7 else None, f"text {i} " * (i % 5)) for i in range(300)]
    files = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), spec, 2, file_bytes=400)
    every = [(x.doc_id, x.start, bytes(x.ids)) for x in token_files.read_tokens(files).collect()]
    asked = [0, 1, 5, 5, 77, 149, 150, -4, 10_000, None]
    got = sorted((x.doc_id, x.start, bytes(x.ids)) for x in token_files.read_documents(files, spark.createDataFrame([(a,) for a in asked], "doc_id long")).collect())
    assert got == sorted(x for x in every if x[0] in {a for a in asked if a is not None}) and len(got) > 6 and files.count() > 5
    assert token_files.read_documents(files, spark.createDataFrame([], "doc_id long")).isEmpty()


def test_files_of_one_id_stay_in_order(spark, spec):
    """Repeated ids over several files, the last of which holds later ids too: starts ascend with the ids."""
    rows = [(i, f"{w} b c d") for i in (1, 2, 2, 2, 2, 2, 3, 4) for w in ("x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = token_files.read_tokens(token_files.write_tokens(df, spec, 2, file_bytes=40)).orderBy("start").collect()
    again = token_files.read_tokens(token_files.write_tokens(df.repartition(3), spec, 2, file_bytes=40)).orderBy("start").collect()
    assert [r.doc_id for r in first] == sorted(i for i, _ in rows) and first == again


def test_long_texts_in_parts(spec, monkeypatch):
    from lexiflow.llm import _pieces

    library = Tokenizer.from_str(spec)
    monkeypatch.setattr(_pieces, "PART_BYTES", 300)
    texts = ["x" * 1000, "ab, c\n" * 400, "y" * 700 + " " + "é" * 500, "", "it's <|endoftext|> 12 " * 60, "ÄÖ ß×÷ " * 90]
    for table in (token_files.library(spec), bpe.WordBpe(spec).table):
        ids, ends = table.encode([t.encode() for t in texts])
        cuts = [0, *ends.tolist()]
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_file_format(tmp_path, monkeypatch):
    import struct

    import zstandard

    monkeypatch.setattr(token_files, "FRAME_BYTES", 4000)
    path = f"file://{tmp_path}/a.ids.zst"
    w = token_files.Writer(path)
    data = [np.arange(n, dtype="<u4").tobytes() for n in (0, 5, 2000, 1, 0, 900, 900)]
    for i, d in enumerate(data):
        w.add(i if i else None, d)
    w.close()
    raw = (tmp_path / "a.ids.zst").read_bytes()
    r = token_files.Reader(path)
    assert [r.tokens(i) for i in (6, 2, 0, 5, 1, 3, 4)] == [data[i] for i in (6, 2, 0, 5, 1, 3, 4)] and len(r.sizes) > 3
    plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)  # any reader sees the frames
    assert plain.startswith(b"".join(data))
    assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    broken = bytearray(raw)
    broken[20] ^= 0xFF
    (tmp_path / "b.ids.zst").write_bytes(bytes(broken))
    with pytest.raises(Exception):
        b = token_files.Reader(f"file://{tmp_path}/b.ids.zst")
        [b.tokens(i) for i in range(7)]


def test_token_query(spark, sf, spec, docs):
    from lexiflow.llm import token_files as t

    library, at = Tokenizer.from_str(spec), 0
    got = {r.doc_id: r for r in t.query(spark, sf).collect()}
    for d in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        g = got[d.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


# --- toxicity


def test_toxicity(spark, odd, empty):
    r = random.Random(1)
    clean, bad = [f"word{i}" for i in range(200)], ["zlurgish", "zlurgent", "grobnak"]
    rows = []
    for i in range(600):
        words = r.choices(clean, k=r.randint(5, 80))
        if i % 3 == 0:
            words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fit = toxicity.Fit(bits=16, steps=150)
    model = toxicity.fit_model(toxicity.sample(df, df.select("doc_id", "toxic"), "toxic", "doc_id", "text", toxicity.fold() != 1, fit), fit)
    held = toxicity.score(df.filter(toxicity.fold() == 1), model).collect()
    right = sum((x.score >= 0.7) == bool(x.toxic) for x in held)
    assert right >= 0.95 * len(held)
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= x.score <= 1 for x in out)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit_model(toxicity.sample(df, df.filter("toxic = 0").select("doc_id", "toxic"), "toxic", "doc_id", "text", F.lit(True), fit), fit)
    assert all(x.score < 0.5 for x in toxicity.score(odd, none).collect())


def test_toxicity_matches_a_loop(spark):
    """Features, their scales and scores from plain dictionaries of n-grams; the fit ends where its loss is flat."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["abc", "Bcd", "cde", "défg"] + ["zork"] * (i % 2), k=r.randint(0, 6))), i % 2) for i in range(60)]
    rows += [(5, "~ later than every letter", 1)]  # repeats an id: the least text counts
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fit = toxicity.Fit(bits=12, sizes=(2, 3), kept=25, min_documents=3, steps=3000)
    model = toxicity.fit_model(toxicity.sample(df, df.select("doc_id", "toxic"), "toxic", "doc_id", "text", F.lit(True), fit), fit)
    every = np.ones(1 << fit.bits, dtype=bool)

    def number(gram):  # a text of one n-gram has one feature
        found = toxicity.grams([gram], (len(gram),), fit.bits, every)[1]
        return int(found[0])

    def features(text):
        t = text.encode().lower()
        return {number(t[k : k + n]) for n in fit.sizes for k in range(len(t) - n + 1)}

    seen = [(features(t), y) for _, t, y in rows[:-1]]
    d = [sum(y == c for _, y in seen) for c in (0, 1)]
    n = [collections.Counter(f for fs, y in seen if y == c for f in fs) for c in (0, 1)]
    gain = {}
    for f in set(n[0]) | set(n[1]):
        both = n[0][f] + n[1][f]
        expected = both * d[1] / 60
        if both >= 3 and n[1][f] != expected:
            gain[f] = abs(n[1][f] - expected) / math.sqrt(expected * d[0] / 60 + 1)
    assert sorted(sorted(gain, key=lambda f: (-gain[f], f))[:25]) == model.features.tolist()
    scale = {f: math.log((n[1][f] + 1) / (d[1] + 2)) - math.log((n[0][f] + 1) / (d[0] + 2)) for f in gain}
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    p = {t: 1 / (1 + math.exp(-sum(weight.get(f, 0.0) for f in features(t)) - model.bias)) for _, t, _ in rows}
    for x in toxicity.score(df, model).collect():
        assert math.isclose(x.score, p[x.text], rel_tol=1e-9)
    for f, w in weight.items():
        if scale[f]:
            slope = sum((p[t] - y) * 0.5 / d[y] * (f in fs) for (_, t, y), (fs, _) in zip(rows[:-1], seen, strict=True)) * scale[f] + fit.penalty * w / scale[f]
            assert abs(slope) < 2e-3


# --- importance resampling


def test_importance(spark, docs, sf, odd, empty):
    r = importance.Resampling()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    target = docs.join(labels.filter("quality = 1"), "doc_id").select("text")
    out = importance.resample(docs, target, 120, r)
    kept = out.filter("kept").collect()
    assert len(kept) == 120 and min(x.draw for x in kept) >= max(x.draw for x in out.filter("not kept").collect())
    assert out.exceptAll(importance.resample(docs.repartition(5), target, 120, r)).count() == 0
    share = {x.quality: x.s for x in out.join(labels, out.id == labels.doc_id).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > share[0]
    assert importance.resample(odd, target, 4, r).filter("kept").count() == 4
    assert importance.resample(empty, target, 4, r).count() == 0


def test_importance_matches_a_loop(spark):
    """Ratios, weights and Gumbel draws from plain dictionaries of words and pairs."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["red", "Green", "blue", "é", "x" * 20], k=r.randint(0, 9)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    options = importance.Resampling(bits=10)
    out = {x.id: x for x in importance.resample(df, df.filter("doc_id < 30").select("text"), 20, options).collect()}
    bucket = {}

    def features(text):
        words = [w.encode().lower() for w in WORD.findall(text)]
        some = words + [b" ".join(p) for p in zip(words, words[1:], strict=False)]
        return [bucket.setdefault(g, int(importance.grams([g], options.bits)[1][-1])) for g in some]  # the pair is last

    n = [collections.Counter(f for i, t in rows if i < most for f in features(t)) for most in (30, 80)]
    total = [sum(c.values()) + 0.5 * 1024 for c in n]
    draws = {}
    hashes = {x.doc_id: x.h % (1 << 64) for x in df.select("doc_id", F.xxhash64("doc_id", F.lit(options.seed)).alias("h")).collect()}
    for i, t in rows:
        some = features(t)
        w = sum(math.log((n[0][f] + 0.5) / total[0]) - math.log((n[1][f] + 0.5) / total[1]) for f in some) / max(1, len(some)) ** 0.5
        draws[i] = w - math.log(-math.log(((hashes[i] >> 11) + 0.5) / (1 << 53)))
        assert math.isclose(out[i].log_weight, w, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(out[i].draw, draws[i], rel_tol=1e-9, abs_tol=1e-12)
    assert {i for i, x in out.items() if x.kept} == set(sorted(draws, key=lambda i: -draws[i])[:20])


def test_counts_match_a_loop(spark, docs):
    texts = [x.text for x in docs.limit(20).collect()]
    n = importance.counts(docs.limit(20).select("text"), 16)
    assert n.sum() == sum(max(0, 2 * len(WORD.findall(t)) - 1) for t in texts)


# --- exact search


def test_search(spark):
    r = np.random.default_rng(3)
    v = r.integers(-300, 300, (500, 8))
    v[100:140] = v[0]
    rows = [(i, [int(x) for x in a]) for i, a in enumerate(v)] + [(500, None), (501, [1, None]), (502, [3, 4]), (None, [1] * 8), (504, []), (505, [1 << 40] * 8)]
    rows += [(7, rows[7][1])] * 2 + [(8, [299] * 8), (50, rows[50][1]), (650, [0] * 8)] + [(600 + i, rows[3][1]) for i in range(400) if i != 50]
    df = spark.createDataFrame(rows, "id long, v array<bigint>")
    got = collections.defaultdict(list)
    for x in va_search.search(df, df.filter("id % 50 = 0 or id = 502"), 5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    good = [(i, a) for i, a in rows if i is not None and a and None not in a]
    for q, a in good:
        if q % 50 == 0:
            want = sorted(((i, sum(x * y for x, y in zip(a, b))) for i, b in good if i != q and len(b) == len(a)), key=lambda p: (-p[1], p[0]))[:5]
            assert got.get(q, []) == want
    assert 502 not in got and va_search.search(df.limit(0), df.limit(0), 5).count() == 0


def test_search_reads_few_exact_vectors(spark):
    v = np.random.default_rng(4).integers(-300, 300, (1000, 16))
    df = va_search._packed(spark.createDataFrame([(i, [int(x) for x in a]) for i, a in enumerate(v)], "id long, v array<bigint>"))
    exact = va_search.classes(df, 5)
    cells = va_search._blocks(exact.select("c", F.col("members.id").alias("members"), "v"), 100, "dim long, classes binary, members binary, starts binary, low binary, step binary, cells binary", va_search._cells)
    queries = df.filter("id % 50 = 0")
    found = {(x.query_id, x.c): x.bound for x in va_search.scan(cells, queries, 5).collect()}
    ids = {x.c: x.members[0].id for x in exact.collect()}
    scores = v[::50] @ v.T
    kept = {(q, ids[c]) for q, c in found}
    assert all(b >= scores[q // 50, ids[c]] for (q, c), b in found.items())
    for q in range(0, 1000, 50):
        order = sorted((i for i in range(1000) if i != q), key=lambda i: (-scores[q // 50, i], i))
        assert {(q, i) for i in order[:5]} <= kept
    # Each salt keeps the k best of a query and what their bounds cannot tell from them.
    assert len(found) < 20 * 2 * 5 * int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- contract


def test_registry(spark, sf):
    import corpus_pipeline

    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} <= {re.match(r"op\d+_", x)[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert hashlib.sha256(b"").hexdigest()


def test_components(spark):
    """Chains, rings, stars, loops and repeated edges; the least node names a component."""
    from lexiflow.llm._graph import components

    r = random.Random(5)
    chain = list(range(200))
    r.shuffle(chain)
    pairs = [*zip(chain, chain[1:]), *((1000 + i, 1000 + (i + 1) % 30) for i in range(30)), *((2000, 2000 + i) for i in range(1, 40)), (3000, 3000), (-5, 7000), (-5, 7000), (7000, -5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 0 for i in range(200)} | {1000 + i: 1000 for i in range(30)} | {2000 + i: 2000 for i in range(40)} | {-5: -5, 7000: -5}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
