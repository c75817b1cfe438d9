"""Merkle manifest, language identification and spelling variants against plain loops, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import language_id, merkle, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "a\nb", "en", "s", 3),
    (None, "a\nb", "en", "s", 3),
    (0, "", "en", None, None),
    (2, None, None, "", 0),
    (4, "x\n\n", "en", "é", -1),
    (4, "x\n\n", "en", "é", -1),
    (4, "other", "en", "é", 5),
    (-7, "long " * 20_000, "en", "z", 100_000),
]


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def _leaf(row, text):
    doc_id, _, lang, source, n = row
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def _climb(leaves):
    """Root, and the siblings of every leaf with its place among them by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append((run[: i % 3], run[i % 3 + 1 :]))
        level, at = [H(*level[i : i + 3]) for i in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], paths


def _brute_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, _leaf(r, r[1]), r) for r in rows if r[3] == s), key=lambda x: x[:3])
        trees.append((own, *_climb([x[2] for x in own])))
    root, top = _climb([t[1] for t in trees])
    out = []
    for (own, sub, paths), over in zip(trees, top, strict=True):
        for (_, _, leaf, row), path in zip(own, paths, strict=True):
            steps = path + over
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            h = _leaf(row, row[1].replace("\n", "") if row[1] is not None else None) if tampered else leaf
            for before, after in steps:
                h = H(*before, h, *after)
            out.append((row[0], leaf, sub, root, H(*[x for b, a in steps for x in (*b, *a)]), h, h == root))
    return out


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


MERKLE = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("sizes", [[1], [3, 1], [4, 27, 28, 2, 82], [9] * 11])
def test_merkle_equals_a_plain_loop(spark, tmp_path, sizes):
    rows = [(i * 7 % 991, f"t{i}\n{s}", "en", f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert _rows(merkle.query(spark, str(tmp_path)), *MERKLE) == sorted(_brute_manifest(rows), key=repr)


def test_merkle_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("tree", F.lit(1)).withColumn("hash", F.lit("x")).withColumn("idx", F.lit(None).cast("int"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert _rows(merkle.query(spark, str(tmp_path)), *MERKLE) == sorted(_brute_manifest(ODD), key=repr)
    docs.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.query(spark, f"{tmp_path}/none").isEmpty()


def test_merkle_stores_preimages_and_finds_a_changed_row(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", i) for i in range(100)], SCHEMA)
    m = merkle.build(docs, carry={"claimed": F.when(F.col("doc_id") == 41, F.sha2(F.lit("forged"), 256))})
    assert all(len(p) in (64, 128, 192) for r in m.stages[0].collect() for level in r.levels for p in level)
    out = m.proofs().select("key", (merkle.fold(F.coalesce("c_claimed", "hash"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r.key for r in out if not r.ok} == {41} and len(out) == 100


def _brute_language(train, texts, p):
    """The method with dictionaries and loops; returns language and score of each text."""
    import math

    find = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()  # noqa: E731  texts here have no marks
    sizes = Counter(lang for lang, t in train)
    langs = sorted(sizes)
    words = {x: Counter() for x in langs}
    for lang, t in train:
        words[lang].update(find(t))
    grams = {k: {x: Counter() for x in langs} for k in range(1, p.longest + 1)}
    for x in langs:
        for w, n in words[x].items():
            for k in grams:
                for i in range(len(w) + 2 - k + 1):
                    grams[k][x][f" {w} "[i : i + k]] += n

    def weights(counts, most):
        kept = set()
        for x in langs:
            levels = sorted(counts[x].values(), reverse=True)
            fits = [n for n in set(levels) if sum(v >= n for v in levels) <= most]
            if fits:
                kept |= {t for t, n in counts[x].items() if n >= min(fits)}
        out = {}
        for t in kept:
            v = [math.log((counts[x][t] + p.smoothing) / (sum(counts[x].values()) + p.smoothing * max(1, len(kept)))) for x in langs]
            out[t] = [a - sum(v) / len(v) for a in v]
        return out

    known = weights(words, p.words // len(langs))
    parts = {k: weights(grams[k], p.grams // len(langs)) for k in grams}
    result = []
    for text in texts:
        found = find(text or "")
        if not found:
            result.append(("und", 0.0))
            continue
        total = [math.log(sizes[x] / len(train)) for x in langs]
        for w in found:
            v = known.get(w)
            for k in range(p.longest, 0, -1):
                if v is None:
                    hits = [parts[k][g] for i in range(len(w) + 2 - k + 1) if (g := f" {w} "[i : i + k]) in parts[k]]
                    if hits:
                        v = [p.backoff ** (p.longest - k) * sum(c) / len(hits) for c in zip(*hits, strict=True)]
            if v is not None:
                total = [a + b for a, b in zip(total, v, strict=True)]
        e = [math.exp(t - max(total)) for t in total]
        result.append((langs[total.index(max(total))], max(e) / sum(e)))
    return result


def test_language_equals_a_plain_loop(spark):
    r = random.Random(5)
    make = {"aa": "abcde", "bb": "bcdef", "cc": "xyzéü"}
    text = lambda x, n: " ".join("".join(r.choice(make[x]) for _ in range(r.randint(1, 6))) for _ in range(n))
    train = [(x, text(x, 30)) for x in make for _ in range(8)] + [("aa", "only here")]
    texts = [text(x, n) for x in make for n in (1, 2, 5)] + ["Mixed abc XYZ", "", None, "12 34 ²", "zzzqqq", "ABcde, bcd-ef!", "жук"]
    for p in (language_id.Fit(), language_id.Fit(words=60, grams=45, longest=3)):
        model = language_id.fit(spark.createDataFrame(train, "lang string, text string"), p=p)
        got = {r.id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), model, ["id"]).collect()}
        for i, (lang, score) in enumerate(_brute_language(train, texts, p)):
            assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4), (texts[i], got[i], lang, score)


def test_language_on_held_out_rows(spark, sf):
    out = language_id.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert out and np.mean([r.lang == r.lang_pred for r in out]) >= 0.98 and all(0 <= r.score <= 1 for r in out)


def test_language_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([*ODD, (9, "é" * 300_000, "fr", "s", 1), (11, "̈", "fr", "s", 1)], SCHEMA).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(7))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = language_id.query(spark, str(tmp_path)).collect()
    assert len(out) == 10 and {r.lang_pred for r in out if r.doc_id in (2, 0, 11)} == {"und"} and all(r.held_out is False for r in out if r.doc_id is None)
    docs.withColumn("lang", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/bare/documents.parquet")
    assert {(r.lang_pred, r.score) for r in language_id.query(spark, f"{tmp_path}/bare").collect()} == {("und", 0.0)}
    docs.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert language_id.query(spark, f"{tmp_path}/none").isEmpty()


def _brute_words(rows, every=31):
    import re

    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute_variants(words):
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


SPELLING = ("word", "form", "root", "n", "n_near", "form_n")


def _noisy(r, n):
    base = ["".join(r.choice("abé") for _ in range(r.randint(7, 12))) for _ in range(n)]
    words = Counter()
    for w in base:
        words[w] += r.choice((2, 30, 400))
        for _ in range(3):
            i, kind = r.randrange(len(w) + 1), r.randrange(3)
            v = w[:i] + "".join(r.choice("abéx") for _ in range(kind > 0)) + w[i + (kind < 2) :]
            words[v] += r.choice((1, 2, 35))
    return {w: c for w, c in words.items() if len(w) >= 2}


@pytest.mark.parametrize("most", [128, 3])
def test_spelling_equals_a_plain_loop(spark, most):
    r = random.Random(11)
    words = _noisy(r, 120) | {"a" * k: 5 * 10 ** (k % 3) for k in range(2, 14)} | {"q" * 200: 50, "q" * 100 + "r" + "q" * 99: 3, "q" * 201: 700, "ab": 1, "b": 1000}
    words = {w: c for w, c in words.items() if len(w) >= 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = sorted(tuple(sorted((p.word, p.other))) for p in spelling.near_pairs(df, most).collect())
    names = sorted(words)
    assert pairs == sorted((a, b) for i, a in enumerate(names) for b in names[i + 1 :] if _near(a, b))
    assert _rows(spelling.variants(df, most=most), *SPELLING) == _brute_variants(words)


def test_spelling_words_and_odd_rows(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    pool = ["Éclairage", "éclairage", "tionally", "TIONALLY", "nationally", "rational", "x×y÷zzzz", "ab", "occurrence", "occurence", "ocurrence"]
    rows = [(i if i % 9 else None, " ".join(r.choice(pool) for _ in range(60))) for i in range(50)] + [(7, None), (7, ""), (8, "9 _ -"), (9, "w" * 70_000 + " " + "w" * 70_000), *[(3, "nationally nationally")] * 2]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("y"))
    monkeypatch.setattr(spelling, "HELD_WORDS", 4)
    assert {r.word: r.n for r in spelling.dictionary(df, drop_every=31).collect()} == _brute_words(rows)
    assert {r.word: r.n for r in spelling.dictionary(df).collect()} == _brute_words(rows, None)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert _rows(spelling.query(spark, str(tmp_path)), *SPELLING) == _brute_variants(_brute_words(rows))
    df.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert spelling.query(spark, f"{tmp_path}/none").isEmpty()


def test_spelling_subdivides_one_prefix_of_many_words(spark):
    words = {"prefixed" + a + b + c + d: 2 for a in "abcde" for b in "fghij" for c in "klmno" for d in "pqrst"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = spelling._keyed(spelling.ranges(df, 16)).filter("m - p - s > 1").groupBy("head", "tail", "m", "p", "s").count()
    assert sizes.agg(F.max("count")).first()[0] <= 16
    assert {r.n_near for r in spelling.variants(df, most=16).select("n_near").collect()} == {16}
