"""Phrase matching against plain loops."""

import random

from pyspark.sql import functions as F

from lexiflow.operators import phrases


def test_matches_equal_a_plain_loop(spark):
    r = random.Random(3)
    texts = [(i, [r.choice("aabcd") for _ in range(r.randint(0, 14))]) for i in range(60)] + [(60, None), (61, [])]
    words = [([r.choice("abcde") for _ in range(r.randint(1, 4))], f"v{i}") for i in range(25)] + [([], "none"), (None, "null"), (["a", "b"], "first"), (["a", "b"], "second")]
    t = spark.createDataFrame(texts, "key long, w array<string>")
    p = spark.createDataFrame(words, "phrase array<string>, value string")
    every = [(k, s, tuple(x), v) for k, w in texts for x, v in words if w and x for s in range(len(w) - len(x) + 1) if w[s : s + len(x)] == x]
    inside = lambda a, b: a[0] == b[0] and b[1] <= a[1] and b[1] + len(b[2]) >= a[1] + len(a[2]) and len(b[2]) > len(a[2])
    for longest in (False, True):
        got = sorted((x.key, x.start, tuple(x.phrase), x.value) for x in phrases.matches(t, p, "key", F.col("w"), longest).collect())
        assert got == sorted(a for a in every if not longest or not any(inside(a, b) for b in every))
    assert phrases.matches(t, p.limit(0), "key", F.col("w")).isEmpty() and phrases.matches(t.limit(0), p, "key", F.col("w")).isEmpty()


def test_phrases_are_anchored_at_rare_tokens(spark):
    t = spark.createDataFrame([(i, ["the", "of", "word" if i else "rare"]) for i in range(9)], "key long, w array<string>")
    p = spark.createDataFrame([(["of", "the", "rare", "word"],), (["the", "of"],)], "phrase array<string>")
    got = {tuple(x.phrase): (x.anchor, x.at) for x in phrases.anchored(t.select(F.col("w").alias("tokens")), p).collect()}
    assert got == {("of", "the", "rare", "word"): ("rare", 2), ("the", "of"): ("of", 1)}


def test_substrings_without_a_product(spark):
    texts = [(1, "xone two  three fourx"), (2, "one two three four"), (3, None), (4, ""), (5, "one two  three\nfour five"), (5, "other")]
    passages = [(1, "one two  three four"), (2, "ne two three fo"), (3, "two  three\nfour"), (4, None), (5, " two "), (6, "five"), (7, "unknown words here now")]
    t, p = spark.createDataFrame(texts, "d long, t string"), spark.createDataFrame(passages, "i long, p string")
    want = sorted({(d, i) for d, x in texts for i, y in passages if x is not None and y is not None and y in x})
    assert sorted(map(tuple, phrases.containing(t, p, "d", "t", "i", "p").collect())) == want
    long = phrases.containing(t, p.filter("i in (1, 2, 7)"), "d", "t", "i", "p")
    assert sorted(map(tuple, long.collect())) == [x for x in want if x[1] in (1, 2, 7)]
    plan = long._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_expansions(spark):
    rows = [(1, "Which of the following is a  HCN?"), (2, None), (3, "  "), (4, "gingivitis edema color"), (5, "zz")]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("_text", F.lit(1)).withColumn("extra", F.lit(2))
    got = {x.k: x.expansions for x in phrases.expansions(df, phrases.dictionary(spark), "k", "t").collect()}
    assert set(got) == {1, 4, 5} and got[5] == ["zz"]
    assert got[1][:2] == ["if channels", "if current"] or got[1][0] == "if current"
    assert {"which of the following is a hcn?", "mcq", "exam question", "funny current", "hcn"} <= set(got[1]) and got[1][-1] == "true/false"
    assert {"gum", "oedema", "colour", "periodontal"} <= set(got[4])
    assert all(len(v) == 3 for v in [phrases.expansions(df, phrases.dictionary(spark), "k", "t", 3).filter("k = 1").first().expansions])
