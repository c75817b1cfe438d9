"""Variants, plug points, samples and prompts against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import answers
from lexiflow.functions.text import whitespace_tokens
from lexiflow.operators import index, retriever, sampling


def test_variants(spark):
    rows = [(1, " What? ", {"B": " two ", "A": "one", "C": " "}, ["exp", "", None]), (2, "  ", {"A": "x"}, ["y"]), (3, "Only", None, None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "k long, t string, o map<string,string>, e array<string>")
    got = {(r.q, r.variant, r.kind, r.weight, r.text) for r in retriever.variants(df, "k", F.col("t"), F.col("o"), F.col("e"), {"option": 0.5}).collect()}
    assert got == {(1, "1_base_0", "base", 1.0, "What?"), (1, "1_option_A", "option", 0.5, "What?\nOption: one"), (1, "1_option_B", "option", 0.5, "What?\nOption: two"), (1, "1_expansion_0", "expansion", 1.0, "What? exp"), (3, "3_base_0", "base", 1.0, "Only")}


def test_modes_and_plug_points(spark, tmp_path):
    """The encoder and tokeniser that are given are those that are used."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red apple", "green apple", "red car", "blue sky", "sky car red"])], "doc_id long, text string")
    letters = lambda c: F.array(*[F.regexp_count(F.lower(c), F.lit(a)).cast("double") for a in "aeprs"])
    index.build_bm25(docs, "doc_id", whitespace_tokens(F.col("text")), f"{tmp_path}/i")
    config = index.Config(tokens=whitespace_tokens, encode=letters, score_pair=lambda q, t: F.length(t).cast("double"))
    r = retriever.Retriever(config, index.Bm25.open(spark, f"{tmp_path}/i"), docs.select(F.col("doc_id").alias("id"), letters(F.col("text")).alias("v")))
    asked = retriever.variants(spark.createDataFrame([(9, "red apple")], "k long, t string"), "k", F.col("t"))
    top = lambda mode: [x.id for x in r.search(asked, 3, mode).orderBy("rank").collect()]
    assert top("sparse")[0] == 0 and top("dense")[0] == 0 and set(top("sparse")) <= {0, 1, 2, 4}
    both = {x.id: x.votes for x in r.search(asked, 5, "hybrid").collect()}
    assert both[0] == 2
    with pytest.raises(ValueError):
        r.lists(asked, 3, "other")
    sections = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).alias("section"), "text")
    staged = r.staged(asked, sections, 2, 5, 1, 2)
    assert {x.id % 2 for x in staged.collect()} == {0} and [x.new_rank for x in staged.orderBy("new_rank").collect()] == [1, 2]


def test_samples_merge(spark):
    """The sample of all rows, however they are dealt and in whatever portions they come."""
    ids = list(range(500))
    want = sorted(sorted(ids, key=lambda i: (hashlib.md5(f"{i}s".encode()).hexdigest(), i))[:20])
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert sorted(x.id for x in sampling.sample_of(df.repartition(7), "id", 20, "s").collect()) == want
    random.Random(1).shuffle(ids)
    held = None
    for part in (ids[:100], ids[100:110], ids[110:]):
        held = sampling.merge_samples(held, spark.createDataFrame([(i,) for i in part], "id long"), "id", 20, "s")
    assert sorted(x.id for x in held.collect()) == want
    plan = sampling.sample_of(df, "id", 20, "s")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_references_and_prompts(spark):
    row = spark.createDataFrame([("src", " Title ", "http://x", "a\nb " + "c" * 400), (None, None, None, None)], "s string, t string, u string, x string")
    got = [r.r for r in row.select(answers.reference(F.lit(2), F.col("s"), F.col("t"), F.col("u"), F.col("x")).alias("r")).collect()]
    assert got == ["Reference 2: [src] Title (URL: http://x)\n" + ("a b " + "c" * 400)[:320] + "...", "Reference 2: \n"]
    options = F.create_map(F.lit("B"), F.lit("two"), F.lit("A"), F.lit("one"), F.lit("C"), F.lit(" "))
    shots = F.array(F.struct(F.lit("q1").alias("question"), F.lit("A) x").alias("options"), F.lit("A").alias("answer")))
    text = spark.range(1).select(answers.styled_prompt(F.lit("Why?"), options, F.array(F.lit("ref")), shots, True).alias("p")).first().p
    assert text == "Choose exactly one option. Valid answers: {A B}.\n\nThink step by step between <Reasoning> and </Reasoning>, then give the letter.\n\nQuestion: q1\nA) x\nAnswer: A\n\nref\n\nQuestion: Why?\n\nOptions:\nA) one\nB) two\n\n<Reasoning>"
    assert spark.range(1).select(answers.styled_prompt(F.lit("Why?"), options).alias("p")).first().p.endswith("\n\nAnswer: ")
