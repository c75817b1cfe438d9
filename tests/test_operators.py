"""Properties and small fixtures of operators."""

import math

from pyspark.sql import functions as F

from lexiflow.functions import answers, parse, text
from lexiflow.operators import analytics, chunking, enrich, fusion, index, retrieval, sampling
from lexiflow.plans import registry
from lexiflow.sources import files, predictions
from lexiflow.streaming import sessions


def test_mcnemar_published(spark):
    p = spark.createDataFrame([(220, 162), (152, 144), (0, 0)], "a long, b long").select(analytics.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()
    assert math.isclose(p[0].p, 0.00348701, rel_tol=1e-5) and math.isclose(p[1].p, 0.68417649, rel_tol=1e-6) and p[2].p == 1.0


def test_packing_stays_in_budget(spark):
    rows = [(q, i, i, (i * 37 + q * 11) % 90 + 1) for q in range(20) for i in range(1, 15)]
    hits = spark.createDataFrame(rows, "q long, id long, rank int, tokens long")
    for out, most in ((fusion.pack_prefix(hits, "tokens", 200).groupBy("q").agg(F.sum("tokens").alias("used")), 200), (fusion.pack_fold(hits, "tokens", 200), 200), (fusion.pack_fold(hits, "tokens", 200, 16), 200)):
        assert all(r.used <= most for r in out.collect())
    size = {}
    for q, i, _, t in rows:
        size[q, i] = t
    for r in fusion.pack_fold(hits, "tokens", 200, 16).collect():
        assert all(k.tokens == size[r.q, k.id] for k in r.kept[:-1])


def greedy(units, least, target, most):
    """The rule as a loop: units over the most tokens flush what is held and are split by sentences."""
    import re

    out, held, n = [], [], 0
    for p in units:
        t = len(p) // 4
        if t > most:
            if held:
                out.append("\n\n".join(held))
            held, n, some, m = [], 0, [], 0
            for s in re.split(r"(?<=[.!?])\s+", p):
                if m + len(s) // 4 > most and some:
                    out.append(" ".join(some))
                    some, m = [], 0
                some.append(s)
                m += len(s) // 4
            if some:
                out.append(" ".join(some))
            continue
        if n + t > most and n >= least:
            out.append("\n\n".join(held))
            held, n = [], 0
        held.append(p)
        n += t
        if n >= target:
            out.append("\n\n".join(held))
            held, n = [], 0
    if held and n >= least:
        out.append("\n\n".join(held))
    return out


def test_greedy_packing_matches_a_loop(spark):
    import random

    r = random.Random(4)
    sentence = lambda n: "x" * max(1, n - 1) + r.choice([".", "!", "?", ","])
    units = [["x" * (37 * i % 900 + 4) for i in range(k, k + 30)] for k in range(10)]
    units += [[" ".join(sentence(r.choice([9, 90, 400, 1500])) for _ in range(r.randint(1, 12))) for _ in range(12)] for _ in range(20)]
    units += [["y" * 300, " ".join(["z" * 399 + "."] * 5), "w" * 900], []]
    got = spark.createDataFrame([(u,) for u in units], "u array<string>").select(chunking.pack(F.col("u"), 120, 220, 350).alias("c")).collect()
    assert [g.c for g in got] == [greedy(u, 120, 220, 350) for u in units]
    assert got[-2].c == ["y" * 300, *[" ".join(["z" * 399 + "."] * n) for n in (3, 2)], "w" * 900]


def test_sentence_windows_match_a_loop(spark):
    import random
    import re

    def windows(text, size, overlap):
        if not text:
            return []
        if len(text) <= size:
            return [text]
        out, held = [], ""
        for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]:
            if not held:
                held = s
            elif len(held) + 1 + len(s) <= size:
                held += " " + s
            else:
                out.append(held)
                held = (held[-overlap:].split(" ", 1)[-1] + " " + s).strip()
        return out + [held] * bool(held)

    r = random.Random(2)
    texts = ["", "short. one", *[" ".join(r.choice(["a", "bc", "def", "ghij."]) for _ in range(r.randint(1, 120))) for _ in range(60)], "x" * 90 + ". " + "y" * 70]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(chunking.sentence_windows(F.col("t"), 60, 20).alias("c")).collect()
    assert [g.c for g in got] == [windows(t, 60, 20) for t in texts]


def test_ordered_dedup(spark):
    rows = [(i, f"t{i % 7}", f"x{i % 5}") for i in range(60)] + [(60, "t9", "x0"), (61, "t9", "x9"), (62, "t8", "x8")]
    got = {r.id for r in sampling.dedup_title_or_text(spark.createDataFrame(rows, "id long, t string, x string"), F.col("t"), F.col("x"), "id").collect()}
    titles, texts, want = set(), set(), set()
    for i, t, x in rows:
        if t not in titles and x not in texts:
            want.add(i)
            titles.add(t)
            texts.add(x)
    assert got == want


def test_cleaning_order(spark):
    raw = "Intro text here\nFigure 3 shows the panel\n12\n\n\n\nmore  words ©2001 me\nReferences\nSmith"
    assert spark.range(1).select(text.clean(F.lit(raw))).first()[0] == "Intro text here\n\nmore words"


def test_letters(spark):
    f = lambda s: spark.range(1).select(answers.answer_letter(F.lit(s))).first()[0]
    assert [f("Answer： d"), f("x\n b "), f("it is C, no"), f("none")] == ["D", "B", "C", None]


def test_bm25_is_stable_under_partitioning(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").limit(5)
    t = text.whitespace_tokens(F.col("text"))
    a = retrieval.bm25(docs, bench, "doc_id", "item_id", t, t).withColumn("score", F.round("score", 6))
    b = retrieval.bm25(docs.repartition(13), bench, "doc_id", "item_id", t, t).withColumn("score", F.round("score", 6))
    assert a.exceptAll(b).count() == 0


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\nnot json\n{"id": "2"}\n')
    df = files.complete(files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, text string").filter("id is not null"))
    assert sorted((r.id, r.text, r.url) for r in df.collect()) == [("1", "x", ""), ("2", "", "")]
    files.write_jsonl(df, str(tmp_path / "out"))
    files.write_csv(df, str(tmp_path / "csv"), ["text", "id"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert files.next_version(spark, str(tmp_path / "out")).endswith("out_v2")
    (tmp_path / "b.json").write_text('[{"id": "1"},\n {"id": "2"}, {"id": "3"}]')
    assert files.read_json_any(spark, str(tmp_path / "b.json"), "id string").count() == 3
    (tmp_path / "book.txt").write_text("one\ntwo")
    assert files.read_books(spark, str(tmp_path)).first().book == "book"
    run = tmp_path / "runs" / "dense" / "k20"
    run.mkdir(parents=True)
    (run / "metrics.json").write_text('{"correct": 3}')
    r = files.read_runs(spark, str(tmp_path / "runs"), "correct long", ["retrieval", "coarse"]).first()
    assert (r.correct, r.retrieval, r.coarse) == (3, "dense", "k20")


def test_session_stream(spark, sf, tmp_path):
    src = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").limit(500).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = sessions.distinct_stream(stream, "event_id").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 500
    q = sessions.sessions_stream(stream).writeStream.format("memory").queryName("sess").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("sess").count() == sessions.sessions(spark.read.parquet(str(src))).count()


def test_keywords_and_highlights_of_every_language(spark, tmp_path):
    import collections
    import hashlib
    import re

    texts = [("en", "The Cell met the Nerve. Cell with Über Ärzte from"), ("de", "Herz und Niere: Herz withÄ with, FROMage fromé"), ("fr", "Étude Coeur Coeurs d\u2019Artère thatôt that_1 éthat"), (None, "Lung Lung With no language"), ("es", "nada")]
    spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    words, marked = {}, {}
    for i, (_, t) in enumerate(texts):
        found = collections.Counter(w for w in re.findall(r"\b[A-Z][a-z]+\b", t) if len(w) > 3 and w not in enrich.COMMON)
        if found:
            words[i] = ",".join(w for w, _ in found.most_common(10))
        marked[i] = hashlib.md5(re.sub(r"\b(that|with|from)\w*\b", r"**\g<0>**", t, flags=re.I).encode()).hexdigest()
    assert {r.doc_id: r.keywords for r in registry.QUERIES["top_keywords_whole"](spark, str(tmp_path)).collect()} == words
    assert {r.doc_id: r.h for r in registry.QUERIES["highlight_whole"](spark, str(tmp_path)).collect()} == marked


def test_context_keeps_whole_passages(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {}
    for r in sorted(registry.QUERIES["bm25_topk"](spark, sf).filter("rank <= 6").collect(), key=lambda r: (r.item_id, r["rank"])):
        want.setdefault(r.item_id, []).append((r["rank"], docs[r.doc_id]))
    got = {r.q: (r.refs, r.tokens) for r in registry.QUERIES["context_whole"](spark, sf).collect()}
    assert got == {q: ("\n".join(f"Reference {n}: [{x.source or ''}] {x.text}" for n, x in hits), sum(x.n_chars // 4 for _, x in hits)) for q, hits in want.items()}


def test_few_shot_fills_up_from_other_subjects(spark):
    import random

    rng = random.Random(3)
    tables = [[(i, rng.choice(["a"] * 6 + ["b", "b", "c", None]), f"t{rng.randrange(texts)}") for i in range(n)] for n, texts in ((3, 9), (9, 3), (40, 2), (40, 12), (60, 60))]
    tables.append([(i, "big", "same") for i in range(20)] + [(20 + i, f"s{i}", "same") for i in range(20)] + [(50, "x", "own"), (51, "y", None), (52, "y", "z")])
    for rows in tables:
        for k in (1, 3, 5):
            want = set()
            for i, s, x in rows:
                met = sorted((t != s, j) for j, t, y in rows if j != i and y != x)
                want |= {(i, j, n + 1) for n, (_, j) in enumerate(met[:k])}
            df = spark.createDataFrame(rows, "id long, s string, x string")
            assert {tuple(r) for r in sampling.few_shot(df, df, k, "id", "s", "x").collect()} == want


def test_stored_bm25_scores_as_computed(spark, sf, tmp_path):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").limit(7)
    t = text.whitespace_tokens(F.col("text"))
    index.build_bm25(docs, "doc_id", t, str(tmp_path / "bm25"))
    held = index.open_index(spark, str(tmp_path / "bm25"))
    a = held.search(bench, "doc_id", "item_id", t).withColumn("score", F.round("score", 6))
    b = retrieval.bm25(docs, bench, "doc_id", "item_id", t, t).withColumn("score", F.round("score", 6))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    odd = spark.createDataFrame([(1, "a a b"), (2, None), (3, ""), (4, "b")], "doc_id long, text string")
    assert sorted(map(tuple, index.postings(odd, "doc_id", t).select("doc_id", "dl", "term", "tf").collect())) == [(1, 3, "a", 2), (1, 3, "b", 1), (4, 1, "b", 1)]


def test_predictions_are_numbered_by_line(spark, tmp_path):
    lines = ['{"example_id": "x", "gold_answer": "A", "predicted_answer": "A"}', "", '{"gold_answer": "B", "predicted_answer": "C", "is_correct": true}', '{"example_id": " ", "gold_answer": "B"}']
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    got = predictions.read_predictions(spark, str(tmp_path / "p.jsonl")).orderBy("row_id").collect()
    assert [(r.row_id, r.example_id, r.is_correct, r.question) for r in got] == [(1, "x", True, ""), (3, "row_3", True, ""), (4, "row_4", False, "")]
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "n"))
    n = predictions.numbered(spark.read.parquet(str(tmp_path / "n"))).select("row_id").collect()
    assert sorted(r.row_id for r in n) == list(range(1, 1001))


def test_sanitisers_keep_order(spark):
    x = spark.createDataFrame([([" heart attack ", "a", "Except", None, "mi now", "heart attack", "x" * 51],), (None,)], "t array<string>")
    got = x.select(parse.sanitize_expansions(F.col("t")).alias("e"), parse.sanitize_terms(F.col("t")).alias("s")).collect()
    assert got[0].e == ["heart attack", "mi now"] and got[0].s == [" heart attack ", "a", "Except", "mi now", "heart attack", "x" * 51]
    assert got[1].e == got[1].s == []


def test_pairwise_interval(spark):
    pairs = spark.createDataFrame([(i, i % 3 > 0, i % 5 > 0) for i in range(300)], "row_id long, a boolean, b boolean")
    r = analytics.pairwise(pairs).first()
    assert r.n == 300 and math.isclose(r.delta, 0.8 - 2 / 3, abs_tol=1e-9) and r.low <= r.delta <= r.high
