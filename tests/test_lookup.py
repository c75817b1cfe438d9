"""Lookup tables of chunks."""

from lexiflow.sources import lookup


def test_lookups_move_no_chunk(spark, tmp_path):
    rows = [(f"d{i // 6}#{i % 6}", f"s{i // 10}" if i % 7 else None, i // 6, f"text {i}") for i in range(120)] + [(None, "s1", None, "lost"), ("d1#1", "s1", 1, "again")]
    df = spark.createDataFrame(rows, "chunk_id string, section_id string, doc_id long, text string")
    s = lookup.store_chunks(df, "lookup_test", str(tmp_path / "t"), 4)
    told = lambda x: sorted((r.chunk_id or "", r.section_id or "", r.doc_id if r.doc_id is not None else -1, r.text) for r in x.collect())
    want = lambda f: sorted((a or "", b or "", c if c is not None else -1, t) for a, b, c, t in rows if f(a, b, c))
    assert told(s.chunks(["d1#1", "d19#5", "none"])) == want(lambda a, b, c: a in ("d1#1", "d19#5"))
    assert told(s.of_sections(["s1"])) == want(lambda a, b, c: b == "s1") and told(s.of_documents([1, 3])) == want(lambda a, b, c: c in (1, 3))
    ids = spark.createDataFrame([("d2#2",), ("d2#2",), (None,), ("x",)], "id string")
    assert told(s.chunks(ids)) == want(lambda a, b, c: a == "d2#2") and s.chunks([]).isEmpty()
    assert {(r.section_id, r.n) for r in s.sections().collect()} == {(k, sum(b == k for _, b, _, _ in rows)) for k in {b for _, b, _, _ in rows} - {None}}
    assert sum(r.n for r in s.documents().collect()) == 121
    assert s.section_ids().count() == 12 and s.document_ids().count() == 20
    for x in (s.chunks(["d1#1"]), s.of_sections(["s1", "s2"]), s.documents()):
        assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
    again = lookup.store_chunks(df.limit(3), "lookup_test", str(tmp_path / "t"), 2)
    assert again.documents().count() == 1


def test_corpus_names():
    names = {"textbook": "books", "pubmed": "articles"}
    assert [lookup.corpus_of(p, names, "other") for p in ("/a/PubMed_v1/", "hdfs://x/textbooks", "/pubmed/z")] == ["articles", "books", "other"]
