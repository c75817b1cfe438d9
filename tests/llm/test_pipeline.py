"""The pipeline against its stages redone by brute force on a small table."""

import collections

import corpus_pipeline
from tests_llm_help import linked_components


def test_pipeline(spark, tmp_path, sf):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    d = str(tmp_path / "sf")
    docs.write.parquet(f"{d}/documents.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, d), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "near_duplicates":
            comp = linked_components([(r.doc_id, r.text) for r in docs.collect()], 80, 5)
            assert sorted(r.doc_id for r in out.collect()) == sorted({c for c in comp.values()})
        if name == "suffix_array_dedup":
            seen, again = set(), 0
            for r in out.orderBy("doc_id").collect():
                t = r.text.encode()
                own = {t[p : p + 50] for p in range(len(t) - 49)}
                again += len(own & seen)
                seen |= own
            assert again < 0.001 * len(seen)  # only where two kept parts meet anew
        if name == "bpe_tokens":
            have = collections.Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in out.collect())
            assert have == collections.Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
        docs = out
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_mixture_gives_whole_texts(spark, tmp_path):
    rows = [(i, f"a{i}  b\n" * (40 + 7 * i), f"s{i % 3}") for i in range(12)] + [(12, "alone  " * 90, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect()
    texts = {i: t for i, t, _ in rows}
    assert out and all(r.text == texts[r.doc_id] for r in out)
    mixed = corpus_pipeline.mixing.mix(docs, corpus_pipeline.F.array("source")).select("doc_id", "mix.size", "mix.taken").collect()
    assert any(r.taken % r["size"] for r in mixed)
    copies = collections.Counter(r.doc_id for r in out)
    assert all(copies[r.doc_id] == (2 * r.taken + r["size"]) // (2 * r["size"]) for r in mixed)


def test_near_duplicates_of_one_id(spark, tmp_path):
    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    near = text("a") + " more"
    rows = [(1, text("a")), (5, near), (5, text("b")), (5, text("b")), (5, text("c")), (7, text("c")), (7, text("d")), (8, text("d")), (8, text("d") + " x"), (9, " "), (9, " "), (9, text("e")), (10, None), (10, None), (None, text("a")), (None, text("a")), (11, text("f")), (11, text("f"))]
    docs = spark.createDataFrame([(*r, f"s{i}") for i, r in enumerate(rows)], "doc_id long, text string, source string").repartition(5)
    want = [(1, text("a")), (5, text("b")), (5, text("c")), (7, text("d")), (9, " "), (9, " "), (9, text("e")), (10, None), (10, None), (None, text("a")), (None, text("a")), (11, text("f"))]
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(want)
    top = spark.createDataFrame([((1 << 63) - 1, text("g")), ((1 << 63) - 1, text("h")), (3, text("g"))], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, top, str(tmp_path)).collect()} == {(3, text("g")), ((1 << 63) - 1, text("h"))}


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, quality string, repeats int, mix string, MIX2 int"


def test_stages_keep_clashing_columns_and_odd_rows(spark, tmp_path):
    """Nulls, empty, long, tied and repeated rows; columns named like the operators' results; empty tables."""
    good = lambda w: "\n".join(f"The {w}a{i} of {w}b{i} has, {w}c{i} {w}d{i}." for i in range(9))
    long = " ".join(f"word{i}" + "." * (i % 9 == 0) for i in range(60_000))
    rows = [(1, good("cat")), (1, good("cat")), (2, good("cat")), (3, None), (4, ""), (None, good("dog")), (None, good("dog")), (None, None), (5, good("emu")), (5, good("fox")), (6, long), (7, " \n ")]
    full = [(i, t, None if k % 2 else "en", f"s{k % 2}" if k % 5 else None, None if t is None else len(t), "q", k, "m", k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, CLASHES)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r.quality == "q" and r.mix == "m" and r.repeats == r.MIX2 and r.n_chars == (None if r.text is None else len(r.text)) for r in got), name
        kept[name] = collections.Counter((r.doc_id, r.text) for r in got)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    worded = collections.Counter((i, t) for i, t in rows if t and t.strip())
    assert kept["quality_rules"] == worded
    assert kept["near_duplicates"] == collections.Counter([(1, good("cat")), (5, good("emu")), (5, good("fox")), (6, long), *[r for r in rows if not r[1] or r[0] is None or r[0] == 7]])
    assert {i for i, _ in kept["suffix_array_dedup"]} == {1, 5, 6, None} and set(kept["source_mix"]) <= set(worded)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {(r.doc_id, r.n_tokens > 0) for r in out.collect()} == {(i, bool(t and t.strip())) for i, t in rows} and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_own_replacement_characters_stay(spark, tmp_path):
    """A cut through a character drops its other bytes, never a character that the document has itself."""
    passage = "".join(chr(0x4E00 + i) for i in range(18))
    rows = [(1, f"x{passage}y"), (2, chr(0x5000) + passage[1:] + "\ufffd, \u00e9nd")]  # the first character's last byte is equal
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in corpus_pipeline.passages(spark, docs, str(tmp_path)).collect()} == {1: rows[0][1], 2: "\ufffd, \u00e9nd"}
