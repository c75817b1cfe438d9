"""Text, structure and table operators against plain loops."""

import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexiflow.functions import parse, text
from lexiflow.operators import analytics, chunking, sampling
from lexiflow.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_paragraphs_of_every_script(spark):
    parts = ["это русский абзац", "an English one", "这 是 段落", "12 -- 34 + 5", "२ ३ ४", "½ of it", "a_b - -", "two words", "  \t padded one here \t", "line one\nline two"]
    rows = [(1, "\n\n".join(parts)), (2, None), (3, "")]

    def kept(p):  # as the reference's pattern reads it, whose classes know all scripts
        p = p.strip().replace("\n", " ")
        return p if len(p.split()) >= 3 and not re.match(r"^[\W\d]+$", p) else None

    got = chunking.paragraphs(spark.createDataFrame(rows, "k long, t string"), "k", F.col("t")).orderBy("pos").collect()
    assert [r.paragraph for r in got] == [p for p in map(kept, parts) if p] and {r.k for r in got} == {1}


def test_white_space_and_captions(spark):
    def squeezed(t):
        t = re.sub(r"\n\s*\n\s*\n+", "\n\n", re.sub(r" +", " ", t))
        return "\n".join(x.rstrip() for x in t.split("\n")).strip()

    r = random.Random(1)
    for t in ["a\n \n \nb", "a\n\n\n\nb  \n c", *["".join(r.choice(["a", " ", "\n", "\t", "b"]) for _ in range(30)) for _ in range(40)]]:
        assert one(spark, t, text.squeeze) == squeezed(t), repr(t)
    assert one(spark, "the panel shows \nthe panel shows it\nx", text.drop_figures) == "the panel shows \nx"


def test_record_texts(spark):
    rows = [("T", ["a", None, " b  c "], None, 5), (None, None, None, 7), ("", None, "x\n y", 1)]
    df = spark.createDataFrame(rows, "title string, abstract array<string>, body string, text int")
    got = [r.x for r in df.select(parse.record_text(df).alias("x")).collect()]
    assert got == ["T a b c", '{"text":7}', "x y"]


def _sections(body):
    level = lambda s: next((i + 2 for i, p in enumerate(chunking.SECTIONS) if re.match(p, s)), 2 if s.isupper() and len(s.split()) >= 2 and len(s) < 80 else 3 if s.istitle() and len(s.split()) >= 3 and len(s) < 80 and not any(c.isdigit() for c in s) and not s.endswith((".", ",", ";", ":")) else 0) if s and len(s) <= 100 else 0
    out, head, held, n = [], "", [], 0
    for line in [*body.split("\n"), None]:
        if line is None or level(line.strip()):
            if (b := "\n".join(held).strip()):
                out.append((n, head, level(head) or None, b))
            if line is not None:
                head, held, n = line.strip(), [], n + 1
        else:
            held.append(line)
    return out


def test_sections_equal_a_plain_loop(spark):
    r = random.Random(6)
    lines = ["GENERAL MATTERS", "1.2 Details", "1.2.3 More Of It", "Heart And Lung Disease in man", "An Old Title Here.", "plain text", "", "  TWO WORDS ", "Sentence here.", "IX", "A" * 101 + " B", "The Large 2 Things", "Three Small Words", "x\ty"]
    books = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 12)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(books, "k long, t string")
    got = sorted((x.k, x.ordinal, x.heading, x.level, x.body) for x in chunking.split_at(df, "k", F.col("t"), chunking.is_section, F.lit("")).withColumn("level", chunking.section_level(F.col("heading"))).collect())
    assert got == sorted((k, *s) for k, t in books if t for s in _sections(t))


def test_book_sections_equal_a_plain_loop(spark):
    book = "preface\nChapter 1: One\nintro\nGENERAL MATTERS\nbody\n\nmore\nIV. Four\n1.2 Details\nend"
    got = chunking.book_sections(spark.createDataFrame([(1, book), (2, "only text"), (3, None)], "k long, t string"), "k", F.col("t")).orderBy("k", "n").collect()
    want, chapter, held = [], "Introduction", []
    for line in [*book.split("\n"), None]:
        if line is None or re.match(chunking.CHAPTER, line.strip()):
            want += [(chapter, s[1], s[3]) for s in _sections("\n".join(held))]
            chapter, held = line, []
        else:
            held.append(line)
    assert [(r.k, r.n, r.chapter, r.section, r.body) for r in got] == [(1, i, *w) for i, w in enumerate(want)] + [(2, 0, "Introduction", "", "only text")]


def test_ordered_dedup_with_nulls_and_repeats(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, "a", "b", "c", f"t{i}"]), r.choice(["x", "y", f"x{i}", f"x{i}", None])) for i in range(150)] + [(1000, None, "new"), (1000, None, "new")]
    titles, texts, want = set(), set(), []
    for i, t, x in rows:
        if (t is None or t not in titles) and (x or "") not in texts:
            want.append(i)
            titles.add(t)
            texts.add(x or "")
    df = spark.createDataFrame(rows, "id long, t string, x string")
    assert sorted(x.id for x in sampling.dedup_title_or_text(df.repartition(5), F.col("t"), F.col("x"), "id").collect()) == want
    assert sampling.dedup_title_or_text(df.limit(0), F.col("t"), F.col("x"), "id").isEmpty()


def test_quantiles_of_counted_values(spark):
    r = random.Random(2)
    rows = [(g, r.choice([None, *range(5)])) for g in ("a", "b", None) for _ in range(r.randint(5, 40))] + [("none", None), ("one", 7)]
    got = {x.g: x for x in analytics.index_quantiles(spark.createDataFrame(rows, "g string, v int"), "g", "v").collect()}
    for g in {x[0] for x in rows}:
        v = sorted(x for y, x in rows if y == g and x is not None)
        want = (np.mean(v), v[0], v[-1], *[v[len(v) * k // 4] for k in (1, 2, 3)]) if v else (None,) * 6
        assert np.allclose(np.array(got[g][1:], float), np.array(want, float), equal_nan=True)


def test_manifest_of_null_sources(spark, tmp_path):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("",)], "source string").withColumn("n", F.lit("x"))
    want = {"counts": {"": 1, "(none)": 1, "a": 2}}
    assert json.loads(files.manifest(df, "source").first().manifest) == want
    files.write_manifest(df, "source", f"{tmp_path}/m")
    assert json.loads(spark.read.text(f"{tmp_path}/m").first().value) == want


def test_bootstrap_interval(spark):
    """The interval of the counts' resamples is that of resampled rows, within the error of the draws."""
    rows = [("g", i % 10 < 6, i % 7 < 3) for i in range(400)] + [("h", True, True)] * 5
    got = {x.g: x for x in analytics.bootstrap(spark.createDataFrame(rows, "g string, a boolean, b boolean"), "g", "a", "b").collect()}
    d = np.array([int(a) - int(b) for g, a, b in rows if g == "g"])
    rng = np.random.default_rng(0)
    means = np.sort([rng.choice(d, len(d)).mean() for _ in range(3000)])
    assert got["g"].delta == d.mean() and abs(got["g"].low - means[75]) < 0.02 and abs(got["g"].high - means[2925]) < 0.02
    assert (got["h"].delta, got["h"].low, got["h"].high) == (0, 0, 0)


def test_xml_articles(spark, tmp_path):
    article = "<PubmedArticle><MedlineCitation><PMID Version='1'>{}</PMID><Article><ArticleTitle>{}</ArticleTitle>{}<Journal><Title>J</Title><JournalIssue><PubDate>{}</PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>"
    parts = "<Abstract><AbstractText Label='A'>one </AbstractText><AbstractText Label='B'> two</AbstractText><AbstractText Label='C'></AbstractText></Abstract>"
    xml = ["<PubmedArticleSet>", article.format(1, "First", parts, "<Year>2001</Year>"), article.format(2, "Second", "<Abstract><AbstractText>plain</AbstractText></Abstract>", "<MedlineDate>1998 Jan-Feb</MedlineDate>"), article.format(3, "", "", ""), "<PubmedArticle><MedlineCitation><PMID>4</PMID", "</PubmedArticle>", "</PubmedArticleSet>"]
    (tmp_path / "a.xml").write_text("\n".join(xml))
    rows = files.read_xml_articles(spark, str(tmp_path / "a.xml")).collect()
    good = sorted((r.pmid, r.title, r.abstract, r.journal, r.year) for r in rows if r.malformed is None)
    assert good == [("1", "First", "one two", "J", 2001), ("2", "Second", "plain", "J", 1998), ("3", "", "", "J", None)]
    assert sum(r.malformed is not None for r in rows) == 1
