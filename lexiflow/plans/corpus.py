"""Queries of corpus preparation: keys, cleaning, filters, chunking, enrichment, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import chunking as C
from ..operators import enrich as E
from ..operators import sampling as S
from .tables import load

# Artefacts that the corpus lacks are put in on both sides, by the document's number.
_DIRTY = "concat(text, CASE doc_id % 5 WHEN 0 THEN '\\nsee Figure 3 here\\nFig. 2.1 panel shows x\\nthe panel shows \\n42\\n' WHEN 1 THEN '\\nPage 12\\n12-13\\nReferences\\nSmith 1999' WHEN 2 THEN '\\nmail me@example.org or https://example.org/a?b=1 now\\nCopyright 2001 by me\\nend' WHEN 3 THEN '  a   b  \\n\\n\\n\\nc  \\n \\n \\nd\\n---\\n' ELSE '\\n7 | running head\\nBibliography\\nx' END)"
_DIRTY_SQL = _DIRTY.replace("\\n", "\n")


def _docs(spark, d):
    return load(spark, d, "documents")


def _dirty(spark, d):
    return _docs(spark, d).withColumn("dirty", F.expr(_DIRTY_SQL))


def _cleaned(f):
    both = lambda c: F.struct(F.md5(c).alias("h"), F.length(c).cast("long").alias("n"))
    return lambda spark, d: _dirty(spark, d).select("doc_id", T.bind(f(F.col("dirty")), both).alias("x")).select("doc_id", "x.h", "x.n")


def _lines_sql(expr: str) -> str:
    return f"SELECT doc_id, md5(c) AS h, length(c)::BIGINT AS n FROM (SELECT doc_id, {expr} AS c FROM (SELECT doc_id, {_DIRTY_SQL} AS dirty FROM documents))"


_FIG = r"regexp_replace(regexp_replace(regexp_replace({x}, '(?i)Fig\.\s+\d+\.\d+', '', 'g'), '(?i)Figure\s+\d+', '', 'g'), '(?i)Fig\.\s+\d+[A-Za-z]?', '', 'g')"
SQL_CLEAN = {
    "clean_figures": _lines_sql(
        "array_to_string(list_filter(string_split(" + _FIG.format(x="dirty") + ", chr(10)), lambda x: NOT (regexp_matches(lower(trim(x)), 'figure |fig\\. |shows |illustrates |demonstrates ') AND regexp_matches(lower(x), 'figure|fig|panel|image|drawing') AND len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) <= 15)), chr(10))"
    ),
    "clean_page_numbers": _lines_sql(
        r"array_to_string(list_filter(list_transform(string_split(dirty, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\s*\d+\s*$') OR regexp_matches(x, '^\d+\s*\|') THEN '' ELSE regexp_replace(x, '(?i)Page\s+\d+', '', 'g') END), lambda x: NOT (length(trim(x)) < 10 AND regexp_matches(regexp_replace(trim(x), '[ -]', '', 'g'), '^\d+$'))), chr(10))"
    ),
    "cut_references": _lines_sql(
        r"coalesce(array_to_string(list_slice(string_split(dirty, chr(10)), 1, nullif(list_position(list_transform(string_split(dirty, chr(10)), lambda x: regexp_matches(trim(x), '(?i)^(References?|Bibliography|Further Reading|Suggested Reading)$')), true), 0) - 1), chr(10)), dirty)"
    ),
    "strip_links": _lines_sql(r"regexp_replace(regexp_replace(dirty, 'https?://[A-Za-z0-9$-_@.&+!*(),%]+', '', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '', 'g')"),
    "strip_copyright": _lines_sql(r"array_to_string(list_transform(string_split(dirty, chr(10)), lambda x: regexp_replace(x, '(©|Copyright).*$', '')), chr(10))"),
    "clean_whitespace": _lines_sql(r"trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(dirty, ' +', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)), '^\s+|\s+$', '', 'g'))"),
}

QUERIES = {
    "clean_figures": _cleaned(T.drop_figures),
    "clean_page_numbers": _cleaned(T.drop_page_numbers),
    "cut_references": _cleaned(T.cut_references),
    "strip_links": _cleaned(T.drop_links),
    "strip_copyright": _cleaned(T.drop_copyright),
    "clean_whitespace": _cleaned(T.squeeze),
    "clean_chain": _cleaned(T.clean),
}
ORACLES = dict(SQL_CLEAN)


def _chained() -> str:
    """The whole chain: each step's expression over the step before it."""
    rules = "array_to_string(list_transform(string_split(dirty, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\\s*[…-]+\\s*$') THEN '' ELSE x END), chr(10))"
    step = lambda name: SQL_CLEAN[name].split("SELECT doc_id, ", 2)[2].rsplit(" AS c FROM (", 1)[0]
    rows = f"SELECT doc_id, {_DIRTY_SQL} AS dirty FROM documents"
    for e in (step("clean_figures"), step("clean_page_numbers"), step("cut_references"), rules, step("strip_links"), step("strip_copyright"), step("clean_whitespace")):
        rows = f"SELECT doc_id, {e} AS dirty FROM ({rows})"
    return rows


ORACLES["clean_chain"] = f"SELECT doc_id, md5(dirty) AS h, length(dirty)::BIGINT AS n FROM ({_chained()})"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("clean_stats", f"SELECT doc_id, length(r.dirty)::BIGINT AS chars, length(c.dirty)::BIGINT AS kept, round(1 - length(c.dirty) / length(r.dirty)::DOUBLE, 9) AS reduction FROM (SELECT doc_id, {_DIRTY_SQL} AS dirty FROM documents) r JOIN ({_chained()}) c USING (doc_id)")
def clean_stats(spark, d):
    n = lambda c: F.length(c).cast("long")
    x = _dirty(spark, d).select("doc_id", F.struct(n("dirty").alias("chars"), n(T.clean(F.col("dirty"))).alias("kept")).alias("x"))
    return x.select("doc_id", "x.chars", "x.kept", F.round(1 - F.col("x.kept") / F.col("x.chars"), 9).alias("reduction"))


@query("normalize_title", r"SELECT page_id, substr(regexp_replace(lower(trim(url)), '\s+', ' ', 'g'), 1, 512) AS title_key, md5(trim(html)) AS content_hash FROM pages")
def normalize_title(spark, d):
    return load(spark, d, "pages").select("page_id", T.title_key(F.col("url")).alias("title_key"), T.content_hash(F.col("html")).alias("content_hash"))


@query("nfc_text", "SELECT doc_id, md5(trim(nfc_normalize(text))) AS h FROM documents")
def nfc_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.nfc(F.col("text"))).alias("h"))


@query("record_normalize", "SELECT source || ':' || doc_id AS id, source, split_part(text, chr(10), 1) AS title, text, '/' || source || '/' || doc_id AS url FROM documents WHERE trim(text) <> ''")
def record_normalize(spark, d):
    x = _docs(spark, d).filter(F.trim("text") != "")
    return x.select(F.concat_ws(":", "source", "doc_id").alias("id"), "source", F.substring_index("text", "\n", 1).alias("title"), "text", F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"))


@query("dedup_exact_text", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(trim(text))")
def dedup_exact_text(spark, d):
    return _docs(spark, d).groupBy(T.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("dedup_title_cap", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY split_part(text, chr(10), 1) ORDER BY doc_id) AS n FROM documents) WHERE n <= 2")
def dedup_title_cap(spark, d):
    return S.first_of(_docs(spark, d), [F.substring_index("text", "\n", 1)], [F.col("doc_id")], 2).select("doc_id")


@query("dedup_title_or_text")
def dedup_title_or_text(spark, d):
    x = _docs(spark, d).select("doc_id", "source", "text")
    return S.dedup_title_or_text(x, F.md5(F.substring_index("text", "\n", 1)), T.content_hash(F.col("text")), "doc_id").select("doc_id", "source")


@query("length_band", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) BETWEEN 500 AND 2000")
def length_band(spark, d):
    return _docs(spark, d).filter(F.length("text").between(500, 2000)).select("doc_id", F.length("text").cast("long").alias("n"))


@query("null_passing_year", "SELECT event_id FROM events WHERE coalesce(try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(year(ts) - event_id % 9 AS VARCHAR) END AS INTEGER) >= 2018, true)")
def null_passing_year(spark, d):
    return load(spark, d, "events").filter("coalesce(try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(year(ts) - event_id % 9 AS STRING) END AS INT) >= 2018, true)").select("event_id")


@query("source_skiplist", "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source")
def source_skiplist(spark, d):
    return _docs(spark, d).filter(~F.col("source").isin("src1", "src2")).groupBy("source").agg(F.count("*").alias("n"))


@query("substring_hits", "SELECT count(*) AS n FROM documents WHERE contains(lower(text), 'that')")
def substring_hits(spark, d):
    return _docs(spark, d).filter(F.lower("text").contains("that")).agg(F.count("*").alias("n"))


# Words are Unicode words on both sides; RE2 has no such boundary, so its match takes the character before the word.
@query("highlight_whole", r"SELECT doc_id, md5(regexp_replace(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])((?:that|with|from)[\p{L}\p{M}\p{N}_]*)', '\1**\2**', 'g')) AS h FROM documents")
def highlight_whole(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.highlight(F.col("text"), "that with from in", "(?U)")).alias("h"))


_PARAS = rf"SELECT doc_id, pos, p AS paragraph FROM (SELECT doc_id, unnest(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n')) AS q, generate_subscripts(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), 1) - 1 AS pos FROM documents), LATERAL (SELECT replace(regexp_replace(q, '^{T.SPACE}+|{T.SPACE}+$', '', 'g'), chr(10), ' ') AS p) WHERE len(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')) >= 3 AND NOT regexp_matches(p, '{C.ONLY_MARKS}')"


def _paras(spark, d):
    return C.paragraphs(_docs(spark, d), "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query("paragraphs", f"SELECT doc_id, pos::BIGINT AS pos, md5(paragraph) AS h FROM ({_PARAS})")
def paragraphs(spark, d):
    return _paras(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("paragraph").alias("h"))


@query("sentence_split", r"SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS h FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", C.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("h"))


_BOOK = "'preface' || chr(10) || chr(10) || 'Chapter 1: One' || chr(10) || text || chr(10) || 'IV. Four' || chr(10) || 'the end'"
_BOOK_LINES = f"SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split({_BOOK}, chr(10)) AS l FROM documents)"


@query("chapters", rf"WITH l AS (SELECT *, regexp_matches(trim(line), '{C.CHAPTER}') AS head FROM ({_BOOK_LINES})), h AS (SELECT doc_id, pos, line, head, sum(head::INTEGER) OVER w AS ordinal, coalesce(last_value(CASE WHEN head THEN trim(line) END IGNORE NULLS) OVER w, 'Introduction') AS heading FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) SELECT doc_id, ordinal::BIGINT AS ordinal, heading, md5(body) AS h FROM (SELECT doc_id, ordinal, heading, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS body FROM h WHERE NOT head GROUP BY doc_id, ordinal, heading) WHERE body <> ''")
def chapters(spark, d):
    x = _docs(spark, d).withColumn("book", F.concat(F.lit("preface\n\nChapter 1: One\n"), F.col("text"), F.lit("\nIV. Four\nthe end")))
    return C.split_at(x, "doc_id", F.col("book"), lambda line: F.trim(line).rlike(C.CHAPTER), F.lit("Introduction")).select("doc_id", "ordinal", "heading", F.md5("body").alias("h"))


@query("sections")
def sections(spark, d):
    x = _docs(spark, d).withColumn("book", F.concat(F.lit("GENERAL MATTERS\n"), F.col("text"), F.lit("\n1.2 Details\nthe end")))
    return C.split_at(x, "doc_id", F.col("book"), C.is_section, F.lit("")).select("doc_id", "ordinal", C.section_level(F.col("heading")).alias("level"), "heading", F.md5("body").alias("h"))


@query("char_windows", "SELECT doc_id, (i // 400)::BIGINT AS pos, md5(substr(text, i + 1, 500)) AS h FROM documents, LATERAL (SELECT unnest(range(0, length(text), 400)) AS i)")
def char_windows(spark, d):
    return C.char_windows(_docs(spark, d), "doc_id", "text", 500, 100).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("chunk").alias("h"))


@query("token_windows", r"SELECT doc_id, i::BIGINT AS pos, md5(array_to_string(t[i * 80 + 1 : i * 80 + 100], ' ')) AS h FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS t FROM documents), LATERAL (SELECT unnest(range(0, greatest(CAST(ceil((len(t) - 100) / 80.0) AS INTEGER), 0) + 1)) AS i) WHERE len(t) > 0")
def token_windows(spark, d):
    return C.token_windows(_docs(spark, d), "doc_id", T.whitespace_tokens(F.col("text")), 100, 20).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("chunk").alias("h"))


def _packed(spark, d):
    units = _paras(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))), lambda x: x["paragraph"]).alias("units"))
    return units.select("doc_id", F.posexplode(C.pack(F.col("units"), 120, 220, 350)).alias("n", "chunk"))


@query("greedy_chunk_pack")
def greedy_chunk_pack(spark, d):
    return _packed(spark, d).select("doc_id", "n", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("chunk_id"), C.token_count(F.col("chunk")).alias("tokens"), F.md5("chunk").alias("h"))


@query("overlap_prev_tail", "SELECT doc_id, pos::BIGINT AS pos, md5(concat_ws(' ', CASE WHEN n > 0 THEN array_to_string(list_slice(w, greatest(len(w) - n + 1, 1), len(w)), ' ') END, p)) AS h FROM (SELECT *, list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '') AS w, (CAST(floor((length(b) // 4) * 0.1) AS BIGINT) * 3) AS n FROM (SELECT doc_id, pos, paragraph AS p, lag(paragraph) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM (" + _PARAS + ")))")
def overlap_prev_tail(spark, d):
    return C.with_overlap(_paras(spark, d), ["doc_id"], "pos", "paragraph", 0.1).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("overlapped").alias("h"))


@query("chunk_stats", f"SELECT count(*) AS chunks, round(avg(t), 6) AS mean_tokens, min(t)::BIGINT AS least, max(t)::BIGINT AS most, count_if(t BETWEEN 5 AND 350)::BIGINT AS in_range FROM (SELECT length(paragraph) // 4 AS t FROM ({_PARAS}))")
def chunk_stats(spark, d):
    t = _paras(spark, d).select(C.token_count(F.col("paragraph")).cast("long").alias("t"))
    return t.agg(F.count("*").alias("chunks"), F.round(F.avg("t"), 6).alias("mean_tokens"), F.min("t").alias("least"), F.max("t").alias("most"), F.count_if(F.col("t").between(5, 350)).alias("in_range"))


_CLASSES = {"first": ("that", "the and", "ation"), "second": ("tion", "ing", "ent"), "third": ("der", "die", "que")}


def _score(words):
    return " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in words)


@query("keyword_classify", "SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS class FROM (SELECT doc_id, " + ", ".join(f"{_score(w)} AS {n}" for n, w in zip("abc", _CLASSES.values(), strict=True)) + " FROM documents)")
def keyword_classify(spark, d):
    return _docs(spark, d).select("doc_id", E.classify(F.col("text"), _CLASSES, "general").alias("class"))


# Documents of every language, and of none.
@query("top_keywords_whole", r"SELECT doc_id, string_agg(w, ',' ORDER BY r) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM (SELECT doc_id, w, count(*) AS n, min(i) AS f FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '([\p{L}\p{N}_]+)', 1) AS ws FROM documents)) WHERE regexp_matches(w, '^[A-Z][a-z]+$') AND length(w) > 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in E.COMMON) + ") GROUP BY doc_id, w)) WHERE r <= 10 GROUP BY doc_id")
def top_keywords_whole(spark, d):
    return E.keywords(_docs(spark, d), "doc_id", F.col("text"))


# Replies are the words of a part: a label, its type's first word in any case, its name on the next line.
_DOMAINS, _ALIASES = ("Standard", "Small", "Economy"), {"promo": "Economy", "medium": "Small"}
_KIND = "CASE lower(split_part(p_type, ' ', 1)) WHEN 'standard' THEN 'Standard' WHEN 'small' THEN 'Small' WHEN 'economy' THEN 'Economy' WHEN 'promo' THEN 'Economy' WHEN 'medium' THEN 'Small' ELSE 'Unknown' END"


@query("alias_canonicalise", f"SELECT p_partkey, {_KIND} AS domain FROM part")
def alias_canonicalise(spark, d):
    raw = F.concat(F.when(F.length("p_name") % 2 == 0, "Subject: ").otherwise("  "), F.substring_index("p_type", " ", 1), F.lit(" \n"), "p_name")
    return load(spark, d, "part").select("p_partkey", E.canonical(raw, list(_DOMAINS), _ALIASES).alias("domain"))


_SYNONYMS = "k(w, x) AS (VALUES ('the', 'that one'), ('the', 'ye'), ('and', 'plus'), ('of the', 'from the one'), ('of the', 'belonging'), ('that', 'this'))"


@query("expand_terms", f"WITH {_SYNONYMS}, b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +'), lambda w: w <> '') AS ws FROM benchmark), g AS (SELECT item_id, unnest(ws) AS w FROM b UNION ALL SELECT item_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT item_id, ws, unnest(range(1, len(ws))) AS i FROM b)), f AS (SELECT item_id, string_agg(x, '|' ORDER BY contains(x, ' ')::INTEGER DESC, length(x), x) AS terms FROM (SELECT DISTINCT item_id, x FROM g JOIN k USING (w)) GROUP BY item_id) SELECT b.item_id, coalesce(terms, '') AS terms FROM b LEFT JOIN f USING (item_id)")
def expand_terms(spark, d):
    table = {"the": ["that one", "ye"], "and": ["plus"], "of the": ["from the one", "belonging"], "that": ["this"]}
    return load(spark, d, "benchmark").select("item_id", F.array_join(E.expand(F.col("text"), table), "|").alias("terms"))


@query("stratified_split", "SELECT doc_id, quality, CASE WHEN p < 0.9 THEN 'train' ELSE 'val' END AS split FROM (SELECT doc_id, quality, percent_rank() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || 's'), doc_id) AS p FROM labels)")
def stratified_split(spark, d):
    return S.stratified_split(load(spark, d, "labels"), "quality", "doc_id", 0.9, "s").select("doc_id", "quality", "split")


@query("balanced_sample", "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), q AS (SELECT source, 95 // (SELECT count(*) FROM s) + (row_number() OVER (ORDER BY n DESC, source) <= 95 % (SELECT count(*) FROM s))::INTEGER AS quota FROM s) SELECT doc_id, d.source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || 'b'), doc_id) AS r FROM documents) d JOIN q ON d.source = q.source WHERE r <= quota")
def balanced_sample(spark, d):
    return S.balanced_sample(_docs(spark, d), "source", "doc_id", 95, "b").select("doc_id", "source")


@query("group_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || 'g'), doc_id) AS n FROM documents) WHERE n <= 25")
def group_sample(spark, d):
    return S.first_of(_docs(spark, d), [F.col("lang")], [S.hash_order("doc_id", "g"), F.col("doc_id")], 25).select("doc_id")


@query("sample_of", "SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || 'n'), doc_id LIMIT 64")
def sample_of(spark, d):
    return S.sample_of(_docs(spark, d), "doc_id", 64, "n").select("doc_id", "source")


@query("few_shot", "SELECT example, shot, rank FROM (SELECT a.item_id AS example, b.item_id AS shot, row_number() OVER (PARTITION BY a.item_id ORDER BY b.item_id)::INTEGER AS rank FROM benchmark a JOIN benchmark b ON a.item_id % 5 = b.item_id % 5 AND a.item_id <> b.item_id AND a.text <> b.text) WHERE rank <= 3")
def few_shot(spark, d):
    b = load(spark, d, "benchmark").withColumn("subject", F.col("item_id") % 5)
    return S.few_shot(b, b, 3, "item_id", "subject", "text")


@query("question_types", "SELECT item_id, CASE WHEN regexp_matches(q, ' except| not |incorrect|false') THEN 'negation' WHEN contains(q, 'diagnosis') THEN 'diagnosis' WHEN regexp_matches(q, 'mechanism|pathophysiology|pathway') THEN 'mechanism' WHEN regexp_matches(q, 'drug|treatment|therapy') THEN 'treatment' WHEN regexp_matches(q, 'side effect|adverse') THEN 'adverse_effect' ELSE 'other' END AS type FROM (SELECT item_id, lower(text || CASE item_id % 6 WHEN 0 THEN ' EXCEPT one' WHEN 1 THEN ' most likely diagnosis' WHEN 2 THEN ' mechanism' WHEN 3 THEN ' therapy' WHEN 4 THEN ' adverse' ELSE '' END) AS q FROM benchmark)")
def question_types(spark, d):
    q = F.expr("concat(text, CASE item_id % 6 WHEN 0 THEN ' EXCEPT one' WHEN 1 THEN ' most likely diagnosis' WHEN 2 THEN ' mechanism' WHEN 3 THEN ' therapy' WHEN 4 THEN ' adverse' ELSE '' END)")
    return load(spark, d, "benchmark").select("item_id", A.question_type(q).alias("type"))


_REPLY = "CASE conv_id % 5 WHEN 0 THEN concat('I think. Answer: ', chr(CAST(65 + turn % 5 AS INT))) WHEN 1 THEN concat('well', chr(10), chr(CAST(97 + turn % 5 AS INT))) WHEN 2 THEN concat('It is ', chr(CAST(65 + turn % 5 AS INT)), ' or so') WHEN 3 THEN '<Reasoning>because</Reasoning> answer : b' ELSE 'nothing here' END"


@query("answer_letters", r"SELECT conv_id, turn, coalesce(upper(nullif(regexp_extract(r, '(?i)Answer\s*[:：]\s*([A-E])', 1), '')), CASE WHEN regexp_matches(trim(string_split(trim(r), chr(10))[-1]), '^[A-Ea-e]$') THEN upper(trim(string_split(trim(r), chr(10))[-1])) END, nullif(regexp_extract(r, '\b([A-E])\b', 1), '')) AS letter, trim(regexp_extract(r, '(?is)<Reasoning>(.*?)</Reasoning>', 1)) AS reasoning FROM (SELECT conv_id, turn, " + _REPLY + " AS r FROM conversations)")
def answer_letters(spark, d):
    x = load(spark, d, "conversations").select("conv_id", "turn", F.expr(_REPLY).alias("r"))
    return x.select("conv_id", "turn", A.answer_letter(F.col("r")).alias("letter"), A.reasoning(F.col("r")).alias("reasoning"))


_REASONED = r"coalesce(nullif(upper(regexp_extract(array_to_string(list_reverse(string_split(trim(r), chr(10)))[1:5], chr(10)), '(?i)Answer\s*[:：]\s*([A-E])', 1)), ''), nullif(upper(regexp_extract(trim(r), '(?i)Answer\s*[:：]\s*([A-E])', 1)), ''), CASE WHEN regexp_matches(trim(r)[1], '^[A-Ea-e]$') THEN upper(trim(r)[1]) END, regexp_extract_all(trim(r), '\b([A-E])\b', 1)[-1], nullif(upper(regexp_extract(trim(r), '(?i)\b([A-E])[)\.]', 1)), ''))"


@query("reasoned_letters", f"SELECT conv_id, turn, {_REASONED} AS letter FROM (SELECT conv_id, turn, {_REPLY} AS r FROM conversations)")
def reasoned_letters(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", A.reasoned_letter(F.expr(_REPLY)).alias("letter"))


@query("gold_letters", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN substr('ABCDE', (turn % 5)::INTEGER + 1, 1) WHEN turn % 6 BETWEEN 1 AND 4 THEN substr('ABCD', (turn % 6)::INTEGER, 1) END AS gold FROM conversations")
def gold_letters(spark, d):
    named = F.expr("CASE WHEN role = 'user' THEN substr('abcde', CAST(turn % 5 AS INT) + 1, 1) WHEN role = 'system' THEN 'AB' END")
    return load(spark, d, "conversations").select("conv_id", "turn", A.gold_letter(named, (F.col("turn") % 6).cast("int")).alias("gold"))


@query("fallback_query", r"SELECT item_id, CASE WHEN len(w) > 0 THEN lower(array_to_string(w[1:10], ' ')) ELSE substr(text, 1, 120) END AS q FROM (SELECT item_id, text, list_filter(regexp_extract_all(text, '([a-zA-Z]+)', 1), lambda x: length(x) > 4) AS w FROM benchmark)")
def fallback_query(spark, d):
    return load(spark, d, "benchmark").select("item_id", A.fallback_query(F.col("text")).alias("q"))


@query("valid_queries", r"SELECT item_id, n, (len(t) BETWEEN 5 AND 14 AND len(list_filter(t, lambda x: length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) > 4)) > 0 AND NOT contains(lower(q), 'answer')) AS valid FROM (SELECT item_id, n, q, list_filter(regexp_split_to_array(trim(q), '\s+'), lambda x: x <> '') AS t FROM (SELECT item_id, n, substr(text, 1, n::INTEGER) AS q FROM benchmark, (SELECT unnest([10, 40, 70, 150]) AS n)))")
def valid_queries(spark, d):
    x = load(spark, d, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, (10, 40, 70, 150)))).alias("n"))
    return x.select("item_id", "n", A.valid_query(F.col("text").substr(F.lit(1), F.col("n")), ("answer",)).alias("valid"))


@query("prompts", "SELECT item_id, md5('Choose exactly one option.' || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Options:' || chr(10) || 'A) yes' || chr(10) || 'B) no' || chr(10) || chr(10) || 'Answer: ') AS h FROM benchmark")
def prompts(spark, d):
    options = F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.lit("yes"))
    return load(spark, d, "benchmark").select("item_id", F.md5(A.option_prompt(F.col("text"), options)).alias("h"))


@query("json_props", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type")
def json_props(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))


@query("union_sources", "SELECT kind, count(*) AS n FROM (SELECT 'doc' AS kind FROM documents UNION ALL SELECT 'page' FROM pages) GROUP BY kind")
def union_sources(spark, d):
    from ..sources.files import union_all

    return union_all(_docs(spark, d).select(F.lit("doc").alias("kind"), "text"), load(spark, d, "pages").select(F.lit("page").alias("kind"), "url")).groupBy("kind").agg(F.count("*").alias("n"))


@query("intersect_sets", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersect_sets(spark, d):
    return _docs(spark, d).select("doc_id").intersect(load(spark, d, "labels").select("doc_id"))


@query("except_sets", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_sets(spark, d):
    return _docs(spark, d).select("doc_id").exceptAll(load(spark, d, "labels").select("doc_id")).distinct()


@query("manifest", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def manifest(spark, d):
    from ..sources.files import manifest as make

    x = make(_docs(spark, d), "source").select(F.from_json("manifest", "counts map<string,bigint>").alias("m"))
    return x.select(F.explode("m.counts").alias("source", "n"))
