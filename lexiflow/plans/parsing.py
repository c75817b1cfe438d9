"""Queries of parsing, sanitising, metadata and paired evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import expansion_words as W
from ..functions import parse as P
from ..functions import text as T
from ..operators import analytics as N
from ..operators import chunking as C
from ..operators import enrich as E
from ..operators import fusion as U
from ..operators import phrases as H
from . import retrieve as R
from .corpus import _PARAS, _paras
from .tables import built, load

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> '')"
_LETTER = "chr(CAST(65 + turn % 4 AS INT))"
# Replies in many wordings, the same text on both sides.
_REPLY = f"""CASE conv_id % 10
WHEN 0 THEN concat('So the correct answer is ', {_LETTER}, ') here')
WHEN 1 THEN concat('Answer: b', chr(10), 'no, I choose ', {_LETTER}, ' now')
WHEN 2 THEN concat({_LETTER}, ' is the best', chr(10), 'option')
WHEN 3 THEN concat('it should be ', {_LETTER})
WHEN 4 THEN concat('either A or ', {_LETTER}, '.')
WHEN 5 THEN concat('<Reasoning>first, then ', {_LETTER}, '</Reasoning>', chr(10), 'Answer: ', {_LETTER})
WHEN 6 THEN concat('old <Reasoning> it goes on, Answer: ', {_LETTER}, ' and so')
WHEN 7 THEN concat('### Response: because of it. answer : ', {_LETTER})
WHEN 8 THEN concat('<think>', chr(10), 'step ', {_LETTER}, chr(10), ' and more', chr(10), '</think>', chr(10), 'The correct answer is ', {_LETTER}, ') so')
ELSE 'nothing of use' END"""
_R = f"(SELECT conv_id, turn, {_REPLY} AS r FROM conversations)"


def _replies(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.expr(_REPLY).alias("r"))


_AGENT = ", ".join("regexp_extract_all(trim(r), '(?im){}', 1)[-1]".format(p.replace(r"(?=\s*(?:\.|$))", r"\s*(?:\.|$)")) for p in P.AGENT_ANSWERS)


@query("agent_answers", f"SELECT conv_id, turn, upper(coalesce({_AGENT})) AS letter FROM {_R}")
def agent_answers(spark, d):
    return _replies(spark, d).select("conv_id", "turn", P.agent_answer(F.col("r")).alias("letter"))


_CUT = r"trim(regexp_replace(string_split(r, '{}')[-1], '(?is)\bAnswer\s*[:：].*$', ''))"


@query("tuned_answers", r"SELECT conv_id, turn, coalesce(upper(regexp_extract_all(r, '(?i)\bAnswer\s*[:：]\s*([ABCD])\b', 1)[-1]), nullif(upper(regexp_extract(right(r, 400), '\b([ABCD])\b', 1)), '')) AS letter, CASE WHEN regexp_matches(r, '(?is)<Reasoning>.*?</Reasoning>') THEN trim(regexp_extract(r, '(?is)<Reasoning>(.*?)</Reasoning>', 1)) WHEN contains(r, '<Reasoning>') THEN " + _CUT.format("<Reasoning>") + " WHEN contains(r, '### Response:') THEN " + _CUT.format("### Response:") + f" END AS reasoning FROM {_R}")
def tuned_answers(spark, d):
    return _replies(spark, d).select("conv_id", "turn", P.tuned_answer(F.col("r")).alias("letter"), P.tuned_reasoning(F.col("r")).alias("reasoning"))


@query("lenient_answers", r"SELECT conv_id, turn, coalesce(CASE WHEN regexp_matches(upper(n), '^[ABCD]$') THEN upper(n) END, nullif(upper(regexp_extract(r, '(?i)([ABCD])', 1)), '')) AS letter FROM (SELECT *, regexp_extract(r, '(?i)\banswer\s*[:：]?\s*([A-Z])\b', 1) AS n FROM " + _R + ")")
def lenient_answers(spark, d):
    return _replies(spark, d).select("conv_id", "turn", P.lenient_answer(F.col("r")).alias("letter"))


@query("think_blocks", r"SELECT conv_id, turn, trim(regexp_extract(r, '(?s)<think>\n(.*?)\n</think>', 1)) AS thinking, nullif(regexp_extract(r, '\nThe correct answer is ([^) ]+)\)', 1), '') AS answer FROM " + _R)
def think_blocks(spark, d):
    return _replies(spark, d).select("conv_id", "turn", P.think(F.col("r")).alias("t")).select("conv_id", "turn", "t.thinking", "t.answer")


@query("reasoned_letters_all", r"SELECT conv_id, turn, coalesce(nullif(upper(regexp_extract(array_to_string(list_reverse(list_reverse(string_split(trim(r), chr(10)))[1:5]), chr(10)), '(?i)Answer\s*[:：]\s*([A-E])', 1)), ''), nullif(upper(regexp_extract(trim(r), '(?i)Answer\s*[:：]\s*([A-E])', 1)), ''), CASE WHEN regexp_matches(trim(r)[1], '^[A-Ea-e]$') THEN upper(trim(r)[1]) END, regexp_extract_all(trim(r), '\b([A-E])\b', 1)[-1], nullif(upper(regexp_extract(trim(r), '(?i)\b([A-E])[)\.]', 1)), '')) AS letter FROM " + _R)
def reasoned_letters_all(spark, d):
    return _replies(spark, d).select("conv_id", "turn", A.reasoned_letter(F.col("r")).alias("letter"))


_JSON = """CASE item_id % 4
WHEN 0 THEN concat('Here: ```json', chr(10), '{"specific_query": "s', item_id, '", "broad_query": "wide", "key_concepts": ["x", "y"]}', chr(10), '``` done')
WHEN 1 THEN concat('{"specific_query": "only", "mechanism_query": "m', item_id, '"}')
WHEN 2 THEN concat('no JSON ``` for item ', item_id)
ELSE '{"broken": ' END"""


@query(
    "rewritten_queries",
    f"""WITH b AS (SELECT item_id, regexp_replace(CASE WHEN regexp_extract(t, '(?s)```json\\s*(.*?)\\s*```', 1) <> '' THEN regexp_extract(t, '(?s)```json\\s*(.*?)\\s*```', 1) ELSE t END, '```\\s*', '', 'g') AS j FROM (SELECT item_id, {_JSON} AS t FROM benchmark)),
p AS (SELECT item_id, j, json_valid(j) AS ok, CASE WHEN json_valid(j) THEN j ELSE '{{}}' END AS o FROM b),
q AS (SELECT item_id, NOT ok AS parse_error, CASE WHEN ok THEN coalesce(json_extract_string(o, '$.specific_query'), '') ELSE substr(j, 1, 500) END AS specific, coalesce(json_extract_string(o, '$.broad_query'), '') AS broad, coalesce(json_extract_string(o, '$.mechanism_query'), '') AS mechanism, coalesce(array_to_string(json_extract_string(o, '$.key_concepts[*]'), ' '), '') AS concepts FROM p)
SELECT item_id, parse_error, specific, broad, array_to_string(list_filter([specific, broad, mechanism], lambda x: x <> ''), ' ') AS combined, concepts FROM q""",
)
def rewritten_queries(spark, d):
    x = load(spark, d, "benchmark").select("item_id", P.rewritten(F.expr(_JSON)).alias("q"))
    q = F.col("q")
    return x.select("item_id", "q.parse_error", P.retrieval_query(q).alias("specific"), P.retrieval_query(q, "broad").alias("broad"), P.retrieval_query(q, "combined").alias("combined"), P.retrieval_query(q, "concepts").alias("concepts"))


@query(
    "canonical_options",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'dict' WHEN 1 THEN 'flat' ELSE 'none' END AS layout, CASE p_partkey % 3 WHEN 0 THEN 'A=' || trim(p_brand) || ';C=' || p_type WHEN 1 THEN 'A=' || p_name || ';B=;C=' || p_brand || ';D=' ELSE '' END AS listed FROM part",
)
def canonical_options(spark, d):
    named = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("c"), F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit("a"), F.col("p_brand"), F.lit("z"), F.lit("x"), F.lit("B"), F.lit("")))
    flat = [F.when(F.col("p_partkey") % 3 == 1, c) for c in (F.col("p_name"), F.lit(None).cast("string"), F.concat("p_brand", F.lit("  ")), F.lit(None).cast("string"))]
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(P.options(named, tuple(flat)))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    kind = P.dialect(named, flat[0])
    return load(spark, d, "part").select("p_partkey", F.when(kind == "mcq_dict", "dict").when(kind == "mcq_flat", "flat").otherwise("none").alias("layout"), listed.alias("listed"))


@query("best_letters", "SELECT vec_id, substr('ABCD', list_position(l, list_max(l))::BIGINT, 1) AS letter FROM (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE + 0.05, embedding[3]::DOUBLE, embedding[4]::DOUBLE] AS l FROM embeddings)")
def best_letters(spark, d):
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    return load(spark, d, "embeddings").select("vec_id", P.best_letter(logits, {"B": 0.05}).alias("letter"))


_TERMS = "concat(text, ' a bb true/false-ish except that  ccc')"


@query("sanitized_expansions", rf"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({_TERMS}, ' '), lambda x: trim(x)), lambda x: length(x) BETWEEN 3 AND 50 AND NOT regexp_matches(lower(x), '{'|'.join(P.BANNED)}')))), '|') AS terms FROM benchmark")
def sanitized_expansions(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(P.sanitize_expansions(F.split(F.expr(_TERMS), " "))), "|").alias("terms"))


@query("sanitized_terms", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split(text, ','), lambda x: x <> '' AND length(x) <= 120))), '|') AS terms FROM benchmark")
def sanitized_terms(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(P.sanitize_terms(F.split("text", ","))), "|").alias("terms"))


# Contexts are the ten best hits of each question among all documents.
_MET = f"WITH {R._bm25_sql()}, {R._TOP}, met AS (SELECT b.item_id, d.doc_id, b.text AS q, d.text AS c FROM top JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))"


def _met(spark, d):
    hits = R._best(spark, d).select("item_id", "doc_id")
    docs = load(spark, d, "documents").select("doc_id", F.col("text").alias("c"))
    return docs.join(hits, "doc_id").join(load(spark, d, "benchmark").select("item_id", F.col("text").alias("q")), "item_id")


def _share(least):
    q = f"list_distinct(list_filter({_TOKENS.format('q')}, lambda w: length(w) > {least}))"
    return f"CASE WHEN len({q}) = 0 THEN 0.0 ELSE len(list_intersect({q}, {_TOKENS.format('c')})) / len({q})::DOUBLE END"


@query("relevant_contexts", f"{_MET} SELECT item_id, doc_id, round({_share(3)}, 9) AS relevance, round({_share(3)}, 9) >= 0.3 AS kept FROM met")
def relevant_contexts(spark, d):
    value = F.round(P.relevance(F.col("q"), F.col("c")), 9)
    return _met(spark, d).select("item_id", "doc_id", value.alias("relevance"), (value >= 0.3).alias("kept"))


_BONUS = " + ".join(f"contains(lower(c), '{w}')::INTEGER" for w in P.CONTEXT_WORDS)


@query("best_contexts", f"{_MET} SELECT item_id, doc_id, score FROM (SELECT item_id, doc_id, round({_share(0)} + ({_BONUS}) * 0.1 - greatest(0.0, (length(c) - 500) / 1000.0) * 0.2, 9) AS score FROM met) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 3")
def best_contexts(spark, d):
    from ..operators.retrieval import top_k

    scored = _met(spark, d).select("item_id", "doc_id", F.round(P.context_score(F.col("q"), F.col("c")), 9).alias("score"))
    return top_k(scored, ["item_id"], [F.desc("score"), F.asc("doc_id")], 3).select("item_id", "doc_id", "score")


_ABBR = "concat(p_name, '  ECG and ct of ', p_brand, ', bp', chr(10), 'ctx MI')"


def _written(x):
    for short, long in P.ABBREVIATIONS.items():
        x = rf"regexp_replace({x}, '\b{short}\b', '{long}', 'g')"
    return x


@query("written_out", f"SELECT p_partkey, {_written(rf'''trim(regexp_replace(lower({_ABBR}), '\s+', ' ', 'g'))''')} AS t FROM part")
def written_out(spark, d):
    return load(spark, d, "part").select("p_partkey", P.written_out(F.expr(_ABBR)).alias("t"))


@query("text_fields", rf"SELECT c_custkey, trim(regexp_replace(concat_ws(chr(10), c_name, CASE c_custkey % 3 WHEN 1 THEN chr(10) || '  a   b' WHEN 2 THEN '  ' END, c_mktsegment), '{T.SPACE}+', ' ', 'g')) AS t FROM customer")
def text_fields(spark, d):
    middle = F.expr("CASE WHEN c_custkey % 3 = 1 THEN '\n  a   b' WHEN c_custkey % 3 = 2 THEN '  ' END")
    return load(spark, d, "customer").select("c_custkey", P.text_fields(F.col("c_name"), middle, F.col("c_mktsegment")).alias("t"))


@query("clean_paragraphs", r"SELECT doc_id, pos::BIGINT AS pos, CASE WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) < 3 THEN '' ELSE md5(t) END AS h FROM (SELECT doc_id, pos, regexp_replace(paragraph, '^\S+ \S+ \S+', '') AS t FROM (" + _PARAS + "))")
def clean_paragraphs(spark, d):
    t = P.clean_paragraph(F.regexp_replace("paragraph", r"^\S+ \S+ \S+", ""))
    return _paras(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), F.when(t == "", "").otherwise(F.md5(t)).alias("h"))


@query("least_tokens", f"SELECT doc_id, count(*) AS n FROM ({_PARAS}) WHERE length(paragraph) // 4 >= 40 GROUP BY doc_id")
def least_tokens(spark, d):
    return _paras(spark, d).filter(C.token_count(F.col("paragraph")) >= 40).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("chunk_issues", f"SELECT id, CASE WHEN t > 120 THEN 'over' ELSE 'under' END AS issue FROM (SELECT doc_id * 100000 + pos AS id, length(paragraph) // 4 AS t FROM ({_PARAS})) WHERE t > 120 OR t < 8 ORDER BY id LIMIT 10")
def chunk_issues(spark, d):
    x = _paras(spark, d).select((F.col("doc_id") * 100000 + F.col("pos")).alias("id"), C.token_count(F.col("paragraph")).alias("t"))
    return C.chunk_issues(x, "id", "t", 8, 120)


@query("passage_ids", "SELECT doc_id, CASE WHEN i = 0 THEN doc_id::VARCHAR ELSE doc_id || '#' || (i // 400) END AS passage_id FROM documents, LATERAL (SELECT unnest(range(0, length(text), 400)) AS i)")
def passage_ids(spark, d):
    x = C.char_windows(load(spark, d, "documents"), "doc_id", "text", 500, 100)
    return x.select("doc_id", C.passage_ids(F.col("doc_id"), F.col("pos")).alias("passage_id"))


@query("sentence_windows")
def sentence_windows(spark, d):
    x = load(spark, d, "documents").select("doc_id", F.posexplode(C.sentence_windows(F.col("text"))).alias("pos", "chunk"))
    return x.select(C.passage_ids(F.col("doc_id"), F.col("pos")).alias("passage_id"), "doc_id", F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("h"))


@query("book_sections")
def book_sections(spark, d):
    book = F.concat(F.lit("preface\n\nChapter 1: One\nGENERAL MATTERS\n"), F.col("text"), F.lit("\nIV. Four\nopening\n1.2 Details\nthe end"))
    return C.book_sections(load(spark, d, "documents").select("doc_id", "text"), "doc_id", book).select("doc_id", "n", "chapter", "section", F.md5("body").alias("h"))


def _class_sql(classes, default):
    score = {c: "(" + " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in ws) + ")" for c, ws in classes.items()}
    best = f"greatest({', '.join(score.values())})"
    return f"CASE WHEN {best} = 0 THEN {default} " + " ".join(f"WHEN {s} = {best} THEN '{c}'" for c, s in score.items()) + " END"


# The corpus has no medical words; some are put in on both sides, by the document's number.
_TOLD = "concat(text, CASE doc_id % 7 WHEN 0 THEN ' nerve supply of the heart' WHEN 1 THEN ' renal function and metabolism' WHEN 2 THEN ' a benign tumor of the bone' WHEN 3 THEN ' drug dose for anemia' WHEN 4 THEN ' a clinical sign, CNS or lung' ELSE '' END)"
_DOCS = f"(SELECT doc_id, source, lang, {_TOLD} AS text FROM documents)"


def _told(spark, d):
    return load(spark, d, "documents").withColumn("text", F.expr(_TOLD))


_KIND, _SYSTEM = _class_sql(E.CONTENT_TYPES, "'general'"), _class_sql(E.SYSTEMS, "NULL")


@query("body_systems", f"SELECT doc_id, {_SYSTEM} AS system FROM {_DOCS}")
def body_systems(spark, d):
    return _told(spark, d).select("doc_id", E.classify(F.col("text"), E.SYSTEMS, None).alias("system"))


@query("chunk_metadata", f"SELECT doc_id, {_KIND} AS content_type, {_SYSTEM} AS system, source AS textbook, lang AS section FROM {_DOCS}")
def chunk_metadata(spark, d):
    x = E.with_metadata(_told(spark, d), "text", textbook=F.col("source"), section=F.col("lang"))
    return x.select("doc_id", "metadata.*")


@query("metadata_report", f"WITH m AS (SELECT {_KIND} AS k, {_SYSTEM} AS s, source, lang FROM {_DOCS}) SELECT field, value, count(*) AS n FROM (SELECT 'content_type' AS field, k AS value FROM m UNION ALL SELECT 'system', coalesce(s, 'none') FROM m UNION ALL SELECT 'complete', (k IS NOT NULL AND s IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL)::VARCHAR FROM m) GROUP BY field, value")
def metadata_report(spark, d):
    return E.metadata_report(E.with_metadata(_told(spark, d), "text", textbook=F.col("source"), section=F.col("lang")))


_LAST = "split_part(p_type, ' ', 3)"
_DOMAIN = "CASE lower({}) WHEN 'brass' THEN 'brass' WHEN 'steel' THEN 'brass' WHEN 'nickel' THEN 'nickel' ELSE lower({}) END"


@query("domain_equality", f"SELECT p_partkey, {_DOMAIN.format(_LAST, _LAST)} = CASE WHEN length(p_name) % 2 = 0 THEN 'brass' ELSE 'nickel' END AS same FROM part")
def domain_equality(spark, d):
    """Whether the last word of a part's type, an alias told, is the domain that its name's length says."""
    said = F.concat(F.lit("Subject: "), F.substring_index("p_type", " ", -1))
    bare = F.substring_index("p_type", " ", -1)
    true = F.when(F.length("p_name") % 2 == 0, "Steel").otherwise("NICKEL ")
    return load(spark, d, "part").select("p_partkey", E.same_domain(F.when(bare.isin("BRASS", "STEEL", "NICKEL"), said).otherwise(bare), true, ["Brass", "Nickel"], {"steel": "Brass"}).alias("same"))


@query("index_names", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'idx_s' WHEN contains(lower(p_type), 'brass') THEN 'idx_b' ELSE 'idx' END AS name FROM part")
def index_names(spark, d):
    return load(spark, d, "part").select("p_partkey", P.index_name(F.col("p_type"), {"steel": "idx_s", "brass": "idx_b"}, "idx").alias("name"))


# Some questions get a negation, on both sides, by their number.
_NEGATED = "concat(text, CASE item_id % 6 WHEN 0 THEN ' EXCEPT this' WHEN 1 THEN ' is NOT so' WHEN 2 THEN ' is not so' WHEN 3 THEN ' the LEAST of' WHEN 4 THEN ' INCORRECT one' ELSE '' END)"


@query("negation_flags", f"SELECT item_id, (contains(q, ' EXCEPT') OR contains(q, ' Except') OR contains(q, ' NOT ') OR contains(q, ' FALSE ') OR contains(q, ' LEAST ') OR contains(q, ' INCORRECT ')) AS negated FROM (SELECT item_id, ' ' || {_NEGATED} AS q FROM benchmark)")
def negation_flags(spark, d):
    return load(spark, d, "benchmark").select("item_id", A.is_negated(F.expr(_NEGATED)).alias("negated"))


_RUNS = "SELECT doc_id AS row_id, CASE WHEN doc_id % 13 <> 0 THEN 'e' || doc_id END AS example_id, CASE quality WHEN 1 THEN 'A' ELSE 'B' END AS gold, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'A' ELSE 'B' END AS pred, CASE WHEN doc_id % 7 = 0 THEN toxic = 1 END AS told, doc_id % 4 AS domain, toxic FROM labels"


def _runs(spark, d):
    return spark.sql(_RUNS.replace("FROM labels", "FROM {labels}"), labels=load(spark, d, "labels"))


_PRED = f"(SELECT row_id, coalesce(nullif(trim(example_id), ''), 'row_' || row_id) AS example_id, gold, pred, coalesce(told, gold = pred, false) AS is_correct, domain, toxic FROM ({_RUNS}))"


def _predictions(spark, d):
    from ..sources.predictions import normalised

    return normalised(_runs(spark, d), "told")


@query("prediction_rows", f"SELECT row_id, example_id, gold, pred, is_correct FROM {_PRED}")
def prediction_rows(spark, d):
    return _predictions(spark, d).select("row_id", "example_id", "gold", "pred", "is_correct")


@query("scored_answers", f"SELECT row_id, CASE WHEN pred IS NOT NULL AND gold IS NOT NULL THEN (pred = gold)::VARCHAR END AS correct FROM ({_RUNS})")
def scored_answers(spark, d):
    return _runs(spark, d).select("row_id", A.correctness(F.col("pred"), F.col("gold")).cast("string").alias("correct"))


_PAIR = f"(SELECT a.row_id, a.is_correct AS a, b.toxic = 0 AS b FROM {_PRED} a JOIN {_PRED} b USING (row_id))"


def _paired(spark, d):
    p = _predictions(spark, d)
    return N.paired(p, p.withColumn("is_correct", F.col("toxic") == 0))


@query("paired_correctness", f"SELECT row_id, a, b FROM {_PAIR}")
def paired_correctness(spark, d):
    return _paired(spark, d)


@query("pairwise_row", f"WITH c AS (SELECT count(*) AS n, avg(a::INTEGER) AS x, avg(b::INTEGER) AS y, count_if(NOT a AND b)::BIGINT AS n01, count_if(a AND NOT b)::BIGINT AS n10 FROM {_PAIR}) SELECT n, round(x, 6) AS first, round(y, 6) AS second, round(y - x, 6) AS delta, round(100 * (y - x) / x, 4) AS relative, n01, n10, round(least(1, 2 * (SELECT sum(exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2))) FROM range(0, least(n01, n10) + 1) t(i))), 6) AS p FROM c")
def pairwise_row(spark, d):
    x = N.pairwise(_paired(spark, d))
    return x.select("n", *[F.round(c, 6).alias(c) for c in ("first", "second", "delta")], F.round("relative", 4).alias("relative"), "n01", "n10", F.round("p", 6).alias("p"))


@query("error_details", f"SELECT row_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'lost' WHEN b THEN 'won' ELSE 'neither' END AS transition FROM {_PAIR}")
def error_details(spark, d):
    return N.transitions(_paired(spark, d)).select("row_id", "transition")


@query("context_split_accuracy", f"SELECT round(coalesce(avg(CASE WHEN toxic = 1 THEN is_correct::INTEGER END), 0), 6) AS with_context, round(coalesce(avg(CASE WHEN toxic = 0 THEN is_correct::INTEGER END), 0), 6) AS without_context, count_if(toxic = 1)::BIGINT AS n_with FROM {_PRED}")
def context_split_accuracy(spark, d):
    p = N.split_accuracy(_predictions(spark, d), F.col("toxic") == 1, F.col("is_correct"))
    return p.select(F.round("with_context", 6).alias("with_context"), F.round("without_context", 6).alias("without_context"), "n_with")


_MODELS = f"(SELECT row_id % 3 AS model, domain, is_correct FROM {_PRED})"


def _models(spark, d):
    return _predictions(spark, d).withColumn("model", F.col("row_id") % 3)


@query("domain_detail", f"SELECT model, domain, count(*) AS n, round(avg(is_correct::INTEGER), 6) AS accuracy FROM {_MODELS} GROUP BY model, domain")
def domain_detail(spark, d):
    return N.by_model(_models(spark, d), "domain").select("model", "domain", "n", F.round("accuracy", 6).alias("accuracy"))


@query("domain_accuracy", f"SELECT domain, round(avg(a), 6) AS mean, round(max(a), 6) AS best, round(min(a), 6) AS worst, round(stddev_pop(a), 6) AS std, count(*) AS models FROM (SELECT model, domain, avg(is_correct::INTEGER) AS a FROM {_MODELS} GROUP BY model, domain) GROUP BY domain")
def domain_accuracy(spark, d):
    x = N.over_models(N.by_model(_models(spark, d), "domain"), "domain")
    return x.select("domain", *[F.round(c, 6).alias(c) for c in ("mean", "best", "worst", "std")], "models")


_FACTORS = "r AS (SELECT l_returnflag AS f, l_linestatus AS s, l_suppkey % 7 AS g, l_linenumber AS v, max(round(l_extendedprice, 2)) AS a, count(*) AS total FROM lineitem GROUP BY ALL)"


def _factors(spark, d):
    x = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), (F.col("l_suppkey") % 7).alias("g"), F.col("l_linenumber").alias("v"), F.round("l_extendedprice", 2).alias("a"))
    return x.groupBy("f", "s", "g", "v").agg(F.max("a").alias("a"), F.count("*").alias("total"))


@query("pair_details", f"WITH {_FACTORS}, w AS (SELECT f, g, v, max(a) FILTER (s = 'F') AS x, max(a) FILTER (s = 'O') AS y FROM r GROUP BY f, g, v) SELECT row_number() OVER (ORDER BY f, g, v) AS pair_id, f, g, v, round(x - y, 2) AS delta FROM w WHERE x IS NOT NULL AND y IS NOT NULL")
def pair_details(spark, d):
    x = N.pair_details(_factors(spark, d), "s", "F", "O", ["f", "g", "v"], "a")
    return x.select(F.col("pair_id").cast("long").alias("pair_id"), "f", "g", "v", F.round("delta", 2).alias("delta"))


@query("complete_groups", f"WITH {_FACTORS} SELECT f, s, sum(total)::BIGINT AS n FROM r GROUP BY f, s HAVING count(*) = 49")
def complete_groups(spark, d):
    return _factors(spark, d).groupBy("f", "s").agg(F.sum("total").alias("n"), F.count("*").alias("settings")).filter("settings = 49").select("f", "s", "n")


_KEYS = {"best": "true", "first": "v = 1", "flagged": "f = 'R'", "open": "s = 'O'", "large": "total > 20", "odd": "g % 2 = 1"}


@query("key_methods", f"WITH {_FACTORS} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS method, f, s, g, v, a FROM r WHERE {w} ORDER BY a DESC, f, s, g, v LIMIT 1)" for n, w in _KEYS.items()))
def key_methods(spark, d):
    return N.key_rows(_factors(spark, d), _KEYS, "a", ["f", "s", "g", "v"]).select("method", "f", "s", "g", "v", "a")


@query("token_statistics", "SELECT field, count(*) AS n, round(avg(t), 4) AS mean, max(t)::BIGINT AS most, count_if(t > 300)::BIGINT AS over FROM (SELECT 'text' AS field, length(text) // 4 AS t FROM documents UNION ALL SELECT 'source', length(source) // 4 FROM documents) GROUP BY field")
def token_statistics(spark, d):
    x = N.token_statistics(load(spark, d, "documents"), {"text": C.token_count(F.col("text")), "source": C.token_count(F.col("source"))}, 300)
    return x.select("field", "n", F.round("mean", 4).alias("mean"), "most", "over")


@query("approval_rates", f"SELECT domain, count(*) AS n, round(avg((pred = 'A')::INTEGER) FILTER (pred IS NOT NULL), 6) AS approved, count_if(pred IS NULL)::BIGINT AS errors FROM ({_RUNS}) GROUP BY domain")
def approval_rates(spark, d):
    x = N.approval(_runs(spark, d), "domain", F.col("pred") == "A")
    return x.select("domain", "n", F.round("approved", 6).alias("approved"), "errors")


@query("first_of_role", "SELECT conv_id, role, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def first_of_role(spark, d):
    return U.first_seen(load(spark, d, "conversations"), ["conv_id", "role"], [F.asc("turn")]).select("conv_id", "role", "turn")


@query("first_matching_row", "SELECT page_id, coalesce(m.doc_id, -1) AS doc_id FROM pages p LEFT JOIN (SELECT doc_id % 97 AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1) m ON p.page_id % 100 = m.k")
def first_matching_row(spark, d):
    rows = load(spark, d, "documents").withColumn("k", F.col("doc_id") % 97)
    return U.first_match(load(spark, d, "pages").withColumn("k", F.col("page_id") % 100), rows, "k", "doc_id").select("page_id", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))


@query("reasoning_filter", f"SELECT conv_id, turn FROM {_R} WHERE NOT coalesce(conv_id % 4 = 1 AND turn = 0, false) AND trim(r) <> '' AND NOT contains(lower(r), 'nothing') AND length(r) // 4 <= 8")
def reasoning_filter(spark, d):
    wrong = (F.col("conv_id") % 4 == 1) & (F.col("turn") == 0)
    return N.sound_reasoning(_replies(spark, d).withColumn("is_correct", ~wrong), "r", C.token_count(F.col("r")), 8, "nothing").select("conv_id", "turn")


@query("content_types", f"SELECT {_KIND} AS content_type, count(*) AS n FROM (SELECT coalesce(text, '') AS text FROM documents) GROUP BY content_type")
def content_types(spark, d):
    return load(spark, d, "documents").groupBy(E.classify(F.col("text"), E.CONTENT_TYPES, "general").alias("content_type")).agg(F.count("*").alias("n"))


@query("content_type_counts", f"SELECT content_type, count(*) AS n FROM (SELECT {_KIND} AS content_type FROM {_DOCS}) GROUP BY content_type")
def content_type_counts(spark, d):
    return _told(spark, d).groupBy(E.classify(F.col("text"), E.CONTENT_TYPES, "general").alias("content_type")).agg(F.count("*").alias("n"))


# The questions have no medical words; some are put in on both sides, by the item's number.
_ASKED = "concat(text, CASE item_id % 8 WHEN 0 THEN ' which of the following is EXCEPT a Carcinoma of the tympanic membrane' WHEN 1 THEN ' MTA and ah the plus in gingivectomy' WHEN 2 THEN ' angioedema, TB or ayre''s spatula' WHEN 3 THEN ' acid-base and the CI of an anaesthesia' WHEN 4 THEN ' randomised cohort; ureteric DJ stent' WHEN 5 THEN ' most common site, myocardium viable' ELSE '' END)"


def _values(rows) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def _re2(expression: str) -> str:
    """The expression with bounds of words of any script, which RE2 has no sign for; any case."""
    lead = expression.replace("|\\b", "|(?:^|[^\\p{L}\\p{N}_])")
    lead = "(?:^|[^\\p{L}\\p{N}_])" + lead[2:] if lead.startswith("\\b") else lead
    return "(?i)" + lead.replace("\\b", "(?:$|[^\\p{L}\\p{N}_])").replace("\\w", "[\\p{L}\\p{N}_]")


_EXPANDED = rf"""WITH q AS (SELECT item_id, t, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS s FROM (SELECT item_id, {_ASKED} AS t FROM benchmark)),
terms(k, x) AS (VALUES {_values((k, x) for k, v in W.terms().items() for x in v)}),
expressions(p, x) AS (VALUES {_values((_re2(p), x.lower()) for p, _, v in W.phrases() for x in v)}),
pairs(a, b) AS (VALUES {_values([*W.SPELLINGS, *[p[::-1] for p in W.SPELLINGS]])}),
w AS (SELECT item_id, list_filter(regexp_split_to_array(s, '[^a-z0-9'']+'), lambda x: x <> '' AND NOT list_contains([{", ".join(f"'{x}'" for x in W.WITHOUT_CONTENT)}], x)) AS ws FROM q),
g AS (SELECT item_id, unnest(ws) AS k FROM w UNION ALL SELECT item_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT item_id, ws, unnest(range(1, len(ws))) AS i FROM w)),
e AS (SELECT item_id, s AS x FROM q UNION SELECT item_id, x FROM g JOIN terms USING (k) UNION SELECT item_id, x FROM q JOIN expressions ON regexp_matches(t, p)
  UNION SELECT item_id, b FROM q JOIN pairs ON contains(s, a) UNION SELECT item_id, lower(unnest(regexp_extract_all(t, '\b([A-Z]{{2,}}[A-Z0-9]*)\b', 1))) FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY contains(x, ' ') DESC, (length(x) <= 5 AND regexp_matches(x, '^[\p{{L}}\p{{N}}]+$')) DESC, length(x), x) AS n FROM e)
SELECT item_id, string_agg(x, '|' ORDER BY n) AS expansions FROM r WHERE n <= 30 GROUP BY item_id"""


@query("query_expansions", _EXPANDED)
def query_expansions(spark, d):
    asked = load(spark, d, "benchmark").select("item_id", F.expr(_ASKED.replace("ayre''s", "ayre\\'s")).alias("t"))
    return H.expansions(asked, H.dictionary(spark), "item_id", "t").select("item_id", F.array_join("expansions", "|").alias("expansions"))


# A dictionary of its own data: the first three words of every question, and its first two.
_FIRST = "SELECT item_id AS phrase_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')[1 : n] AS phrase FROM benchmark, (SELECT unnest([2, 3]) AS n)"


@query("phrase_matches", f"WITH p AS ({_FIRST}), t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), m AS (SELECT doc_id, i - 1 AS start, len(phrase) AS n, phrase_id FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t) JOIN p ON w[i] = phrase[1] AND w[i : i + len(phrase) - 1] = phrase) SELECT doc_id, start::BIGINT AS start, n::BIGINT AS n, phrase_id FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.doc_id = b.doc_id AND b.start <= a.start AND b.start + b.n >= a.start + a.n AND b.n > a.n)")
def phrase_matches(spark, d):
    from ..functions.text import whitespace_tokens

    words = whitespace_tokens(F.col("text"))
    first = load(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), words.alias("w"), F.explode(F.array(F.lit(2), F.lit(3))).alias("n"))
    first = first.select("phrase_id", F.slice("w", F.lit(1), F.col("n")).alias("phrase")).filter("size(phrase) > 1")
    found = H.matches(load(spark, d, "documents"), first, "doc_id", words)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.size("phrase").cast("long").alias("n"), "phrase_id")


_WINDOWS = "SELECT CASE WHEN i = 0 THEN doc_id::VARCHAR ELSE doc_id || '#' || (i // 400) END AS chunk_id, source AS section_id, doc_id, substr(text, i + 1, 500) AS text FROM documents, LATERAL (SELECT unnest(range(0, length(text), 400)) AS i)"


def _store(spark, d):
    from ..sources import lookup

    docs = load(spark, d, "documents")
    x = C.char_windows(docs.select(F.struct("doc_id", "source").alias("of"), "text"), "of", "text", 500, 100)
    x = x.select(C.passage_ids(F.col("of.doc_id"), F.col("pos")).alias("chunk_id"), "of.doc_id", F.col("chunk").alias("text"), F.col("of.source").alias("section_id"))
    # The store is named by its folder, which a session makes once for the files as they are.
    name = lambda path: "chunks_" + path.rsplit("-", 1)[-1]
    buckets = lambda: max(8, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (64 << 20))
    path = built(spark, docs, "chunks", lambda p: lookup.store_chunks(x, name(p), p, buckets()))
    return lookup.ChunkStore(spark, name(path))


@query("chunk_lookup", f"WITH c AS ({_WINDOWS}) SELECT chunk_id, section_id, doc_id, md5(text) AS h FROM c WHERE chunk_id IN (SELECT DISTINCT doc_id || '#' || 2 FROM labels)")
def chunk_lookup(spark, d):
    """The third chunk of every labelled document, from tables bucketed by chunk."""
    ids = load(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("#2")).alias("id"))
    return _store(spark, d).chunks(ids).select("chunk_id", "section_id", "doc_id", F.md5("text").alias("h"))


@query("chunk_summaries", f"WITH c AS ({_WINDOWS}) SELECT 'section' AS kind, section_id AS id, count(*) AS n FROM c WHERE section_id IS NOT NULL GROUP BY section_id UNION ALL SELECT 'document', doc_id::VARCHAR, count(*) FROM c WHERE doc_id IS NOT NULL GROUP BY doc_id")
def chunk_summaries(spark, d):
    s = _store(spark, d)
    one = s.sections().select(F.lit("section").alias("kind"), F.col("section_id").alias("id"), "n")
    return one.unionByName(s.documents().select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "n"))
