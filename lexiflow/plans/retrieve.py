"""Queries of retrieval, fusion, packing and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import fusion as U
from ..operators import index as I
from ..operators import phrases as H
from ..operators import retrieval as R
from ..operators import retriever as X
from ..operators import vectors as V
from ..streaming import sessions as Z
from ..shared import shared_folder, written
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


_FIELDS: dict = {}


def _index(spark, d, field="text"):
    """The BM25 index of the documents' ``field`` (an SQL expression)."""
    docs = load(spark, d, "documents")
    kind = f"bm25_{_FIELDS.setdefault(field, len(_FIELDS))}"
    return I.Bm25.open(spark, built(spark, docs, kind, lambda path: I.build_bm25(docs, "doc_id", T.whitespace_tokens(F.expr(field)), path)))


def _best(spark, d, field="text", queries=None, k=10, groups=None):
    """item_id, doc_id, score, rank of the k best documents of each query; written, so that what joins them knows how few
    they are and no text is shuffled for them."""
    queries = load(spark, d, "benchmark") if queries is None else queries
    return written(_index(spark, d, field).top(queries, "item_id", T.whitespace_tokens(F.col("text")), k, groups=groups), "best")[0]


def _bm25_sql(doc_text="text", query="SELECT item_id, text FROM benchmark"):
    toks = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> '')"
    return f"""
d AS (SELECT doc_id, {toks.format(doc_text)} AS t FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), st),
i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({toks.format('text')}) AS term FROM ({query})) GROUP BY item_id, term),
hits AS (SELECT q.item_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.t) / avgdl))) AS score
         FROM q JOIN i USING (term) JOIN p USING (term) JOIN d USING (doc_id), st GROUP BY q.item_id, p.doc_id)"""


_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM hits QUALIFY rank <= 10)"


@query("bm25_topk", f"WITH {_bm25_sql()}, {_TOP} SELECT item_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM top")
def bm25_topk(spark, d):
    return _best(spark, d).select("item_id", "doc_id", "rank", "score")


_TITLED = "concat(source, ' ', source, ' ', source, ' ', text)"


@query("bm25_title_boost", f"WITH {_bm25_sql(_TITLED)}, {_TOP} SELECT item_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM top")
def bm25_title_boost(spark, d):
    return _best(spark, d, _TITLED).select("item_id", "doc_id", "rank", "score")


_VARIANTS = "SELECT item_id * 2 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, split_part(text, ',', 1) FROM benchmark"


@query("bm25_multiquery_votes", f"WITH {_bm25_sql(query=_VARIANTS)}, {_TOP} SELECT q, doc_id, votes, score FROM (SELECT item_id // 2 AS q, doc_id, count(*) AS votes, max(round(score, 6)) AS score FROM top GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY q ORDER BY votes DESC, score DESC, doc_id) <= 5")
def bm25_multiquery_votes(spark, d):
    bench = load(spark, d, "benchmark")
    variants = bench.select((F.col("item_id") * 2).alias("item_id"), "text").union(bench.select(F.col("item_id") * 2 + 1, F.substring_index("text", ",", 1)))
    top = _best(spark, d, queries=variants)
    merged = R.merge_variants(top.select(F.floor(F.col("item_id") / 2).cast("long").alias("q"), F.col("item_id").alias("variant"), F.col("doc_id").alias("id"), "score"))
    return R.top_k(merged, ["q"], [F.desc("votes"), F.desc("score"), F.asc("id")], 5).select("q", F.col("id").alias("doc_id"), "votes", "score")


def _vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
# Vectors that can be compared.
_SOUND = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"
_SIM = {
    "ip": "list_dot_product(a.v, b.v)",
    "cosine": "list_dot_product(a.v, b.v) / (greatest(sqrt(list_dot_product(a.v, a.v)), 1e-12) * greatest(sqrt(list_dot_product(b.v, b.v)), 1e-12))",
    "l2": "-list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
}


def _dense_whole(metric):
    def run(spark, d):
        v = _vectors(spark, d).select("id", "v")
        q = v.filter("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
        return V.dense(q, v, 5, metric, others=True).select("q", "id", "rank", F.round("score", 6).alias("score"))

    return run


# Against all vectors but the query's own.
for _m, _s in _SIM.items():
    query(f"dense_whole_{_m}", f"WITH {_SOUND} SELECT q, id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT a.id AS q, b.id, round({_s}, 9) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round({_s}, 9) DESC, b.id) AS rank FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)) WHERE rank <= 5")(_dense_whole(_m))


@query("vector_normalize", f"WITH {_V} SELECT id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)) * 2)), 6) AS s FROM v")
def vector_normalize(spark, d):
    u = R.unit(F.transform("v", lambda x: x * 3))
    return _vectors(spark, d).select("id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * 2), 6).alias("s"))


_CENTROIDS = "c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) GROUP BY label, i)"


@query("label_centroids", f"WITH {_V}, {_CENTROIDS} SELECT label, i::INTEGER AS i, round(x, 6) AS x FROM c")
def label_centroids(spark, d):
    return _vectors(spark, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", (F.col("i") + 1).alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


# Of 100 fitted cells, probes for a recall of 0.9 and more (README); the vectors of the tables hardly cluster.
IVF_CELLS, IVF_PROBES = 100, 50


def _asked(spark, d):
    v = _vectors(spark, d).select("id", "v")
    return v, v.filter("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))


def _cells(spark, d):
    return built(spark, load(spark, d, "embeddings"), "ivf", lambda p: V.build_vectors(_asked(spark, d)[0], p, IVF_CELLS))


@query("ivf_probe")
def ivf_probe(spark, d):
    """The inverted file, built once; a query's own vector is among its hits."""
    _, q = _asked(spark, d)
    path = _cells(spark, d)
    return V.probe_vectors(spark, path, q, IVF_PROBES, 5).select("q", "id", "rank", F.round("score", 6).alias("score"))


def _links(spark, d):
    return built(spark, load(spark, d, "embeddings"), "graph", lambda p: V.build_graph(_asked(spark, d)[0], p))


def _graph(spark, d):
    return V.search_graph(spark, _links(spark, d), _asked(spark, d)[1], 5, f"{shared_folder(spark)}/graph-search-{uuid.uuid4().hex}", others=True)


@query("graph_search")
def graph_search(spark, d):
    """The neighbour graph, built once, searched by rounds; without a query's own vector."""
    return _graph(spark, d)[0].select("q", "id", "rank", F.round("score", 6).alias("score"))


_LISTS = f"{_bm25_sql()}, {_TOP}, ov AS (SELECT item_id, doc_id, rank, round(score, 6) AS score, d.text, b.text AS question, d.source FROM top JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '([a-z]+)', 1), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "], w)))"
_OVERLAP = f"CASE WHEN len({_WORDS.format('question')}) = 0 THEN 0.0 ELSE len(list_intersect({_WORDS.format('question')}, {_WORDS.format('text')})) / len({_WORDS.format('question')})::DOUBLE END"


def _lists(spark, d):
    docs, bench = load(spark, d, "documents"), load(spark, d, "benchmark")
    top = docs.select("doc_id", "text", "source").join(_best(spark, d), "doc_id").join(bench.select("item_id", F.col("text").alias("question")), "item_id")
    overlap = T.overlap(T.content_words(F.col("question")), T.content_words(F.col("text"))).alias("overlap")
    return written(top.select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"), "score", "rank", "source", overlap), "lists")[0]


@query("lexical_overlap", f"WITH {_LISTS} SELECT item_id AS q, doc_id AS id, round({_OVERLAP}, 6) AS overlap FROM ov")
def lexical_overlap(spark, d):
    return _lists(spark, d).select("q", "id", F.round("overlap", 6).alias("overlap"))


_RRF = f"""{_LISTS}, o AS (SELECT item_id AS q, doc_id AS id, rank, score, source, {_OVERLAP} AS overlap FROM ov),
two AS (SELECT q, id, rank FROM o UNION ALL SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(overlap, 9) DESC, id) FROM o),
f AS (SELECT q, id, sum(1.0 / (60 + rank)) AS rrf, count(*) AS votes FROM two GROUP BY q, id)"""


def _two(spark, d):
    o = _lists(spark, d)
    second = o.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("overlap", 9)), "id")).alias("rank"))
    return o, U.rrf(o.select("q", "id", "rank").unionByName(second))


@query("rrf_two_lists", f"WITH {_RRF} SELECT q, id, round(rrf, 9) AS rrf, votes FROM f")
def rrf_two_lists(spark, d):
    return _two(spark, d)[1].select("q", "id", F.round("rrf", 9).alias("rrf"), "votes")


def _mm(c):
    return f"CASE WHEN max({c}) OVER (PARTITION BY q) > min({c}) OVER (PARTITION BY q) THEN ({c} - min({c}) OVER (PARTITION BY q)) / (max({c}) OVER (PARTITION BY q) - min({c}) OVER (PARTITION BY q)) ELSE 0.0 END"


def _rescored(spark, d, raw):
    o, f = _two(spark, d)
    x = o.join(f, ["q", "id"])
    mm = lambda c: U.minmax(F.round(c, 9), ["q"])
    return U.rescore(x, [(mm("rrf"), 0.6), (F.col("overlap") if raw else mm("overlap"), 0.4)])


@query("minmax_rescore", f"WITH {_RRF} SELECT q, id, round((0.6 * {_mm('r')} + 0.4 * {_mm('v')}) / 1.0, 6) AS final FROM (SELECT q, id, round(rrf, 9) AS r, round(overlap, 9) AS v FROM o JOIN f USING (q, id))")
def minmax_rescore(spark, d):
    return _rescored(spark, d, False).select("q", "id", F.round("final", 6).alias("final"))


@query("weighted_rescore_raw_overlap", f"WITH {_RRF} SELECT q, id, round((0.6 * {_mm('r')} + 0.4 * v) / 1.0, 6) AS final FROM (SELECT q, id, round(rrf, 9) AS r, overlap AS v FROM o JOIN f USING (q, id))")
def weighted_rescore_raw_overlap(spark, d):
    return _rescored(spark, d, True).select("q", "id", F.round("final", 6).alias("final"))


@query("score_threshold", f"WITH {_RRF} SELECT q, count(*) AS n FROM (SELECT q, round((0.6 * {_mm('r')} + 0.4 * v) / 1.0, 6) AS final FROM (SELECT q, round(rrf, 9) AS r, overlap AS v FROM o JOIN f USING (q, id))) WHERE final >= 0.35 GROUP BY q")
def score_threshold(spark, d):
    return _rescored(spark, d, True).filter(F.round("final", 6) >= 0.35).groupBy("q").agg(F.count("*").alias("n"))


@query("top_gate", f"WITH {_RRF} SELECT q, id FROM (SELECT q, id, first(overlap) OVER (PARTITION BY q ORDER BY rank) AS g FROM o) WHERE g >= 0.5")
def top_gate(spark, d):
    return U.gate(_lists(spark, d), F.col("overlap"), 0.5).select("q", "id")


@query("dedup_best_per_source", f"WITH {_RRF} SELECT q, source, id, score FROM o QUALIFY row_number() OVER (PARTITION BY q, source ORDER BY score DESC, id) = 1")
def dedup_best_per_source(spark, d):
    return U.best_of(_lists(spark, d), ["q", "source"], [F.desc("score"), F.asc("id")]).select("q", "source", "id", "score")


@query("boost_by_type", f"WITH {_RRF} SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY s DESC, id)::INTEGER AS new_rank FROM (SELECT q, id, score * CASE WHEN source IN ('src1', 'src2', 'src3') THEN 1.5 ELSE 1.0 END AS s FROM o)")
def boost_by_type(spark, d):
    x = _lists(spark, d).withColumn("s", F.col("score") * F.when(F.col("source").isin("src1", "src2", "src3"), 1.5).otherwise(1.0))
    return x.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id")).alias("new_rank"))


@query("rerank_head", f"WITH {_RRF} SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY rank > 5, CASE WHEN rank <= 5 THEN -round(overlap, 9) ELSE rank END, id)::INTEGER AS new_rank FROM o")
def rerank_head(spark, d):
    return R.rerank_head(_lists(spark, d), F.round("overlap", 9), 5).select("q", "id", "new_rank")


@query("coarse_to_fine", f"WITH {_bm25_sql()}, h AS (SELECT item_id AS q, doc_id AS id, source, round(score, 6) AS score FROM hits JOIN documents USING (doc_id)), s AS (SELECT q, source FROM (SELECT q, source, max(score) AS m FROM h GROUP BY q, source) QUALIFY row_number() OVER (PARTITION BY q ORDER BY m DESC, source) <= 3) SELECT q, id, score FROM h SEMI JOIN s USING (q, source) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 5")
def coarse_to_fine(spark, d):
    # The five best of each section hold its best one and whatever the sections' five best can be.
    h = _best(spark, d, k=5, groups=load(spark, d, "documents").select("doc_id", "source")).select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"), F.col("source").alias("section"), "score")
    fine = h.join(R.coarse_sections(h, 3), ["q", "section"], "left_semi")
    return R.top_k(fine, ["q"], [F.desc("score"), F.asc("id")], 5).select("q", "id", "score")


_PACK = f"{_bm25_sql()}, {_TOP}, t AS (SELECT item_id AS q, doc_id AS id, rank, (n_chars // 4) AS tokens FROM top JOIN documents USING (doc_id))"


def _packs(spark, d, *more):
    x = load(spark, d, "documents").select("doc_id", "n_chars", *more).join(_best(spark, d), "doc_id")
    return x.select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"), "rank", F.floor(F.col("n_chars") / 4).alias("tokens"), *more)


@query("pack_prefix", f"WITH {_PACK} SELECT q, id, used::BIGINT AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY q ORDER BY rank) AS used FROM t) WHERE used <= 1500")
def pack_prefix(spark, d):
    return U.pack_prefix(_packs(spark, d), "tokens", 1500).select("q", "id", "used")


@query("pack_skip", f"WITH RECURSIVE {_PACK}, s AS (SELECT q, 0 AS r, 0::BIGINT AS used, '' AS kept FROM (SELECT DISTINCT q FROM t) UNION ALL SELECT s.q, s.r + 1, CASE WHEN used + tokens <= 1500 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 1500 THEN kept || id || ',' ELSE kept END FROM s JOIN t ON t.q = s.q AND t.rank = s.r + 1) SELECT q, used, kept FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY r DESC) = 1")
def pack_skip(spark, d):
    kept = F.concat_ws("", F.transform("kept", lambda x: F.concat(x["id"].cast("string"), F.lit(","))))
    return U.pack_fold(_packs(spark, d), "tokens", 1500).select("q", "used", kept.alias("kept"))


@query("pack_truncate", f"WITH RECURSIVE {_PACK}, s AS (SELECT q, 0 AS r, 0::BIGINT AS used, '' AS kept, false AS over FROM (SELECT DISTINCT q FROM t) UNION ALL SELECT s.q, s.r + 1, CASE WHEN over THEN used WHEN used + tokens <= 1500 THEN used + tokens WHEN 1500 - used > 16 THEN 1500 ELSE used END, CASE WHEN over THEN kept WHEN used + tokens <= 1500 THEN concat_ws(',', nullif(kept, ''), id || ':' || tokens) WHEN 1500 - used > 16 THEN concat_ws(',', nullif(kept, ''), id || ':' || (1500 - used)) ELSE kept END, over OR used + tokens > 1500 FROM s JOIN t ON t.q = s.q AND t.rank = s.r + 1) SELECT q, used, kept FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY r DESC) = 1")
def pack_truncate(spark, d):
    kept = F.concat_ws(",", F.transform("kept", lambda x: F.concat_ws(":", x["id"].cast("string"), x["tokens"].cast("string"))))
    return U.pack_fold(_packs(spark, d), "tokens", 1500, 16).select("q", "used", kept.alias("kept"))


# Passages in full, which tokens counts.
@query("context_whole", f"WITH {_PACK} SELECT q, string_agg('Reference ' || rank || ': [' || coalesce(source, '') || '] ' || coalesce(text, ''), chr(10) ORDER BY rank) AS refs, sum(tokens)::BIGINT AS tokens FROM t JOIN documents ON id = doc_id WHERE rank <= 6 GROUP BY q")
def context_whole(spark, d):
    x = _packs(spark, d, "text", "source").filter("rank <= 6")
    line = F.concat(F.lit("Reference "), F.col("rank").cast("string"), F.lit(": ["), F.coalesce("source", F.lit("")), F.lit("] "), F.coalesce("text", F.lit("")))
    return x.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("refs"), F.sum("tokens").alias("tokens"))


@query("retrieval_prf", f"WITH {_bm25_sql()}, {_TOP}, w AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), g AS (SELECT item_id, count(*) AS got FROM top GROUP BY 1), x AS (SELECT b.item_id, coalesce(got, 0) AS got, (SELECT count(*) FROM w WHERE w.item_id = b.item_id) AS want, (SELECT count(*) FROM w JOIN top USING (item_id, doc_id) WHERE w.item_id = b.item_id) AS hit FROM benchmark b LEFT JOIN g USING (item_id)) SELECT item_id AS q, round(hit / greatest(got, 1)::DOUBLE, 6) AS precision, round(hit / greatest(want, 1)::DOUBLE, 6) AS recall FROM x")
def retrieval_prf(spark, d):
    bench, docs = load(spark, d, "benchmark"), load(spark, d, "documents")
    got = _best(spark, d).groupBy("item_id").agg(F.collect_list("doc_id").alias("got"))
    wanted = H.containing(docs, bench, "doc_id", "text", "item_id", "text").groupBy("item_id").agg(F.collect_list("doc_id").alias("wanted"))
    none = F.array().cast("array<bigint>")
    sets = bench.select("item_id").join(got, "item_id", "left").join(wanted, "item_id", "left").select(F.col("item_id").alias("q"), F.coalesce("got", none).alias("got"), F.coalesce("wanted", none).alias("wanted"))
    return A.prf(sets).select("q", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_PRED = "p AS (SELECT l.doc_id, l.quality AS gold, CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN length(regexp_replace(d.text, '[^!#%$&*]', '', 'g')) > 20 THEN 0 ELSE 1 END AS pred, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id))"


def _pred(spark, d):
    x = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id")
    pred = F.when(F.col("doc_id") % 11 == 0, None).when(F.length(F.regexp_replace("text", "[^!#%$&*]", "")) > 20, 0).otherwise(1)
    return x.select("doc_id", F.col("quality").alias("gold"), pred.alias("pred"), "source", "n_chars")


@query("accuracy_overall", f"WITH {_PRED} SELECT round(avg(coalesce(gold = pred, false)::INTEGER), 6) AS accuracy, count(*) AS total, count_if(pred IS NULL)::BIGINT AS unscored FROM p")
def accuracy_overall(spark, d):
    return _pred(spark, d).agg(F.round(A.accuracy(F.col("gold") == F.col("pred")), 6).alias("accuracy"), F.count("*").alias("total"), F.count_if(F.col("pred").isNull()).alias("unscored"))


@query("accuracy_by_group", f"WITH {_PRED} SELECT source, round(avg(coalesce(gold = pred, false)::INTEGER), 6) AS accuracy, count(*) AS total FROM p GROUP BY source")
def accuracy_by_group(spark, d):
    return _pred(spark, d).groupBy("source").agg(F.round(A.accuracy(F.col("gold") == F.col("pred")), 6).alias("accuracy"), F.count("*").alias("total"))


_CONF = "l AS (SELECT gold AS x FROM p WHERE pred IS NOT NULL UNION SELECT pred FROM p WHERE pred IS NOT NULL), m AS (SELECT a.x AS gold, b.x AS predicted, (SELECT count(*) FROM p WHERE gold = a.x AND pred = b.x) AS n FROM l a, l b)"


@query("confusion_long", f"WITH {_PRED}, {_CONF} SELECT gold, predicted, n FROM m")
def confusion_long(spark, d):
    return A.confusion(_pred(spark, d), "gold", "pred")


@query("macro_f1", f"WITH {_PRED}, {_CONF}, c AS (SELECT x, (SELECT sum(n) FROM m WHERE gold = x) AS s, (SELECT sum(n) FROM m WHERE predicted = x) AS c, (SELECT sum(n) FROM m WHERE gold = x AND predicted = x) AS h FROM l), f AS (SELECT *, CASE WHEN s + c > 0 THEN 2.0 * h / (s + c) ELSE 0.0 END AS f1 FROM c) SELECT round(sum(h) / sum(s)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * s) / sum(s)::DOUBLE, 6) AS weighted_f1 FROM f")
def macro_f1(spark, d):
    x = A.f1_scores(A.confusion(_pred(spark, d), "gold", "pred"))
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


@query("coverage_quantiles", "SELECT source, round(avg(n_chars), 6) AS mean, min(n_chars) AS low, max(n_chars) AS high, list_sort(list(n_chars) FILTER (n_chars IS NOT NULL))[count(n_chars) // 4 + 1] AS q1, list_sort(list(n_chars) FILTER (n_chars IS NOT NULL))[count(n_chars) // 2 + 1] AS q2, list_sort(list(n_chars) FILTER (n_chars IS NOT NULL))[3 * count(n_chars) // 4 + 1] AS q3 FROM documents GROUP BY source")
def coverage_quantiles(spark, d):
    return A.index_quantiles(load(spark, d, "documents"), "source", "n_chars").withColumn("mean", F.round("mean", 6))


_RUNS = "r AS (SELECT l_returnflag AS f, l_linestatus AS s, l_shipdate, l_suppkey % 7 AS g, l_linenumber AS v, round(l_extendedprice, 2) AS a, l_quantity AS e, l_orderkey AS o FROM lineitem)"


def _runs(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), (F.col("l_suppkey") % 7).alias("g"), F.col("l_linenumber").alias("v"), F.round("l_extendedprice", 2).alias("a"), F.col("l_quantity").alias("e"), F.col("l_orderkey").alias("o"))


@query("best_of_group", f"WITH {_RUNS} SELECT f, s, g, max(a) AS best, count(*) AS n, round(avg(a), 4) AS mean, round(stddev_pop(a), 4) AS std FROM r GROUP BY f, s, g")
def best_of_group(spark, d):
    return _runs(spark, d).groupBy("f", "s", "g").agg(F.max("a").alias("best"), F.count("*").alias("n"), F.round(F.avg("a"), 4).alias("mean"), F.round(F.stddev_pop("a"), 4).alias("std"))


@query("latest_of_group", f"WITH {_RUNS} SELECT f, s, g, v, a, e FROM r QUALIFY row_number() OVER (PARTITION BY f, s, g ORDER BY v DESC, a DESC, e) = 1")
def latest_of_group(spark, d):
    return A.latest_of(_runs(spark, d), ["f", "s", "g"], F.col("v"), "a", "e").select("f", "s", "g", "v", "a", "e")


_DELTA = f"{_RUNS}, b AS (SELECT f, g, v, s, max(a) AS m FROM r GROUP BY ALL), w AS (SELECT f, g, v, max(m) FILTER (s = 'F') AS x, max(m) FILTER (s = 'O') AS y FROM b GROUP BY f, g, v), p AS (SELECT *, x - y AS delta FROM w WHERE x IS NOT NULL AND y IS NOT NULL)"


@query("matched_factor_deltas", f"WITH {_DELTA} SELECT count(*) AS n_pairs, round(avg(delta), 4) AS mean, round(quantile_cont(delta, 0.5), 4) AS median, count_if(delta > 0)::BIGINT AS positive, count_if(delta < 0)::BIGINT AS negative FROM p")
def matched_factor_deltas(spark, d):
    x = A.delta_summary(A.matched_deltas(_runs(spark, d), "s", "F", "O", ["f", "g", "v"], "a"))
    return x.select("n_pairs", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "positive", "negative")


@query("argminmax_per_factor", f"WITH {_RUNS} SELECT g, max(a) AS high, min(a) AS low, arg_max(v, (a, o, v)) AS v_high, arg_min(v, (a, o, v)) AS v_low FROM r GROUP BY g")
def argminmax_per_factor(spark, d):
    return _runs(spark, d).groupBy("g").agg(F.max("a").alias("high"), F.min("a").alias("low"), F.max_by("v", F.struct("a", "o", "v")).alias("v_high"), F.min_by("v", F.struct("a", "o", "v")).alias("v_low"))


def _pairs(spark, d):
    return load(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))


@query("transition_matrix", "SELECT quality = 1 AS a, toxic = 0 AS b, count(*) AS n FROM labels GROUP BY ALL")
def transition_matrix(spark, d):
    return _pairs(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("mcnemar_exact", "WITH c AS (SELECT count_if(quality <> 1 AND toxic = 0)::BIGINT AS x, count_if(quality = 1 AND toxic <> 0)::BIGINT AS y FROM labels) SELECT x AS n01, y AS n10, round(least(1, 2 * (SELECT sum(exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))) FROM range(0, least(x, y) + 1) t(i))), 6) AS p FROM c")
def mcnemar_exact(spark, d):
    c = _pairs(spark, d).agg(F.count_if(~F.col("a") & F.col("b")).alias("n01"), F.count_if(F.col("a") & ~F.col("b")).alias("n10"))
    return c.select("n01", "n10", F.round(A.mcnemar(F.col("n01"), F.col("n10")), 6).alias("p"))


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    return A.bootstrap(_pairs(spark, d).withColumn("g", F.lit("all")), "g", "a", "b")


@query("leaderboard", f"WITH {_RUNS} SELECT f, s, g, round(avg(a), 4) AS mean FROM r GROUP BY f, s, g ORDER BY mean DESC, f, s, g LIMIT 10")
def leaderboard(spark, d):
    return _runs(spark, d).groupBy("f", "s", "g").agg(F.round(F.avg("a"), 4).alias("mean")).orderBy(F.desc("mean"), "f", "s", "g").limit(10)


# Some rows break the rules on both sides, by their number.
_BROKEN = "SELECT doc_id, text, CASE WHEN doc_id % 37 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, CASE WHEN doc_id % 53 <> 0 THEN source END AS source FROM documents"


@query("constraint_violations", f"SELECT doc_id, CASE WHEN source IS NULL THEN 'source' ELSE 'n_chars' END AS broken FROM ({_BROKEN}) WHERE n_chars <> length(text) OR source IS NULL")
def constraint_violations(spark, d):
    x = load(spark, d, "documents").withColumn("n_chars", F.expr("CASE WHEN doc_id % 37 = 0 THEN n_chars + 1 ELSE n_chars END")).withColumn("source", F.expr("CASE WHEN doc_id % 53 <> 0 THEN source END"))
    return x.filter("n_chars <> length(text) OR source IS NULL").select("doc_id", F.when(F.col("source").isNull(), "source").otherwise("n_chars").alias("broken"))


@query("subject_distribution", "SELECT source, count(*) AS before, count_if(doc_id % 3 = 0)::BIGINT AS after FROM documents GROUP BY source")
def subject_distribution(spark, d):
    x = load(spark, d, "documents")
    after = x.filter("doc_id % 3 = 0").groupBy("source").agg(F.count("*").alias("after"))
    return x.groupBy("source").agg(F.count("*").alias("before")).join(after, "source", "full").select("source", "before", F.coalesce("after", F.lit(0)).cast("long").alias("after"))


@query("last_n_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_n_turns(spark, d):
    return Z.last_turns(load(spark, d, "conversations"), 3).select("conv_id", "turn", "role")


@query("conversation_context", "SELECT conv_id, md5(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS h FROM (SELECT * FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id")
def conversation_context(spark, d):
    return Z.context(load(spark, d, "conversations"), 6).select("conv_id", F.md5("context").alias("h"))


@query("session_list", "SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def session_list(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("last_turn"))


# Messages ten minutes, an hour, two days or eight days apart, by the conversation's number.
_STEP = "CASE conv_id % 4 WHEN 0 THEN 600 WHEN 1 THEN 3600 WHEN 2 THEN 172800 ELSE 691200 END"
_AT = f"1704067200 + turn * {_STEP}"


@query("durable_sessions", f"WITH m AS (SELECT conv_id::VARCHAR AS conv_id, {_AT} AS ts, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations), g AS (SELECT *, ts - lag(ts) OVER w AS gap FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY ts, role, text)), s AS (SELECT *, sum((coalesce(gap, 0) > 604800)::INTEGER) OVER (PARTITION BY conv_id ORDER BY ts, role, text ROWS UNBOUNDED PRECEDING)::INTEGER AS session FROM g) SELECT conv_id, session, row_number() OVER o - 1 AS turn, (min(ts) OVER (PARTITION BY conv_id, session))::BIGINT AS created, coalesce(row_number() OVER o > 1 AND gap <= 3600, false) AS active, md5(role || ' ' || text) AS h FROM s WINDOW o AS (PARTITION BY conv_id, session ORDER BY ts, role, text)")
def durable_sessions(spark, d):
    """All messages as a stream of two portions, numbered by state; the second begins where the first ended."""
    folder = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    rows = load(spark, d, "conversations").withColumn("ts", F.timestamp_seconds(F.expr(_AT)))
    for some in ("turn < 3", "turn >= 3"):
        Z.messages(rows.filter(some), "conv_id", "ts", "role", "text", F.concat_ws(":", "conv_id", "turn")).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("conv_id string, ts timestamp, role string, text string").parquet(f"{folder}/in")
        run = Z.durable(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    out = spark.read.schema(Z.TURNS).parquet(f"{folder}/out")
    return out.select("conv_id", "session", "turn", F.unix_seconds("created").alias("created"), "active", F.md5(F.concat_ws(" ", "role", "text")).alias("h"))


@query("resumable_results", "SELECT count(*) AS n, sum((quality = 1)::INTEGER)::BIGINT AS correct, round(avg((quality = 1)::INTEGER), 6) AS accuracy FROM labels")
def resumable_results(spark, d):
    """All labels as a stream, judged batch by batch and written once; the totals after the last batch."""
    folder = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    labels = load(spark, d, "labels").select("doc_id", "quality")
    labels.repartition(6, "doc_id").write.parquet(f"{folder}/in")
    judged = lambda batch: batch.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("correct"))
    Z.write_once(Z.throttled(spark, f"{folder}/in", labels.schema, 4), f"{folder}/out", f"{folder}/state", judged).awaitTermination()
    last = Z.progress(spark.read.parquet(f"{folder}/out"), "correct").orderBy(F.desc("batch")).limit(1)
    return last.select(F.col("cum_total").alias("n"), F.col("cum_correct").alias("correct"), F.round("cum_accuracy", 6).alias("accuracy"))


@query("session_ttl", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 1 HOUR) AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def session_ttl(spark, d):
    s = Z.sessions(load(spark, d, "events"))
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.unix_micros(F.col("end").cast("timestamp")).alias("end"), "n", F.round("total", 4).alias("total"))


@query("cumulative_metrics", "SELECT batch, cum_total::BIGINT AS cum_total, cum_correct::BIGINT AS cum_correct, round(cum_correct / cum_total, 6) AS cum_accuracy FROM (SELECT batch, sum(t) OVER (ORDER BY batch) AS cum_total, sum(c) OVER (ORDER BY batch) AS cum_correct FROM (SELECT doc_id // 100 AS batch, count(*) AS t, sum(quality) AS c FROM labels GROUP BY 1))")
def cumulative_metrics(spark, d):
    b = load(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 100).alias("batch")).agg(F.count("*").alias("t"), F.sum("quality").alias("c"))
    return Z.running(b, "batch", "t", "c").select("batch", "cum_total", "cum_correct", F.round("cum_accuracy", 6).alias("cum_accuracy"))


@query("resume_remaining", "SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def resume_remaining(spark, d):
    return Z.remaining(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id").select("doc_id")


# --- retrieval in stages: a sparse and a dense list, fused, cut to sections, reranked

DIMS = 16
_BAG = f"""bq AS (SELECT item_id, b, count(*) AS x FROM (SELECT item_id, (ascii(w) + length(w)) % {DIMS} AS b FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark)) GROUP BY item_id, b),
bd AS (SELECT doc_id, b, count(*) AS x FROM (SELECT doc_id, (ascii(w) + length(w)) % {DIMS} AS b FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents)) GROUP BY doc_id, b),
nq AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM bq GROUP BY item_id), nd AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM bd GROUP BY doc_id),
near AS (SELECT item_id, doc_id, round(sum(bq.x / nq.n * (bd.x / nd.n)), 9) AS score FROM bq JOIN nq USING (item_id) JOIN bd USING (b) JOIN nd USING (doc_id) GROUP BY item_id, doc_id),
dense AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= 10)"""


def _dense_texts(spark, d, k=10):
    """The dense list over texts: an encoder, here one without a model, and exact search."""
    encode = I.hashed_words(DIMS)
    v = lambda table, key, q, x: load(spark, d, table).select(F.col(key).alias(q), encode(T.whitespace_tokens(F.col("text"))).alias(x)).repartition(q)  # noqa: E731  encodes once, not once per pair
    docs = v("documents", "doc_id", "id", "v").filter(F.exists("v", lambda x: x > 0))
    return V.dense(v("benchmark", "item_id", "q", "qv"), docs, k, "ip")


def _hybrid(spark, d):
    sparse = _best(spark, d).select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"), "rank")
    return written(U.rrf(sparse.unionByName(_dense_texts(spark, d).select("q", "id", "rank"))), "hybrid")[0]


@query("dense_texts", f"WITH {_BAG} SELECT item_id AS q, doc_id AS id, rank::INTEGER AS rank FROM dense")
def dense_texts(spark, d):
    return _dense_texts(spark, d).select("q", "id", "rank")


_HYBRID = f"{_bm25_sql()}, {_TOP}, {_BAG}, hy AS (SELECT item_id AS q, doc_id AS id, round(sum(1.0 / (60 + rank)), 9) AS rrf, count(*) AS votes FROM (SELECT item_id, doc_id, rank FROM top UNION ALL SELECT item_id, doc_id, rank FROM dense) GROUP BY 1, 2)"


@query("hybrid_search", f"WITH {_HYBRID} SELECT q, id, rrf, votes FROM hy QUALIFY row_number() OVER (PARTITION BY q ORDER BY rrf DESC, id) <= 8")
def hybrid_search(spark, d):
    x = _hybrid(spark, d).withColumn("rrf", F.round("rrf", 9))
    return R.top_k(x, ["q"], [F.desc("rrf"), F.asc("id")], 8).select("q", "id", "rrf", "votes")


def _both_texts(hits, spark, d):
    """Hits with both texts: they go to the documents, so no text is shuffled for them where they are few."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return docs.join(hits, "id").join(load(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question")), "q")


_STAGES = f"""{_HYBRID}, c AS (SELECT q, id, rrf, source, question, text FROM (SELECT hy.*, d.source, d.text, b.text AS question FROM hy JOIN documents d ON d.doc_id = hy.id JOIN benchmark b ON b.item_id = hy.q)),
sec AS (SELECT q, source FROM (SELECT q, source, max(rrf) AS m FROM c WHERE source IS NOT NULL GROUP BY q, source) QUALIFY row_number() OVER (PARTITION BY q ORDER BY m DESC, source) <= 4),
fine AS (SELECT c.*, row_number() OVER (PARTITION BY c.q ORDER BY rrf DESC, id) AS rank FROM c SEMI JOIN sec ON c.q = sec.q AND c.source = sec.source)"""


@query("three_stage_search", f"WITH {_STAGES} SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY rank > 4, CASE WHEN rank <= 4 THEN -round({_OVERLAP}, 9) ELSE rank END, id)::INTEGER AS new_rank FROM fine QUALIFY new_rank <= 6")
def three_stage_search(spark, d):
    """Sections by their best fused hit, hits of those sections, the head reranked by a scorer of pairs; all queries at
    once."""
    x = _both_texts(_hybrid(spark, d).withColumn("rrf", F.round("rrf", 9)), spark, d).withColumnRenamed("source", "section").withColumn("score", F.col("rrf"))
    fine = x.join(R.coarse_sections(x.filter("section is not null"), 4), ["q", "section"], "left_semi")
    fine = fine.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rrf"), "id")))
    pair = T.overlap(T.content_words(F.col("question")), T.content_words(F.col("text")))
    return R.rerank_head(fine, F.round(pair, 9), 4).filter("new_rank <= 6").select("q", "id", "new_rank")


@query("rerank_mixed", f"WITH {_HYBRID}, c AS (SELECT q, id, rrf, b.text AS question, d.text FROM hy JOIN documents d ON d.doc_id = hy.id JOIN benchmark b ON b.item_id = hy.q), o AS (SELECT q, id, rrf AS r, round({_OVERLAP}, 9) AS v FROM c) SELECT q, id, round(0.3 * {_mm('r')} + 0.7 * v, 6) AS mixed FROM o")
def rerank_mixed(spark, d):
    """First-stage scores, brought to 0..1 within a query, mixed with the pair scorer's."""
    x = _both_texts(_hybrid(spark, d).withColumn("rrf", F.round("rrf", 9)), spark, d)
    pair = F.round(T.overlap(T.content_words(F.col("question")), T.content_words(F.col("text"))), 9)
    return U.rescore(x.withColumn("pair", pair), [(U.minmax(F.col("rrf"), ["q"]), 0.3), (F.col("pair"), 0.7)]).select("q", "id", F.round("final", 6).alias("mixed"))


_OPTIONS = "SELECT item_id * 4 + o AS item_id, concat(text, ' ', list_filter(string_split(lower(text), ' '), lambda x: x <> '')[o + 1]) AS text FROM benchmark, (SELECT unnest([0, 1, 2]) AS o)"


@query("choice_search", f"WITH {_bm25_sql(query=_OPTIONS)}, {_TOP} SELECT q, doc_id AS id, votes, score FROM (SELECT item_id // 4 AS q, doc_id, count(*) AS votes, max(round(score, 6)) AS score FROM top GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY q ORDER BY votes DESC, score DESC, doc_id) <= 5")
def choice_search(spark, d):
    """The question asked once with each option behind it; hits by the number of options that find them."""
    words = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    asked = load(spark, d, "benchmark").select("item_id", "text", words.alias("w"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("o"))
    asked = asked.select((F.col("item_id") * 4 + F.col("o")).alias("item_id"), F.concat_ws(" ", "text", F.get("w", F.col("o"))).alias("text"))
    top = _best(spark, d, queries=asked)
    merged = R.merge_variants(top.select(F.floor(F.col("item_id") / 4).cast("long").alias("q"), F.col("item_id").alias("variant"), F.col("doc_id").alias("id"), "score"))
    return R.top_k(merged, ["q"], [F.desc("votes"), F.desc("score"), F.asc("id")], 5).select("q", "id", "votes", "score")


@query("index_terms", f"WITH {_bm25_sql()} SELECT i.term, df, round(i.idf, 6) AS idf FROM i JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) USING (term)")
def index_terms(spark, d):
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


# --- variants of a question, with kinds and weights

_KINDS = {"base": 1.0, "option": 0.5}
_ASKED_SQL = "SELECT item_id * 10 + n AS item_id, text FROM (SELECT item_id, 0 AS n, trim(text) AS text FROM benchmark UNION ALL SELECT item_id, o, trim(text) || chr(10) || 'Option: ' || list_filter(string_split(text, ' '), lambda x: x <> '')[o] FROM benchmark, (SELECT unnest([1, 2]) AS o))"


def _variants(spark, d):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    options = F.create_map(F.lit("A"), F.get(words, 0), F.lit("B"), F.get(words, 1))
    return X.variants(load(spark, d, "benchmark"), "item_id", F.col("text"), options, weights=_KINDS)


def _retriever(spark, d):
    """Sparse and dense over the documents' texts, by plug points that need no model."""
    encode = lambda c: I.hashed_words(DIMS)(T.whitespace_tokens(c))
    config = I.Config(tokens=T.whitespace_tokens, encode=encode, score_pair=lambda q, t: T.overlap(T.content_words(q), T.content_words(t)))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), encode(F.col("text")).alias("v"))
    return X.Retriever(config, _index(spark, d), docs.filter(F.exists("v", lambda x: x > 0)))


@query("variant_search", f"WITH {_bm25_sql(query=_ASKED_SQL)}, {_TOP}, f AS (SELECT item_id // 10 AS q, doc_id AS id, round(sum(CASE WHEN item_id % 10 = 0 THEN 1.0 ELSE 0.5 END / (60 + rank)), 9) AS rrf, count(*) AS votes FROM top GROUP BY 1, 2) SELECT q, id, rrf, votes, row_number() OVER (PARTITION BY q ORDER BY rrf DESC, id)::INTEGER AS rank FROM f QUALIFY rank <= 6")
def variant_search(spark, d):
    """The question and the question with each option, by BM25, as one weighted list."""
    return _retriever(spark, d).search(_variants(spark, d), 6, "sparse", depth=10)


_BAG_ASKED = _BAG.replace("FROM benchmark)", f"FROM ({_ASKED_SQL}))").replace("rank <= 10", "rank <= 12")
_STAGED = f"""{_bm25_sql(query=_ASKED_SQL)}, {_TOP.replace("rank <= 10", "rank <= 12")}, {_BAG_ASKED},
hy AS (SELECT item_id // 10 AS q, doc_id AS id, round(sum(CASE WHEN item_id % 10 = 0 THEN 1.0 ELSE 0.5 END / (60 + rank)), 9) AS rrf FROM (SELECT item_id, doc_id, rank FROM top UNION ALL SELECT item_id, doc_id, rank FROM dense) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY rrf DESC, id) <= 12),
c AS (SELECT hy.*, d.source, d.text, trim(b.text) AS question FROM hy JOIN documents d ON d.doc_id = hy.id JOIN benchmark b ON b.item_id = hy.q),
sec AS (SELECT q, source FROM (SELECT q, source, max(rrf) AS m FROM c WHERE source IS NOT NULL GROUP BY q, source) QUALIFY row_number() OVER (PARTITION BY q ORDER BY m DESC, source) <= 4),
fine AS (SELECT c.*, row_number() OVER (PARTITION BY c.q ORDER BY rrf DESC, id)::INTEGER AS rank FROM c SEMI JOIN sec ON c.q = sec.q AND c.source = sec.source)"""


@query("variant_staged", f"WITH {_STAGED} SELECT q, id, rank, row_number() OVER (PARTITION BY q ORDER BY rank > 4, CASE WHEN rank <= 4 THEN -round({_OVERLAP}, 9) ELSE rank END, id)::INTEGER AS new_rank FROM fine QUALIFY new_rank <= 5")
def variant_staged(spark, d):
    """Both indexes over all variants, sections, and the head by the scorer of pairs."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section"), "text")
    return _retriever(spark, d).staged(_variants(spark, d), docs, 5, 12, 4, 4)


@query("references", f"WITH {_bm25_sql()}, {_TOP} SELECT item_id AS q, md5(string_agg('Reference ' || rank || ': [' || trim(coalesce(source, '')) || '] ' || ' (URL: /' || source || '/' || doc_id || ')' || chr(10) || CASE WHEN length(x) > 320 THEN left(x, 320) || '...' ELSE x END, chr(10) || chr(10) ORDER BY rank)) AS h FROM (SELECT top.*, source, trim(replace(text, chr(10), ' ')) AS x FROM top JOIN documents USING (doc_id)) WHERE rank <= 4 GROUP BY item_id")
def references(spark, d):
    from ..functions import answers

    x = _best(spark, d).filter("rank <= 4").join(load(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    line = answers.reference(F.col("rank"), F.col("source"), F.lit(None).cast("string"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")), F.col("text"))
    lines = x.groupBy(F.col("item_id").alias("q")).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lines.select("q", F.md5(F.array_join(F.transform("l", lambda s: s["line"]), "\n\n")).alias("h"))


#: Indexes that queries share, by name.
BUILDS = {"bm25": _index, "bm25_titled": lambda spark, d: _index(spark, d, _TITLED), "inverted_file": _cells, "graph": _links}
