"""Retrieval for tables of query variants: sparse, dense or both, fused, cut to sections and reranked.

``Config`` (in ``index``) brings the tokeniser, the encoder and the scorer of pairs; nothing here fixes a model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from . import vectors as V
from .index import Bm25, Config
from .retrieval import coarse_sections, rerank_head, top_k


def variants(questions: DataFrame, key: str, text: Column, options: Column | None = None, expansions: Column | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """q, variant, kind, weight, text: the question itself (``base``), the question with each of its options (map;
    ``option``) and with each of its expansions (array; ``expansion``). Ids are the key, kind and number. Null and blank
    questions, options and expansions give none."""
    weights = weights or {}
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    row = lambda kind, n, t: F.struct(F.lit(kind).alias("kind"), n.cast("string").alias("n"), F.lit(float(weights.get(kind, 1.0))).alias("weight"), t.alias("text"))
    q = questions.select(F.col(f"`{key}`").alias("q"), F.trim(text).alias("_t"), *([options.alias("_o")] if options is not None else []), *([expansions.alias("_e")] if expansions is not None else [])).filter(~blank(F.col("_t")))
    rows = [F.array(row("base", F.lit(0), F.col("_t")))]
    if options is not None:
        listed = F.filter(F.array_sort(F.map_entries("_o")), lambda e: ~blank(e["value"]))
        rows.append(F.coalesce(F.transform(listed, lambda e: row("option", e["key"], F.concat(F.col("_t"), F.lit("\nOption: "), F.trim(e["value"])))), F.array()))
    if expansions is not None:
        rows.append(F.coalesce(F.transform(F.filter("_e", lambda x: ~blank(x)), lambda x, i: row("expansion", i, F.concat(F.col("_t"), F.lit(" "), x))), F.array()))
    v = q.select("q", F.explode(F.concat(*rows)).alias("v"))
    return v.select("q", F.concat_ws("_", F.col("q").cast("string"), "v.kind", "v.n").alias("variant"), "v.kind", "v.weight", "v.text")


@dataclass(frozen=True)
class Retriever:
    """A BM25 index, vectors of the same documents (id, v) and the plug points; either may be missing."""

    config: Config
    bm25: Bm25 | None = None
    vectors: DataFrame | None = None

    def lists(self, asked: DataFrame, k: int, mode: str = "hybrid") -> DataFrame:
        """q, variant, weight, source (sparse or dense), id, score, rank: the ``k`` best of every variant (q, variant,
        weight, text) by each index that the mode names. A variant without a token or a usable vector has none."""
        if mode not in ("sparse", "dense", "hybrid"):
            raise ValueError(mode)
        found = []
        told = asked.select("q", "variant", "weight")
        if mode != "dense":
            s = self.bm25.top(asked.select("variant", "text"), "variant", self.config.tokens(F.col("text")), k, self.config.k1, self.config.b)
            found.append(s.select("variant", F.lit("sparse").alias("source"), F.col(self.bm25.key).alias("id"), "score", "rank"))
        if mode != "sparse":
            # Vectors are asked for by number; the numbers stay with the variants.
            numbered = asked.select("variant", F.xxhash64("variant").alias("n"), self.config.encode(F.col("text")).alias("qv"))
            d = V.dense(numbered.select(F.col("n").alias("q"), "qv"), self.vectors, k, "cosine")
            found.append(d.withColumnRenamed("q", "n").join(numbered.select("n", "variant"), "n").select("variant", F.lit("dense").alias("source"), "id", "score", "rank"))
        lists = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return lists.join(told, "variant").select("q", "variant", "weight", "source", "id", "score", "rank")

    def search(self, asked: DataFrame, k: int, mode: str = "hybrid", depth: int = 0, smooth: int = 60) -> DataFrame:
        """q, id, rrf, votes, rank of the ``k`` best documents of each question: all its variants' lists of ``depth`` (or
        ``k``) hits, fused by weighted reciprocal ranks; votes count the lists with a document. Ties go to the smaller
        id."""
        lists = self.lists(asked, depth or k, mode)
        fused = lists.groupBy("q", "id").agg(F.round(F.sum(F.col("weight") / (smooth + F.col("rank"))), 9).alias("rrf"), F.count("*").alias("votes"))
        return top_k(fused, ["q"], [F.desc("rrf"), F.asc("id")], k)

    def staged(self, asked: DataFrame, docs: DataFrame, k: int, depth: int, sections: int, head: int, mode: str = "hybrid") -> DataFrame:
        """q, id, rank, new_rank: fused hits of ``depth``, cut to the ``sections`` best sections of each question, the
        first ``head`` sorted anew by the scorer of pairs, the first ``k`` given; docs (id, section, text), questions'
        own texts are the ``base`` variants. Documents without a section go with the cut."""
        hits, _ = written(self.search(asked, depth, mode).drop("rank"), "staged")  # few: no text is shuffled for them
        hits = hits.join(docs.select("id", "section", "text"), "id").withColumn("score", F.col("rrf"))
        fine = hits.join(coarse_sections(hits.filter("section is not null"), sections), ["q", "section"], "left_semi")
        fine = fine.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rrf"), "id")))
        fine = fine.join(asked.filter("kind = 'base'").select("q", F.col("text").alias("question")), "q")
        pair = F.round(self.config.score_pair(F.col("question"), F.col("text")), 9)
        return rerank_head(fine, pair, head).filter(F.col("new_rank") <= k).select("q", "id", "rank", "new_rank")
