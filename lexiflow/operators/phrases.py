"""Phrases of a dictionary table inside texts, and query expansion with such tables.

Every phrase is anchored at its rarest token, the one that the fewest texts have: texts and phrases meet by that token
in an equi-join, and the phrase is compared around it. So a dictionary of any size meets texts without a product, and
frequent words anchor nothing that has a rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expansion_words as W
from ..shared import written


def _counted(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """token, n of the tokens of phrases: the number of texts (tokens: array) that have it; 0 for one that none has."""
    own, _ = written(phrases.select(F.explode("phrase").alias("token")).distinct(), "phrase-tokens")  # its size is known: few go to the texts
    met = texts.select(F.explode(F.array_distinct("tokens")).alias("token")).join(own, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return own.join(met, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def anchored(texts: DataFrame, phrases: DataFrame, inner: bool = False) -> DataFrame:
    """``phrases`` (phrase: array of tokens) with ``anchor``, the token of the fewest texts, and ``at``, its place from 0;
    ties go to the later place. With ``inner`` neither the first nor the last token is taken. Phrases without such a
    token are left out."""
    places = F.posexplode("phrase").alias("at", "anchor")
    rows = phrases.withColumn("_id", F.xxhash64("phrase"))
    some = rows.select("_id", F.size("phrase").alias("_n"), places).distinct()
    some = some.filter((F.col("at") > 0) & (F.col("at") < F.col("_n") - 1)) if inner else some
    best = some.join(_counted(texts, phrases), some["anchor"] == F.col("token")).groupBy("_id").agg(F.min_by(F.struct("anchor", "at"), F.struct("n", -F.col("at"))).alias("_a"))
    return written(rows.join(best, "_id").select(*phrases.columns, "_a.anchor", "_a.at"), "phrase-anchors")[0]


def matches(texts: DataFrame, phrases: DataFrame, key: str, tokens: Column, longest: bool = True) -> DataFrame:
    """key, start (from 0), phrase and the other columns of ``phrases`` (phrase: array of tokens) for every place of a
    text where a phrase stands.

    With ``longest``, matches inside a longer one go; equal stretches all stay. Null and empty texts, null and empty
    phrases match nothing; phrases may repeat with other columns. Columns of ``phrases`` are not named like ``key``.
    """
    t = texts.select(F.col(f"`{key}`").alias("_key"), tokens.alias("tokens"))
    p = phrases.filter(F.size("phrase") > 0)
    most = p.agg(F.max(F.size("phrase")).alias("_most"))  # one row
    places = t.join(F.broadcast(most), F.lit(True)).select("_key", "tokens", "_most", F.posexplode("tokens").alias("_pos", "anchor"))
    # What a phrase around this token can cover travels with it, not the text.
    low = F.greatest(F.col("_pos") - F.col("_most") + 1, F.lit(0))
    places = places.select("_key", "anchor", "_pos", low.alias("_low"), F.slice("tokens", low + 1, F.col("_pos") - low + F.col("_most")).alias("_around"))
    met = places.join(anchored(t, p), "anchor").withColumn("start", F.col("_pos") - F.col("at"))
    inside = (F.col("start") >= F.col("_low")) & (F.slice("_around", F.greatest(F.col("start") - F.col("_low") + 1, F.lit(1)), F.size("phrase")) == F.col("phrase"))
    found = met.filter(inside).select(F.col("_key").alias(key), "start", *phrases.columns)
    if not longest:
        return found
    end = F.col("start") + F.size("phrase")
    stretches = found.withColumn("_end", end).select(key, "start", "_end").distinct()
    wf = Window.partitionBy(key).orderBy("start", F.desc("_end")).rowsBetween(Window.unboundedPreceding, -1)
    kept = stretches.withColumn("_before", F.max("_end").over(wf)).filter(F.col("_before").isNull() | (F.col("_before") < F.col("_end"))).drop("_before")
    return found.withColumn("_end", end).join(kept, [key, "start", "_end"], "left_semi").drop("_end")


def containing(texts: DataFrame, passages: DataFrame, key: str, text: str, passage_key: str, passage: str) -> DataFrame:
    """key, passage key of every text that has a passage as a substring. Nulls contain nothing and are in nothing; an
    empty passage is in every text.

    A substring of three tokens or more has its inner tokens whole, so texts and passages meet by the rarest of these
    and are compared after that. Shorter passages have none and meet every text; where there are none of them, the
    plan has no such product."""
    split = lambda c: F.split(c, r"\s+")
    p = passages.select(F.col(f"`{passage_key}`").alias("_p"), F.col(f"`{passage}`").alias("_passage")).filter("_passage is not null")
    t = texts.select(F.col(f"`{key}`").alias("_t"), F.col(f"`{text}`").alias("_text")).filter("_text is not null")
    p = p.withColumn("phrase", split(F.col("_passage")))
    anchors = anchored(t.select(split(F.col("_text")).alias("tokens")), p.filter(F.size("phrase") > 2), inner=True).select("_p", "anchor")
    pairs = t.select("_t", F.explode(F.array_distinct(split(F.col("_text")))).alias("anchor")).join(anchors, "anchor").select("_t", "_p").distinct()
    pairs, _ = written(pairs, "phrase-pairs")
    found = pairs.join(t, "_t").join(p.select("_p", "_passage"), "_p").filter(F.contains("_text", F.col("_passage"))).select("_t", "_p").distinct()
    short = p.filter(F.size("phrase") <= 2).select("_p", "_passage")
    if not short.isEmpty():
        found = found.unionByName(t.join(short, F.contains("_text", F.col("_passage"))).select("_t", "_p").distinct())
    return found.select(F.col("_t").alias(key), F.col("_p").alias(passage_key))


# --- query expansion


def dictionary(spark) -> DataFrame:
    """kind, phrase, pattern, extra: the stated dictionaries as a table. ``term`` rows are words or pairs of words,
    ``phrase`` rows expressions with the tokens that anchor them."""
    rows = [("term", k.split(" "), None, x) for k, extra in W.terms().items() for x in extra]
    rows += [("phrase", tokens, f"(?iU){pattern}", x) for pattern, anchors, extra in W.phrases() for tokens in anchors for x in extra]
    return spark.createDataFrame(rows, "kind string, phrase array<string>, pattern string, extra string")


def expansions(questions: DataFrame, words: DataFrame, key: str, text: str, most: int = 30, acronyms: bool = True) -> DataFrame:
    """key, expansions: the normalised text and what a dictionary table (kind, phrase, pattern, extra) adds to it.

    Added are the extras of terms (words, and pairs of words that stand together once words without content are gone),
    of phrases (met by an anchor token, a last ``*`` in it standing for more letters, and then by their pattern), the
    other spelling of the stated pairs, and (``acronyms``) each run of two capitals or more itself, in lower case.
    Order: with a blank first, then short ones of up to five letters and digits, then by length and text, the first
    ``most``. Null and blank texts have none. Keys are unique; rows of questions that no dictionary meets have their own
    text.
    """
    q = questions.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    q = q.withColumn("_s", F.trim(F.regexp_replace(F.lower(F.coalesce("_text", F.lit(""))), r"\s+", " "))).filter("_s <> ''")
    content = F.filter(F.split("_s", r"[^a-z0-9']+"), lambda w: (w != "") & ~w.isin(*W.WITHOUT_CONTENT))
    terms = matches(q, words.filter("kind = 'term'").select("phrase", "extra"), "_key", content, longest=False).select("_key", "extra")
    # Phrases: tokens and, for anchors that end in a star, their beginnings.
    tokens = F.array_distinct(F.filter(F.split("_s", r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    met = words.filter("kind = 'phrase'").select(F.col("phrase")[0].alias("anchor"), "pattern", "extra")
    sizes = F.array_distinct(F.transform(F.filter(F.collect_set("anchor"), lambda a: a.endswith("*")), lambda a: F.length(a) - 1))
    starts = met.agg(sizes.alias("_sizes"))  # one row
    given = q.join(F.broadcast(starts), F.lit(True)).withColumn("_w", F.explode(tokens))
    given = given.select("_key", "_text", F.explode(F.concat(F.array("_w"), F.transform("_sizes", lambda n: F.concat(F.substring("_w", F.lit(1), n), F.lit("*"))))).alias("anchor")).distinct()
    phrases = given.join(met, "anchor").filter(F.regexp_like("_text", F.col("pattern"))).select("_key", F.lower("extra").alias("extra"))
    other = F.array(*[F.when(F.contains("_s", F.lit(a)), F.lit(b)) for pair in W.SPELLINGS for a, b in (pair, pair[::-1])])
    capitals = F.transform(F.regexp_extract_all("_text", F.lit(r"\b([A-Z]{2,}[A-Z0-9]*)\b"), F.lit(1)), lambda a: F.lower(a)) if acronyms else F.array().cast("array<string>")
    own = q.select("_key", F.explode(F.concat(F.array("_s"), F.filter(other, lambda x: x.isNotNull()), capitals)).alias("extra"))
    every = own.unionByName(terms).unionByName(phrases).groupBy("_key").agg(F.collect_set("extra").alias("e"))
    rank = lambda x: F.struct((~x.contains(" ")).alias("a"), (~((F.length(x) <= 5) & x.rlike(r"^[\p{L}\p{N}]+$"))).alias("b"), F.length(x).alias("c"), x.alias("x"))
    ordered = F.slice(F.transform(F.array_sort(F.transform("e", rank)), lambda s: s["x"]), 1, most)
    return every.select(F.col("_key").alias(key), ordered.alias("expansions"))
