"""Line-first document cleaning with native Spark expressions only.

Each ``\\n`` line is judged by punctuation, navigation and boilerplate rules; failing lines go, and a
document that loses too large a share of its words, or fails the base rules on its whole text, is rejected.
One narrow pass: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import GAP, words


@dataclass(frozen=True)
class Rules:
    """Thresholds; shares are of the characters or words of the line or document."""

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    #: A line whose marks (neither letters, digits nor white space) exceed this share of its characters fails.
    max_mark_share: float = 0.18
    #: Lines with this many words or more must hold some sentence punctuation.
    long_line_words: int = 40
    #: A line of at most this many words with a menu separator or a menu word is navigation.
    navigation_words: int = 8
    #: A document that loses a larger share of its words is rejected.
    max_lost_share: float = 0.3
    #: ... unless it lost no more than this many words (a lone licence or rights line).
    free_lost_words: int = 6
    #: A line with two menu separators or more, and this share of its words being separators, is navigation.
    separator_share: float = 0.2


SEPARATORS = ("|", ">", "»", "›", "•")
# Words of menu items and of page furniture.
NAVIGATION = ("home", "login", "log in", "sign in", "sign up", "register", "menu", "next", "previous", "sitemap", "contact us", "about us", "read more", "search", "share", "back to top")
BOILERPLATE = ("cookie policy", "use of cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "lorem ipsum", "enable javascript", "subscribe to our newsletter")


def _line_fails(line: Column, r: Rules) -> Column:
    bare = F.trim(line)
    low = F.lower(bare)
    n = F.size(F.split(bare, GAP))
    marks = F.length(F.regexp_replace(bare, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", ""))
    punctuation = (marks > r.max_mark_share * F.greatest(F.length(bare), F.lit(8))) | ((n >= r.long_line_words) & ~bare.rlike(r"[.!?;:,。！？]"))
    separators = F.size(F.filter(F.split(bare, GAP), lambda w: w.isin(*SEPARATORS)))
    short = (n <= r.navigation_words) & ((separators > 0) | low.rlike(r"^(?:" + "|".join(NAVIGATION) + r")[.!]?$"))
    navigation = short | ((separators >= 2) & (separators >= r.separator_share * n))
    boilerplate = low.rlike("|".join(BOILERPLATE))
    return punctuation | navigation | boilerplate


def assess(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` with a struct column ``quality`` (an input column of that name is replaced).

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_lines,
    lost_words, kept, cleaned_text. Null text counts as empty: no words, base_failed, not kept. Repeated rows
    are judged alike. Lines without a word never fail and never count. Window equality is that of 64-bit hashes.
    """
    r, w = rules, rules.window
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = [c for c in docs.columns if c != "quality"]
    d = docs.select(*[F.col(f"`{c}`") for c in names], t.alias("__q_text"), words(t).alias("__q_words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__q_lines"))
    d = d.withColumn("__q_n", F.size("__q_words").cast("long"))
    d = d.withColumn("__q_word_hash", F.transform("__q_words", lambda x: F.xxhash64(x)))
    d = d.withColumn(
        "__q_windows",
        F.when(
            F.col("__q_n") >= w,
            F.transform(F.sequence(F.lit(1), F.greatest(F.col("__q_n").cast("int") - (w - 1), F.lit(1))), lambda i: F.xxhash64(*[F.element_at("__q_word_hash", i + k) for k in range(w)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    d = d.withColumn("__q_again", F.size(F.array_distinct("__q_windows")) < F.size("__q_windows"))
    d = d.withColumn("__q_sorted", F.when(F.col("__q_again"), F.sort_array(F.transform("__q_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    m = F.size("__q_sorted")
    at = lambda k: F.element_at("__q_sorted", k)
    d = d.withColumn(
        "__q_starts",
        F.when(
            F.col("__q_again"),
            F.sort_array(
                F.transform(
                    F.filter(F.sequence(F.lit(1), m), lambda k: ((k > 1) & (at(F.greatest(k - 1, F.lit(1)))["h"] == at(k)["h"])) | ((k < m) & (at(F.least(k + 1, m))["h"] == at(k)["h"]))),
                    lambda k: at(k)["i"],
                )
            ),
        ),
    )
    q = F.size("__q_starts")
    start = lambda k: F.element_at("__q_starts", k)
    repeat = F.when(
        F.col("__q_again"),
        F.aggregate(F.sequence(F.lit(1), q), F.lit(0).cast("long"), lambda acc, k: acc + F.when(k < q, F.least(F.lit(w), start(F.least(k + 1, q)) - start(k))).otherwise(F.lit(w)).cast("long")),
    ).otherwise(F.lit(0).cast("long"))
    d = d.withColumn("__q_repeat", repeat)
    d = d.withColumn("__q_good", F.filter("__q_lines", lambda x: ~_line_fails(x, r)))
    d = d.withColumn("__q_clean", F.when(F.size("__q_good") == F.size("__q_lines"), F.col("__q_text")).otherwise(F.array_join("__q_good", "\n")))
    left = F.when(F.size("__q_good") == F.size("__q_lines"), F.col("__q_n")).otherwise(F.size(words(F.col("__q_clean"))).cast("long"))
    d = d.withColumn("__q_lost", F.col("__q_n") - left)
    failed = (F.col("__q_n") < r.min_words) | (100 * F.col("__q_repeat") > r.max_repeat_percent * F.col("__q_n"))
    kept = ~failed & ((F.col("__q_lost") <= r.max_lost_share * F.col("__q_n")) | (F.col("__q_lost") <= r.free_lost_words)) & (F.col("__q_n") > F.col("__q_lost"))
    quality = F.struct(
        F.col("__q_n").alias("n_words"),
        F.length(F.array_join("__q_words", "")).cast("long").alias("word_chars"),
        (F.length("__q_text") - F.length(F.regexp_replace("__q_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("n_dup_lines"),
        F.col("__q_repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.size("__q_lines").cast("long").alias("n_lines"),
        (F.size("__q_lines") - F.size("__q_good")).cast("long").alias("n_failed_lines"),
        F.col("__q_lost").alias("lost_words"),
        kept.alias("kept"),
        F.col("__q_clean").alias("cleaned_text"),
    )
    # A generator of one row: filters on the verdict stay above it instead of repeating its expressions below.
    return d.select(*[F.col(f"`{c}`") for c in names], F.explode(F.array(quality)).alias("quality"))


def query(spark, sf_dir: str) -> DataFrame:
    from ._base import table

    q = assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_words")
    return q.select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in fields])


def _oracle(r: Rules = Rules()) -> str:
    gap, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    count = f"len(list_filter(regexp_split_to_array({{}}, '{gap}'), lambda w: w <> ''))"
    separators = f"len(list_filter(regexp_split_to_array(trim(x), '{gap}'), lambda w: w IN ({', '.join(repr(s) for s in SEPARATORS)})))"
    n = f"len(regexp_split_to_array(trim(x), '{gap}'))"
    marks = r"length(regexp_replace(trim(x), '[\p{L}\p{M}\p{N}\x20\x09-\x0D]+', '', 'g'))"
    fails = f"""({marks} > {r.max_mark_share} * greatest(length(trim(x)), 8)
      OR ({n} >= {r.long_line_words} AND NOT regexp_matches(trim(x), '[.!?;:,。！？]'))
      OR ({n} <= {r.navigation_words} AND ({separators} > 0 OR regexp_matches(lower(trim(x)), '^(?:{'|'.join(NAVIGATION)})[.!]?$')))
      OR ({separators} >= 2 AND {separators} >= {r.separator_share} * {n})
      OR regexp_matches(lower(trim(x)), '{'|'.join(BOILERPLATE)}'))"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{gap}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
g AS (SELECT *, list_filter(l, lambda x: NOT {fails}) AS good FROM e),
c AS (SELECT *, CASE WHEN len(good) = len(l) THEN t ELSE array_to_string(good, chr(10)) END AS clean FROM g),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {r.window - 1}], ' ') AS s FROM e, LATERAL (SELECT unnest(range(1, len(w) - {r.window - 2})) AS i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, {r.window})) AS k) GROUP BY doc_id),
f AS (
  SELECT c.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, (len(l) - len(good))::BIGINT AS n_failed_lines, (len(w) - {count.format('clean')})::BIGINT AS lost_words
  FROM c LEFT JOIN cov ON c.doc_id = cov.doc_id),
b AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND (lost_words <= {r.max_lost_share} * n_words OR lost_words <= {r.free_lost_words}) AND n_words > lost_words AS kept FROM b
"""


ORACLE = _oracle()
