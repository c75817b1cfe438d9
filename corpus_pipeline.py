"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and read again as
the next stage's documents. All but the last return the columns of documents, further ones and those named like an
operator's result included. Null and empty texts: the quality rules reject them; the other stages, given such rows,
keep them (near duplicates), drop them as left without a word (passages, mix), or encode them to no ids. Null ids are
in no group of near duplicates and count as the greatest in passages. Rows that repeat an id and its text are one
document to near duplicates. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import bpe, jaccard_join, mixing, quality_rules, suffix_dedup
from lexiflow.llm._base import few, materialize, table

# Near duplicates of this pipeline: five-word shingles, similarity 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars (if there) following the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _aside(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column of this name, any case, called otherwise while an operator puts its result there."""
    return docs.select(*[F.col(f"`{c}`").alias(f"__p_{c}") if c.lower() == name else F.col(f"`{c}`") for c in docs.columns])


def _back(docs: DataFrame, out: DataFrame, name: str) -> DataFrame:
    for c in docs.columns:
        if c.lower() == name:
            out = out.drop(name).withColumnRenamed(f"__p_{c}", c)
    return _like(docs, out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their failing lines gone."""
    judged = quality_rules.assess(_aside(docs, "quality")).filter("quality.kept")
    return _back(docs, judged.withColumn("text", F.col("quality.cleaned_text")), "quality")


def _texts_of_one_id(docs: DataFrame) -> DataFrame | None:
    """doc_id, digest, key: a number that no document has for each further text of an id; None where ids have one text."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))
    several = texts.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).filter("first <> last").select("doc_id", "first")
    further = materialize(texts.join(several, "doc_id").filter("digest <> first").select("doc_id", "digest").distinct(), "further-texts")
    if further.isEmpty():
        return None
    low, high = texts.agg(F.min("doc_id"), F.max("doc_id")).first()
    n = F.monotonically_increasing_id()
    key = F.lit(high) + 1 + n if high < 1 << 62 else F.lit(low) - 1 - n
    return materialize(further.withColumn("key", key), "text-numbers")


def _digest():
    return F.coalesce(F.sha2("text", 256), F.lit("null"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar documents; copies of a row (its id and text) go as
    well, the one with the least other columns, as JSON, stays. Documents without a word or an id are in no group and
    stay. Texts that share an id are separate documents."""
    further, key = _texts_of_one_id(docs), "__p_key"
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    if further is not None:
        numbers = further.select(F.col("doc_id").alias(key), F.col("digest").alias("__p_digest"), F.col("key").alias("__p_number"))
        keyed = keyed.withColumn("__p_digest", _digest()).join(numbers, [key, "__p_digest"], "left").withColumn(key, F.coalesce("__p_number", key)).drop("__p_digest", "__p_number")
    found = jaccard_join.similar(keyed, SIMILAR_PERCENT, SHINGLE_WORDS, key=key).select(F.col("doc_id").alias(key), "component_id")
    if further is not None:  # the least by id, which a number does not tell
        found = materialize(found.filter(f"{key} is not null").distinct(), "found")
        ids = found.join(further.select(F.col("key").alias(key), F.col("doc_id").alias("__p_id")), key, "left")
        least = ids.groupBy("component_id").agg(F.min_by(key, F.struct(F.coalesce("__p_id", key), key)).alias("__p_least"))
        found = found.join(least, "component_id").select(key, F.col("__p_least").alias("component_id"))
    # Texts are not shuffled while the ids are few.
    gone = few(materialize(found.filter(f"component_id <> {key}").select(key).distinct(), "near-gone"))
    left = keyed.join(gone, key, "left_anti")
    worded = left.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    repeated = worded.groupBy(key).agg(F.count("*").alias("n")).filter(f"n > 1 and {key} is not null").select(key)
    repeated = few(materialize(repeated, "near-repeated"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = left.join(repeated, key).groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("__p_row")).select("__p_row.*")
    return _like(docs, left.join(repeated, key, "left_anti")).unionByName(_like(docs, first))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those left without a word go. Bytes of a cut
    character go with the cut."""
    cut = suffix_dedup.remove_repeats(_aside(docs, "repeats"))
    return _back(docs, cut.withColumn("text", _decoded()).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")), "repeats")


#: A whole UTF-8 character, bytes standing as Latin-1 characters.
UTF8 = r"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|\xED[\x80-\x9F][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"


def _decoded():
    """The kept bytes as text; where bytes were removed, incomplete characters at the cuts are dropped."""
    kept = F.col("repeats.kept")
    whole = F.encode(F.regexp_replace(F.decode(kept, "ISO-8859-1"), f"(?s)({UTF8})|.", "$1"), "ISO-8859-1").cast("string")
    return F.when(F.col("repeats.n_removed") > 0, F.when(F.is_valid_utf8(kept), kept.cast("string")).otherwise(whole)).otherwise(F.col("text"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, whole each time."""
    return _back(docs, mixing.take(mixing.mix(_aside(docs, "mix"), F.array("source")), whole_only=True), "mix")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian 32-bit integers), their number, and the digest of the decoded text."""
    import public_tokenizers

    spec = bpe.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    out = bpe.round_trip(docs.select("doc_id", "source", "text"), spec)
    return out.select("doc_id", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", passages),
    ("source_mix", mixture),
    ("bpe_tokens", tokens),
]

#: Components, suffix arrays and merges have no SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
