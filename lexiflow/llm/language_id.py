"""Language identification, word first: known words are scored by their log frequency per language, an unseen word by
its longest known character n-grams, falling back to shorter ones.

Counts cover all training rows: words are counted per language, n-grams over the counted words. The model keeps the
most frequent ones, whose number is a parameter, so what tasks get has a bound; scoring is one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialize, table, tidy

#: A language that no text of this kind can be said to have.
UNKNOWN = "und"
#: A word: a letter, then letters and marks.
WORD = r"\p{L}[\p{L}\p{M}]*"
#: Entries that a task counts before it hands the counts on.
HELD = 200_000


@dataclass(frozen=True)
class Fit:
    """Size of the model and its smoothing. Languages share ``words``, and ``grams`` of every length, evenly: a language
    has its words down to the lowest count with which they fit."""

    words: int = 120_000
    grams: int = 40_000
    longest: int = 4
    #: Most frequent languages by rows, ties by name; labels beyond are not learned.
    languages: int = 256
    smoothing: float = 0.5
    #: Weight of an n-gram length against the next longer one.
    backoff: float = 0.4


@dataclass(frozen=True)
class Model:
    """Languages, and rows of ``weights`` by word and by n-gram: log frequency per language, less the row's mean."""

    languages: list[str]
    prior: np.ndarray
    rows: dict[str, int]
    grams: list[dict[str, int]]
    weights: np.ndarray
    backoff: float

    def unseen(self, word: str) -> tuple[list[int], float]:
        """Rows of the word's known n-grams of the greatest length that has any, and the weight of each."""
        w = f" {word} "
        for n in range(len(self.grams), 0, -1):
            known = self.grams[n - 1]
            found = [known[g] for i in range(len(w) - n + 1) if (g := w[i : i + n]) in known]
            if found:
                return found, self.backoff ** (len(self.grams) - n) / len(found)
        return [], 0.0


def finder():
    """Function from a lower-cased text to its words. Texts of Latin letters only, which have no marks, take a class of
    their own that is found faster."""
    import re

    import regex

    ascii, latin, beyond = re.compile("[A-Za-z]+").findall, re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+").findall, re.compile("[^\0-ɏ]").search
    whole = regex.compile(WORD).findall
    return lambda text: ascii(text) if text.isascii() else whole(text) if beyond(text) else latin(text)


def _word_counts(batches):
    """(lang, text) to lang, token, n."""
    from collections import Counter

    find = finder()
    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(lang, Counter()).update(find(text.as_py().lower()))
            if sum(map(len, held.values())) > HELD:
                yield from _told(held)
    yield from _told(held)


def _told(held):
    import pyarrow as pa

    for lang, c in held.items():
        tokens = list(c)
        for at in range(0, len(tokens), 50_000):
            part = tokens[at : at + 50_000]
            yield pa.record_batch({"lang": pa.array([lang] * len(part), pa.string()), "token": pa.array(part, pa.string()), "n": pa.array([c[t] for t in part], pa.int64())})
    held.clear()


def _gram_counts(longest: int):
    """(lang, token, n) to lang, token, n of the n-grams of the words between blanks, of every length to ``longest``."""

    def run(batches):
        from collections import Counter

        held: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c, w = held.setdefault(lang, Counter()), f" {word} "
                for k in range(1, longest + 1):
                    for i in range(len(w) - k + 1):
                        c[w[i : i + k]] += n
                size += 1
                if size % 256 == 0 and sum(map(len, held.values())) > HELD:
                    yield from _told(held)
        yield from _told(held)

    return run


def _frequent(counts: DataFrame, by: list[str], most: int) -> DataFrame:
    """Rows (lang, token, n) of the tokens that some language has among its ``most`` most frequent: those down to the
    lowest count with which they are no more than ``most``. A histogram of counts finds it, so no language meets in
    one task."""
    levels = counts.groupBy("lang", *by, "n").agg(F.count("*").alias("_tokens"))
    w = Window.partitionBy("lang", *by).orderBy(F.desc("n"))
    lowest = levels.withColumn("_upto", F.sum("_tokens").over(w)).filter(F.col("_upto") <= most).groupBy("lang", *by).agg(F.min("n").alias("_lowest"))
    kept = counts.join(F.broadcast(lowest), ["lang", *by]).filter(F.col("n") >= F.col("_lowest")).select("token").distinct()
    return counts.join(kept, "token").select("lang", *by, "token", "n")


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", p: Fit = Fit()) -> Model:
    """The model of labelled rows. Rows with a null text or label teach nothing; repeated rows count again. Without
    any row the model has no language."""
    spark = rows.sparkSession
    known = rows.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.languages).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros(0), {}, [], np.zeros((0, 0), np.float32), p.backoff)
    known = known.filter(F.col("lang").isin(languages))
    schema = "lang string, token string, n long"
    total = lambda c: c.groupBy("lang", "token").agg(F.sum("n").alias("n"))
    words = materialize(total(known.mapInArrow(tidy(_word_counts), schema)), "language-words")
    grams = materialize(total(words.mapInArrow(tidy(_gram_counts(p.longest)), schema)).withColumn("size", F.length("token")), "language-grams")

    at = {c: i for i, c in enumerate(languages)}
    share = len(languages)
    blocks, tables = [], []
    for kept, sums in [
        (_frequent(words, [], p.words // share), words),
        *[(_frequent(grams.filter(F.col("size") == k), ["size"], p.grams // share), grams.filter(F.col("size") == k)) for k in range(1, p.longest + 1)],
    ]:
        # Bounded: the kept tokens times the languages.
        found = kept.toArrow().sort_by("token")
        whole = np.zeros(len(languages))
        for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect():
            whole[at[r["lang"]]] = r["n"]
        rank = {t: i for i, t in enumerate(dict.fromkeys(found.column("token").to_pylist()))}
        c = np.full((len(rank), len(languages)), p.smoothing)
        np.add.at(c, (np.array([rank[t] for t in found.column("token").to_pylist()], int), np.array([at[x] for x in found.column("lang").to_pylist()], int)), found.column("n").to_numpy())
        logs = np.log(c / (whole + p.smoothing * max(1, len(rank))))
        offset = sum(map(len, blocks))
        blocks.append((logs - logs.mean(1, keepdims=True)).astype(np.float32))
        tables.append({t: offset + i for t, i in rank.items()})
    prior = np.array([next(r["count"] for r in sizes if r["lang"] == x) for x in languages], float)
    return Model(languages, np.log(prior / prior.sum()), tables[0], tables[1:], np.concatenate(blocks), p.backoff)


def scorer(model: Model):
    """Function from a text to its language and that language's share of the likelihood."""
    from collections import Counter
    from itertools import repeat

    find, weights = finder(), model.weights.astype(np.float64)
    seen: dict[str, tuple[list[int], float]] = {}

    def score(text: str | None) -> tuple[str, float]:
        words = Counter(find((text or "").lower()))
        if not words or not model.languages:
            return UNKNOWN, 0.0
        rows = np.fromiter(map(model.rows.get, words, repeat(-1)), np.int64, len(words))
        times = np.fromiter(words.values(), np.float64, len(words))
        known = rows >= 0
        total = model.prior + times[known] @ weights[rows[known]]
        if not known.all():
            names, at, shares = list(words), [], []
            for j in np.flatnonzero(~known).tolist():
                word = names[j]
                found = seen.get(word)
                if found is None:
                    if len(seen) > 50_000:
                        seen.clear()
                    found = model.unseen(word)
                    if len(word) <= 64:
                        seen[word] = found
                if found[0]:
                    at += found[0]
                    shares += [times[j] * found[1]] * len(found[0])
            if at:
                total = total + np.array(shares) @ weights[at]
        best = int(total.argmax())
        return model.languages[best], round(float(1 / np.exp(total - total[best]).sum()), 6)

    return score


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with lang_pred and score (0 to 1): its language and that one's
    share of the likelihood. A null text, or one without a letter, is ``und`` with 0, as is any text for a model
    without languages. Ties go to the first language by code points. Repeated rows are scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        score = scorer(shared.value)
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.record_batch([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    from pyspark.sql import types as T

    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(tidy(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """A null id is neither held out nor learned from."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), (rest != 2).alias("learned"), "lang", "text")
    return predict(docs, fit(docs.filter("learned")), ["doc_id", "held_out"])
