"""Structure splitting and chunking: generators whose rows depend on order inside one document.

Everything but sentence packing is native: arrays of lines, tokens or sentences per document and ``posexplode``, so
no document needs a shuffle before its rows exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, strip

# Headings of chapters.
CHAPTER = r"^(Chapter\s+[\dIVX]+[\.:]?\s+.+|CHAPTER\s+[\dIVX]+[\.:]?\s+.+|[IVX]+[\.:]\s+.+|\d+[\.:]\s+.+)$"

#: A text of digits and of characters that are no part of a word, in any script.
ONLY_MARKS = r"^[^\p{L}\p{Nl}\p{No}_]+$"


def token_count(text: Column) -> Column:
    """A quarter of the characters: the counter where no tokenizer is given."""
    return F.floor(F.length(text) / 4).cast("int")


# Headings of sections, of the levels two to five.
SECTIONS = (r"^[A-Z][A-Z\s]{5,}$", r"^[A-Z][a-z]+\s+[A-Z][a-z]+\s+[A-Z][a-z]+.*$", r"^\d+\.\d+\s+.+$", r"^\d+\.\d+\.\d+\s+.+$")


def section_level(line: Column) -> Column:
    """Level of a heading, null for any other line: by the stated forms 2 to 5, else capitals 2 and title case of three
    words or more 3. Headings have up to 100 characters."""
    s = F.trim(line)
    n = F.size(F.split(s, r"\s+"))
    capitals = (F.upper(s) == s) & (F.lower(s) != s) & (n >= 2) & (F.length(s) < 80)
    titled = (F.initcap(s) == s) & s.rlike("^[A-Z]") & (n >= 3) & (F.length(s) < 80) & ~s.rlike(r"\d") & ~s.rlike(r"[.,;:]$")
    level = F.lit(None).cast("int")
    for value, told in ((3, titled), (2, capitals), *reversed([(i + 2, s.rlike(p)) for i, p in enumerate(SECTIONS)])):
        level = F.when(told, value).otherwise(level)
    return F.when((s != "") & (F.length(s) <= 100), level)


def is_section(line: Column) -> Column:
    """Headings: capitals, title case of three words or more, or numbered, up to 100 characters."""
    return section_level(line).isNotNull()


def split_at(docs: DataFrame, key: str, text: Column, is_heading, first: Column) -> DataFrame:
    """key, ordinal, heading, body of the stretches between headings; what stands before the first is under ``first``.
    Empty bodies go; a null text has none. One pass over a document's lines: no shuffle."""
    rows = docs.select(key, lines(text).alias("_l"), first.alias("_f"))
    at = F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: is_heading(F.element_at("_l", i)))
    rows = rows.withColumn("_at", F.concat(F.array(F.lit(0)), at))
    body = lambda p, k: F.array_join(F.slice("_l", p + 1, F.coalesce(F.get("_at", k + 1), F.size("_l") + 1) - p - 1), "\n")
    parts = F.transform("_at", lambda p, k: F.struct(k.cast("long").alias("ordinal"), F.when(p == 0, F.col("_f")).otherwise(F.trim(F.element_at("_l", F.greatest(p, F.lit(1))))).alias("heading"), F.regexp_replace(body(p, k), r"^\s+|\s+$", "").alias("body")))
    return rows.select(key, F.explode(parts).alias("p")).select(key, "p.ordinal", "p.heading", "p.body").filter("body <> ''")


def paragraphs(docs: DataFrame, key: str, text: Column, least_words: int = 3) -> DataFrame:
    """key, pos, paragraph: parts between blank lines, on one line, of ``least_words`` or more, that hold a letter or a
    number of any script beside digits and marks. A null text has none."""
    parts = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n")).alias("pos", "p"))
    parts = parts.withColumn("paragraph", F.replace(strip(F.col("p")), F.lit("\n"), F.lit(" ")))
    return parts.filter((F.size(F.filter(F.split("paragraph", r"\s+"), lambda w: w != "")) >= least_words) & ~F.col("paragraph").rlike(ONLY_MARKS)).select(key, "pos", "paragraph")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")


def char_windows(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    step = max(1, size - overlap)
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    return docs.filter(F.length(text) > 0).select(key, text, F.posexplode(at).alias("pos", "start")).select(key, "pos", F.col(text).substr(F.col("start"), F.lit(size)).alias("chunk"))


def token_windows(docs: DataFrame, key: str, tokens: Column, size: int, overlap: int) -> DataFrame:
    """Windows of tokens; the last is the first that reaches the end."""
    step = max(1, size - overlap)
    d = docs.select(key, tokens.alias("t")).filter("size(t) > 0")
    n = F.greatest(F.ceil((F.size("t") - size) / step), F.lit(0)).cast("int")
    return d.select(key, "t", F.explode(F.sequence(F.lit(0), n)).alias("pos")).select(key, "pos", F.array_join(F.slice("t", F.col("pos") * step + 1, F.lit(size)), " ").alias("chunk"))


def sentence_pack(text: Column, most: int, counter=token_count) -> Column:
    """Sentences of a long paragraph packed to chunks of up to ``most`` tokens; a longer sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))
    flush = lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(F.array_join(a["held"], " ")))).otherwise(a["out"])

    def step(a: Column, s: Column) -> Column:
        over = a["n"] + counter(s) > most
        return F.struct(F.when(over, flush(a)).otherwise(a["out"]).alias("out"), F.when(over, F.array(s)).otherwise(F.concat(a["held"], F.array(s))).alias("held"), F.when(over, counter(s)).otherwise(a["n"] + counter(s)).alias("n"))

    return F.aggregate(F.split(text, r"(?<=[.!?])\s+"), start, step, flush)


def pack(units: Column, least: int, target: int, most: int, counter=token_count) -> Column:
    """Greedy packing of an array of paragraphs to chunks of (least, target, most) tokens, joined by a blank line, as a
    fold: a unit over ``most`` flushes whatever is held and is split by sentences; one that would pass ``most`` flushes
    only if ``least`` is held, else the chunk overflows; reaching ``target`` flushes; a last rest under ``least`` is
    dropped."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))
    none = F.array().cast("array<string>")
    state = lambda out, held, n: F.struct(out.alias("out"), held.alias("held"), n.alias("n"))
    flushed = lambda a, ok: F.when(ok & (F.size(a["held"]) > 0), F.concat(a["out"], F.array(F.array_join(a["held"], "\n\n")))).otherwise(a["out"])

    def step(a: Column, u: Column) -> Column:
        n = counter(u)
        full = (a["n"] + n > most) & (a["n"] >= least)
        held = F.when(full, F.array(u)).otherwise(F.concat(a["held"], F.array(u)))
        total = F.when(full, n).otherwise(a["n"] + n)
        out = flushed(a, full)
        grown = F.when(total >= target, state(F.concat(out, F.array(F.array_join(held, "\n\n"))), none, F.lit(0))).otherwise(state(out, held, total))
        return F.when(n > most, state(F.concat(flushed(a, F.lit(True)), sentence_pack(u, most, counter)), none, F.lit(0))).otherwise(grown)

    return F.aggregate(units, start, step, lambda a: flushed(a, a["n"] >= least))


def sentence_windows(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Chunks of whole sentences of up to ``size`` characters, each beginning with the last whole words of the one
    before it (of its last ``overlap`` characters); a text that fits is one chunk, an empty one none."""
    trimmed = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(a: Column, s: Column) -> Column:
        tail = F.right(a["held"], F.lit(overlap)) if overlap > 0 else F.lit("")
        after = F.regexp_replace(tail, r"^[^ ]* ", "")  # unchanged without a blank
        begun = F.regexp_replace(F.concat(after, F.lit(" "), s), r"^\s+|\s+$", "") if overlap > 0 else s
        return (
            F.when(a["held"] == "", F.struct(a["out"].alias("out"), s.alias("held")))
            .when(F.length(a["held"]) + 1 + F.length(s) <= size, F.struct(a["out"].alias("out"), F.concat(a["held"], F.lit(" "), s).alias("held")))
            .otherwise(F.struct(F.concat(a["out"], F.array(a["held"])).alias("out"), begun.alias("held")))
        )

    folded = F.aggregate(trimmed, start, step, lambda a: F.when(a["held"] != "", F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(folded)


def passage_ids(key: Column, pos: Column) -> Column:
    """The id itself for the first passage of a document, with #1, #2, ... behind it for the next."""
    return F.when(pos == 0, key.cast("string")).otherwise(F.concat_ws("#", key.cast("string"), pos.cast("string")))


def book_sections(books: DataFrame, key: str, text: Column) -> DataFrame:
    """key, chapter, section, n, body: a book's chapters, each split at its section headings; n counts a book's sections."""
    chapters = split_at(books, key, text, lambda line: F.trim(line).rlike(CHAPTER), F.lit("Introduction")).select(F.struct(F.col(key).alias("book"), F.col("ordinal").alias("chapter_no"), F.col("heading").alias("chapter")).alias("at"), "body")
    rows = split_at(chapters, "at", F.col("body"), is_section, F.lit("")).select(F.col("at.book").alias(key), F.col("at.chapter_no"), F.col("at.chapter"), "ordinal", F.col("heading").alias("section"), "body")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("chapter_no", "ordinal")) - 1).drop("chapter_no", "ordinal")


def chunk_issues(chunks: DataFrame, key: str, tokens: str, least: int, most: int, first: int = 10) -> DataFrame:
    """key, issue of the ``first`` chunks by key that are over the most or under the least tokens (a report)."""
    issue = F.when(F.col(tokens) > most, "over").when(F.col(tokens) < least, "under")
    return chunks.select(key, issue.alias("issue")).filter("issue is not null").orderBy(key).limit(first)


def with_overlap(chunks: DataFrame, by: list[str], order: str, text: str, ratio: float, words_per_token: int = 3) -> DataFrame:
    """``text`` with the tail of the group's chunk before it in front."""
    before = F.lag(text).over(Window.partitionBy(*by).orderBy(order))
    words = F.filter(F.split(before, r"\s+"), lambda w: w != "")
    n = (F.floor(token_count(before) * ratio) * words_per_token).cast("int")
    tail = F.when(n > 0, F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))), " "))
    return chunks.withColumn("overlapped", F.concat_ws(" ", tail, text))
