"""Parsers of options, answers, reasoning and rewritten queries; sanitisers of terms. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, strip

# Wordings of an agent's answer, in the order in which they are tried; the last match of the first counts.
AGENT_ANSWERS = (
    r"(?:correct\s+answer\s+is\s+)([ABCD])\)",
    r"(?:answer\s+is\s+)([ABCD])\)",
    r"(?:final\s+answer\s+is\s+)([ABCD])\)",
    r"(?:answer[:\s]+)([ABCD])\b",
    r"(?:select|choose)\s+([ABCD])\b",
    r"(?:option|choice)\s+([ABCD])\b",
    r"\b([ABCD])\s*is\s*(?:the\s*)?correct",
    r"\b([ABCD])\s*is\s*(?:the\s*)?best",
    r"(?:should\s+be\s+)([ABCD])\b",
    r"(?:answer[:\s]+)([ABCD])\)",
    r"(?:answer[:\s]+)([ABCD])",
    r"^([ABCD])\)",
    r"answer:\s*([ABCD])",
    r"select\s*([ABCD])",
    r"\b([ABCD])\b(?=\s*(?:\.|$))",
    r"\b([ABCD])\b",
)
# What no query expansion may hold, and the abbreviations that are written out.
BANNED = ("answer", "true/false", "select one", "all are true", "except")
ABBREVIATIONS = {
    "ecg": "electrocardiogram",
    "ekg": "electrocardiogram",
    "mri": "magnetic resonance imaging",
    "ct": "computed tomography",
    "bp": "blood pressure",
    "hr": "heart rate",
    "htn": "hypertension",
    "dm": "diabetes mellitus",
    "mi": "myocardial infarction",
    "copd": "chronic obstructive pulmonary disease",
}
# Words that speak for a context.
CONTEXT_WORDS = "treatment diagnosis symptoms disease condition therapy medication drug clinical patient medical syndrome anatomy physiology pathology surgery procedure".split()


def _upper(c: Column) -> Column:
    return F.when(c != "", F.upper(c))


def options(named: Column, flat: tuple[Column, ...] = ()) -> Column:
    """Options by letter: those of a map whose key is a letter A-E and whose text is not empty, trimmed; without a map,
    the flat columns as A, B, C, ... with null as the empty text; without either, an empty map."""
    entries = F.filter(F.map_entries(named), lambda e: F.upper(e["key"]).rlike("^[A-E]$") & (F.coalesce(e["value"], F.lit("")) != ""))
    by_map = F.map_from_entries(F.transform(F.array_sort(entries), lambda e: F.struct(F.upper(e["key"]), F.trim(e["value"]))))
    pairs = [x for i, c in enumerate(flat) for x in (F.lit("ABCDE"[i]), F.trim(F.coalesce(c, F.lit(""))))]
    any_flat = F.lit(False)
    for c in flat:
        any_flat = any_flat | c.isNotNull()
    none = F.create_map().cast("map<string,string>")
    return F.when(named.isNotNull(), by_map).when(any_flat, F.create_map(*pairs) if pairs else none).otherwise(none)


def dialect(named: Column, first_flat: Column) -> Column:
    """Which layout a record has, by the columns that it fills."""
    return F.when(named.isNotNull(), "mcq_dict").when(first_flat.isNotNull(), "mcq_flat").otherwise("unknown")


def agent_answer(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(*[F.upper(F.get(F.reverse(F.regexp_extract_all(t, F.lit("(?im)" + p), 1)), F.lit(0))) for p in AGENT_ANSWERS])


def tuned_answer(text: Column, tail: int = 400) -> Column:
    """The last ``Answer: X`` of the text, else the first single capital A-D among its last characters."""
    last = F.get(F.reverse(F.regexp_extract_all(text, F.lit(r"(?i)\bAnswer\s*[:：]\s*([ABCD])\b"), 1)), F.lit(0))
    return F.coalesce(F.upper(last), _upper(F.regexp_extract(F.right(text, F.lit(tail)), r"\b([ABCD])\b", 1)))


def tuned_reasoning(text: Column) -> Column:
    """The text between reasoning tags; else from the last open tag, or the last response heading, to the answer."""
    paired = F.regexp_extract(text, r"(?is)<Reasoning>(.*?)</Reasoning>", 1)
    to_answer = lambda c: F.regexp_replace(c, r"(?is)\bAnswer\s*[:：].*$", "")
    opened, headed = F.substring_index(text, "<Reasoning>", -1), F.substring_index(text, "### Response:", -1)
    return (
        F.when(text.rlike(r"(?is)<Reasoning>.*?</Reasoning>"), F.trim(paired))
        .when(text.contains("<Reasoning>"), F.trim(to_answer(opened)))
        .when(text.contains("### Response:"), F.trim(to_answer(headed)))
    )


def lenient_answer(text: Column, allowed: str = "ABCD") -> Column:
    """``Answer: X`` if X is allowed, else the first character that is, any case."""
    named = F.regexp_extract(text, r"(?i)\banswer\s*[:：]?\s*([A-Z])\b", 1)
    return F.coalesce(F.when(F.upper(named).rlike(f"^[{allowed}]$"), F.upper(named)), _upper(F.regexp_extract(text, f"(?i)([{allowed}])", 1)))


def think(text: Column) -> Column:
    """A struct of the lines between think tags and the letter of the last line that states the correct answer."""
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("answer"))

    def step(a: Column, line: Column) -> Column:
        bare = F.trim(line)
        letter = F.element_at(F.split(F.trim(F.substring_index(bare, ")", 1)), r"\s+"), -1)
        return (
            F.when(bare == "<think>", F.struct(F.lit(True).alias("on"), a["lines"].alias("lines"), a["answer"].alias("answer")))
            .when(bare == "</think>", F.struct(F.lit(False).alias("on"), a["lines"].alias("lines"), a["answer"].alias("answer")))
            .when(a["on"], F.struct(a["on"].alias("on"), F.concat(a["lines"], F.array(line)).alias("lines"), a["answer"].alias("answer")))
            .when(line.startswith("The correct answer is"), F.struct(a["on"].alias("on"), a["lines"].alias("lines"), letter.alias("answer")))
            .otherwise(a)
        )

    return F.aggregate(F.split(F.trim(text), "\n"), start, step, lambda a: F.struct(F.trim(F.array_join(a["lines"], "\n")).alias("thinking"), a["answer"].alias("answer")))


REWRITTEN = "specific_query string, broad_query string, mechanism_query string, key_concepts array<string>"


def rewritten(text: Column) -> Column:
    """Rewritten queries from JSON, in a markdown fence or not; what is no JSON object is the specific query (its first
    500 characters) with ``parse_error`` set."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    bare = F.regexp_replace(F.when(fenced != "", fenced).otherwise(text), r"```\s*", "")
    sound = F.coalesce(F.expr("true") & F.get_json_object(bare, "$").startswith("{"), F.lit(False))
    read = F.from_json(bare, REWRITTEN)
    field = lambda n: F.when(sound, read[n])
    return F.struct(
        F.when(sound, F.coalesce(read["specific_query"], F.lit(""))).otherwise(F.substring(bare, 1, 500)).alias("specific_query"),
        F.coalesce(field("broad_query"), F.lit("")).alias("broad_query"),
        F.coalesce(field("mechanism_query"), F.lit("")).alias("mechanism_query"),
        F.coalesce(field("key_concepts"), F.array().cast("array<string>")).alias("key_concepts"),
        (~sound).alias("parse_error"),
    )


def retrieval_query(r: Column, strategy: str = "specific") -> Column:
    """The query of a strategy: specific, broad, mechanism, combined (all three) or concepts."""
    if strategy == "combined":
        return F.array_join(F.filter(F.array(r["specific_query"], r["broad_query"], r["mechanism_query"]), lambda q: q != ""), " ")
    if strategy == "concepts":
        return F.array_join(r["key_concepts"], " ")
    return r[f"{strategy}_query"] if strategy in ("broad", "mechanism") else r["specific_query"]


def best_letter(logits: Column, bias: dict[str, float] | None = None) -> Column:
    """The letter A, B, ... of the greatest logit, the first of equals; ``bias`` is added by letter before."""
    shift = F.create_map(*[x for k, v in (bias or {"": 0.0}).items() for x in (F.lit(k), F.lit(float(v)))])
    letter = lambda i: F.substring(F.lit("ABCDEFGHIJ"), i + 1, F.lit(1))
    rows = F.transform(logits, lambda x, i: F.struct((x + F.coalesce(F.try_element_at(shift, letter(i)), F.lit(0.0))).alias("v"), (-i).alias("i"), letter(i).alias("letter")))
    return F.array_max(rows)["letter"]


def sanitize_expansions(terms: Column) -> Column:
    """Trimmed terms of 3 to 50 characters without a banned phrase, each once, in order."""
    bare = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit(""))))
    fine = F.filter(bare, lambda t: F.length(t).between(3, 50) & ~F.lower(t).rlike("|".join(BANNED)))
    return F.array_distinct(fine)


def sanitize_terms(terms: Column, most: int = 120) -> Column:
    """Terms up to ``most`` characters that are not empty, each once, in order."""
    return F.array_distinct(F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != "") & (F.length(t) <= most)))


def _words(text: Column, longer_than: int = 0) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.length(w) > longer_than))


def relevance(question: Column, context: Column) -> Column:
    """Share of the question's words of four letters or more that the context has; 0 for a question without any."""
    q = _words(question, 3)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, _words(context))) / F.size(q))


def context_score(question: Column, context: Column) -> Column:
    """Share of the question's words in the context, a tenth for each word that speaks for it, less for long ones."""
    q, low = _words(question), F.lower(context)
    share = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, _words(context))) / F.size(q))
    bonus = sum((low.contains(w).cast("int") for w in CONTEXT_WORDS), F.lit(0)) * 0.1
    return share + bonus - F.greatest(F.lit(0.0), (F.length(context) - 500) / 1000) * 0.2


def written_out(text: Column) -> Column:
    """Lower-cased, white space squeezed, abbreviations written out."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    for short, long in ABBREVIATIONS.items():
        t = F.regexp_replace(t, rf"\b{short}\b", long)
    return t


# Names under which a record's text may lie, in the order in which they are joined.
TEXT_FIELDS = ("title", "Title", "abstract", "Abstract", "text", "body", "content", "passage", "Body", "full_text", "article")


def text_fields(*fields: Column) -> Column:
    """The fields (texts) one after another, white space of any script squeezed; nulls are left out."""
    return strip(F.regexp_replace(F.concat_ws("\n", *fields), f"{SPACE}+", " "))


def record_text(df: DataFrame) -> Column:
    """The text of each record of ``df``: the columns named in TEXT_FIELDS that it has, texts or lists of texts, in that
    order; the record as JSON where all of them are null or missing. Columns of other types take no part."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [n for n in TEXT_FIELDS if kinds.get(n) in ("string", "array<string>")]
    found = [F.col(f"`{n}`") for n in names]
    text = text_fields(*[F.array_join(c, "\n") if kinds[n] == "array<string>" else c for n, c in zip(names, found, strict=True)])
    whole = text_fields(F.to_json(F.struct(*[F.col(f"`{n}`") for n in df.columns])))
    return F.when(sum((c.isNotNull().cast("int") for c in found), F.lit(0)) > 0, text).otherwise(whole)


def clean_paragraph(cleaned: Column) -> Column:
    """A cleaned paragraph, empty if it has under three words."""
    return F.when(F.size(F.filter(F.split(cleaned, r"\s+"), lambda w: w != "")) < 3, "").otherwise(cleaned)


def index_name(model: Column, names: dict[str, str], default: str) -> Column:
    """The index of a model: that of the first pattern inside the model's name, any case."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(names.items()):
        out = F.when(F.lower(model).contains(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit(default))
