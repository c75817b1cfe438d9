"""Parsers of model answers and question scalars, as chains of native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _none(c: Column) -> Column:
    return F.when(c != "", F.upper(c))


def answer_letter(text: Column) -> Column:
    """``Answer: X``, else a last line that is one letter, else the first single capital A-E; else null."""
    t = F.trim(text)
    last = F.trim(F.element_at(F.split(t, "\n"), -1))
    return F.coalesce(_none(F.regexp_extract(text, r"(?i)Answer\s*[:：]\s*([A-E])", 1)), F.when(last.rlike("^[A-Ea-e]$"), F.upper(last)), _none(F.regexp_extract(text, r"\b([A-E])\b", 1)))


def reasoned_letter(text: Column) -> Column:
    """For answers after reasoning: the last five lines first, then the whole, the first character, the last letter,
    then a letter of either case before a bracket or a full stop."""
    t = F.trim(text)
    tail = F.array_join(F.slice(F.reverse(F.split(t, "\n")), 1, 5), "\n")  # order of lines does not matter inside one
    every = F.regexp_extract_all(t, F.lit(r"\b([A-E])\b"), 1)
    return F.coalesce(
        _none(F.regexp_extract(tail, r"(?i)Answer\s*[:：]\s*([A-E])", 1)),
        _none(F.regexp_extract(t, r"(?i)Answer\s*[:：]\s*([A-E])", 1)),
        F.when(F.substring(t, 1, 1).rlike("^[A-Ea-e]$"), F.upper(F.substring(t, 1, 1))),
        F.when(F.size(every) > 0, F.element_at(every, -1)),
        _none(F.regexp_extract(t, r"(?i)\b([A-E])[)\.]", 1)),
    )


def reasoning(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?is)<Reasoning>(.*?)</Reasoning>", 1))


def gold_letter(named: Column, numbered: Column) -> Column:
    """A letter A-E by name (one letter only), else by its number from 1."""
    return F.coalesce(F.when(F.upper(named).rlike("^[A-E]$"), F.upper(named)), F.when(numbered.between(1, 4), F.element_at(F.array(*map(F.lit, "ABCD")), numbered)))


def question_type(q: Column) -> Column:
    low = F.lower(F.coalesce(q, F.lit("")))
    has = lambda *w: low.rlike("|".join(w))
    return (
        F.when(has(" except", " not ", "incorrect", "false"), "negation")
        .when(has("diagnosis"), "diagnosis")
        .when(has("mechanism", "pathophysiology", "pathway"), "mechanism")
        .when(has("drug", "treatment", "therapy"), "treatment")
        .when(has("side effect", "adverse"), "adverse_effect")
        .otherwise("other")
    )


def is_negated(q: Column) -> Column:
    padded = F.concat(F.lit(" "), q)
    out = F.lit(False)
    for w in (" EXCEPT", " Except", " NOT ", " FALSE ", " LEAST ", " INCORRECT "):
        out = out | padded.contains(w)
    return out


def fallback_query(q: Column) -> Column:
    words = F.filter(F.regexp_extract_all(q, F.lit("([a-zA-Z]+)"), 1), lambda w: F.length(w) > 4)
    return F.when(F.size(words) > 0, F.lower(F.array_join(F.slice(words, 1, 10), " "))).otherwise(F.substring(q, 1, 120))


def valid_query(q: Column, banned: tuple[str, ...] = ()) -> Column:
    tokens = F.filter(F.split(F.trim(q), r"\s+"), lambda t: t != "")
    fine = F.size(tokens).between(5, 14) & F.exists(tokens, lambda t: F.length(F.regexp_replace(t, "[^a-zA-Z]", "")) > 4)
    for b in banned:
        fine = fine & ~F.lower(q).contains(b)
    return fine


def correctness(predicted: Column, gold: Column) -> Column:
    return F.when(predicted.isNotNull() & gold.isNotNull(), predicted == gold)


def option_prompt(question: Column, options: Column, references: Column | None = None) -> Column:
    """A zero-shot prompt over a map of options; references is an array of texts."""
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
    head = F.lit("Choose exactly one option.\n")
    if references is not None:
        head = F.concat(head, F.array_join(F.transform(references, lambda x, i: F.concat(F.lit("Reference "), (i + 1).cast("string"), F.lit(": "), x)), "\n\n"), F.lit("\n\n"))
    return F.concat(head, F.lit("Question: "), question, F.lit("\n\nOptions:\n"), listed, F.lit("\n\nAnswer: "))


def reference(n: Column, source: Column, title: Column, url: Column, text: Column, most: int = 320) -> Column:
    """A numbered reference: source in brackets and title (if either is there), the address, and the text on one line,
    cut at ``most`` characters with three points (0: whole). Nulls are empty."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    line = bare(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    line = F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line) if most else line
    head = F.when((bare(source) != "") | (bare(title) != ""), F.concat(F.lit("["), bare(source), F.lit("] "), bare(title))).otherwise(F.lit(""))
    tail = F.when(bare(url) != "", F.concat(F.lit(" (URL: "), bare(url), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("Reference "), n.cast("string"), F.lit(": "), head, tail, F.lit("\n"), line)


def styled_prompt(question: Column, options: Column, references: Column | None = None, shots: Column | None = None, steps: bool = False) -> Column:
    """A prompt over a map of options (null and blank ones are left out, letters ascend): references (array of texts),
    worked examples (array of question, options as a text, answer), and with ``steps`` the call to reason first."""
    entries = F.filter(F.array_sort(F.map_entries(options)), lambda e: F.coalesce(F.trim(e["value"]), F.lit("")) != "")
    listed = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
    letters = F.array_join(F.transform(entries, lambda e: e["key"]), " ")
    parts = [F.concat(F.lit("Choose exactly one option. Valid answers: {"), letters, F.lit("}."))]
    if steps:
        parts.append(F.lit("Think step by step between <Reasoning> and </Reasoning>, then give the letter."))
    if shots is not None:
        parts.append(F.array_join(F.transform(shots, lambda x: F.concat(F.lit("Question: "), x["question"], F.lit("\n"), x["options"], F.lit("\nAnswer: "), x["answer"])), "\n\n"))
    if references is not None:
        parts.append(F.array_join(references, "\n\n"))
    parts.append(F.concat(F.lit("Question: "), question, F.lit("\n\nOptions:\n"), listed))
    parts.append(F.lit("<Reasoning>" if steps else "Answer: "))
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")
