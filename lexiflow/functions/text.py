"""Column functions over text: tokenisers, cleaning, keys. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content for lexical overlap.
STOPWORDS = tuple(
    """a an the and or for to of in on at from by with without into about as is are was were be been being that which who
whom whose this these those it its they them their do does did done doing have has had having not no yes can could
will would should may might must more most many few some any each every other another such than then when where
while how why patient patients month months year years day days week weeks male female man woman boy girl""".split()
)


#: White space of any script, as a class that Java and RE2 read alike.
SPACE = r"[\t-\r\x1C-\x20\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def content_words(text: Column) -> Column:
    """Distinct lower-cased ASCII words of three letters or more that are no stopwords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def overlap(query_words: Column, text_words: Column) -> Column:
    """Share of the query's words that the text has; an empty query has 0."""
    n = F.size(query_words)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query_words, text_words)) / n)


def title_key(title: Column, cap: int = 512) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(title)), r"\s+", " "), 1, cap)


def content_hash(text: Column) -> Column:
    return F.md5(F.trim(text))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


# The expressions of figures, page numbers, reference headings, links and rights lines below.
def drop_figures(text: Column) -> Column:
    """Without figure references, and without short caption lines (a caption phrase and a picture word)."""
    bare = F.regexp_replace(text, r"(?i)Fig\.\s+\d+\.\d+", "")
    bare = F.regexp_replace(bare, r"(?i)Figure\s+\d+", "")
    bare = F.regexp_replace(bare, r"(?i)Fig\.\s+\d+[A-Za-z]?", "")

    def caption(line: Column) -> Column:
        low = F.lower(strip(line))
        return low.rlike(r"figure |fig\. |shows |illustrates |demonstrates ") & low.rlike(r"figure|fig|panel|image|drawing") & (F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")) <= 15)

    return F.array_join(F.filter(lines(bare), lambda x: ~caption(x)), "\n")


def drop_page_numbers(text: Column) -> Column:
    kept = F.filter(
        F.transform(lines(text), lambda x: F.when(x.rlike(r"^\s*\d+\s*$") | x.rlike(r"^\d+\s*\|"), F.lit("")).otherwise(F.regexp_replace(x, r"(?i)Page\s+\d+", ""))),
        lambda x: ~((F.length(F.trim(x)) < 10) & F.regexp_replace(F.trim(x), "[ -]", "").rlike(r"^\d+$")),
    )
    return F.array_join(kept, "\n")


def cut_references(text: Column) -> Column:
    """The lines before the first heading of a reference list."""
    heading = F.transform(lines(text), lambda x: F.trim(x).rlike(r"(?i)^(References?|Bibliography|Further Reading|Suggested Reading)$"))
    at = F.array_position(heading, True).cast("int")
    return F.when(at > 0, F.array_join(F.slice(lines(text), F.lit(1), F.greatest(at - 1, F.lit(0))), "\n")).otherwise(text)


def drop_links(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"https?://[A-Za-z0-9$-_@.&+!*(),%]+", ""), r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "")


def drop_copyright(text: Column) -> Column:
    return F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, r"(©|Copyright).*$", "")), "\n")


def drop_table_rules(text: Column) -> Column:
    return F.array_join(F.transform(lines(text), lambda x: F.when(x.rlike(r"^\s*[…-]+\s*$"), F.lit("")).otherwise(x)), "\n")


def squeeze(text: Column) -> Column:
    """Blanks as one, blank lines (they may hold white space) as one, no white space at the ends of lines and text."""
    one = F.regexp_replace(F.regexp_replace(text, " +", " "), r"\n\s*\n\s*\n+", "\n\n")
    return F.trim(F.regexp_replace(F.array_join(F.transform(lines(one), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"), r"^\s+|\s+$", ""))


def clean(text: Column) -> Column:
    """The whole chain in its fixed order."""
    for f in (drop_figures, drop_page_numbers, cut_references, drop_table_rules, drop_links, drop_copyright, squeeze):
        text = bind(text, f)
    return text


def nfc(text: Column) -> Column:
    """Canonical composition, trimmed (no built-in expression composes)."""
    import unicodedata

    @F.pandas_udf("string")
    def compose(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).strip())

    return compose(text)


def highlight(text: Column, query: str, flags: str = "") -> Column:
    """Query words of more than three letters, and what begins with them, between double stars; one pass. With the flag
    (?U) accented letters are letters: no word ends before one."""
    import re

    words = [re.escape(w) for w in query.split() if len(w) > 3]
    return F.regexp_replace(text, flags + r"(?i)\b(" + "|".join(words) + r")\w*\b", "**$0**") if words else text
