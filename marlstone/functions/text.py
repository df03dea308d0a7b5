"""Column functions on text; all are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trimming takes off: spaces, tabs, line ends, NUL and vertical tabs.
BLANKS = " \t\n\r\0\x0b"
STOP_WORDS = sorted(
    "a about also am an and are as at been being between but by can could did does for from get give gives got had has have how if in "
    "into is it just know more most no not of on or over please so some such tell than that the their them then there these they this "
    "those to under use used using very was were what when where which who whom why will with would should yes you your yours".split()
)
ENTITY_STOP_WORDS = sorted(
    "about and are can contact cost could details do does email for from hello hi how information is phone please price pricing services "
    "should tell that the this was what when where which who whom why with would you your".split()
)
#: Query expansions: what a question must contain one of, and the queries that it gets.
INTENTS = (
    (("address", "call", "contact", "email", "mobile", "phone", "reach", "whatsapp"), ("email phone mobile address contact information", "contact details support line")),
    (("cost", "fee", "how much", "payment", "price", "pricing", "subscription"), ("price cost subscription payment terms pricing",)),
    (("policy", "refund", "terms", "warranty"), ("policy terms warranty refund conditions",)),
    (("availability", "hours", "open", "when are you"), ("support hours availability schedule",)),
)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def line_ends(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def few_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def clean_text(c: Column) -> Column:
    """Plain text: line ends unified, at most one blank line in a row, trimmed."""
    return trim(few_blank_lines(line_ends(c)))


def clean_page(c: Column) -> Column:
    """Text of a PDF page: form feeds and NULs end lines, runs of spaces and tabs become one space."""
    c = F.translate(line_ends(c), "\f\0", "\n\n")
    return trim(few_blank_lines(F.regexp_replace(c, "[ \t]+", " ")))


def strip_markdown(c: Column) -> Column:
    """Markdown as plain text: fences, link targets, line markers and emphasis go, their text stays."""
    c = line_ends(c)
    for pattern, to in (
        (r"(?md)^```[a-zA-Z0-9]*\n", ""), ("```", ""),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?md)^\s{0,3}#{1,6}\s+", ""), (r"(?md)^\s{0,3}>\s?", ""), (r"(?md)^\s{0,3}[-*+]\s+", ""),
        (r"\*\*|__|\*|_|`", ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    return trim(few_blank_lines(c))


def checksum(c: Column) -> Column:
    return F.sha2(c, 256)


def excerpt(c: Column, width: int = 200) -> Column:
    return F.when(F.length(c) > width, F.concat(F.rtrim(F.substring(c, 1, width)), F.lit("..."))).otherwise(c)


def display_name(title: Column, source: Column, doc_id: Column) -> Column:
    """Title, else the last part of the source, else the number."""
    filled = lambda c: F.when(trim(c) != "", c)
    return F.coalesce(filled(title), filled(F.regexp_extract(source, "([^/]*)/*$", 1)), F.concat(F.lit("Document #"), doc_id.cast("string")))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order, with repeats."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def terms(c: Column) -> Column:
    """Search terms: different words of three letters or more that are no stop words, in order."""
    return F.array_distinct(F.filter(words(c), lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS)))


def entity_tokens(c: Column) -> Column:
    """Different capitalised ASCII words, in lower case, that are no stop words, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?U)\b([A-Z][a-zA-Z]+)\b"), 1)
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: ~x.isin(ENTITY_STOP_WORDS)))


def contains_any(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def query_variants(c: Column) -> Column:
    """The question and the expansions of the intents it shows; a blank question alone."""
    low = F.lower(trim(c))
    parts = [F.array(c)] + [F.when(contains_any(low, needles), F.array(*map(F.lit, extra))).otherwise(F.array().cast("array<string>")) for needles, extra in INTENTS]
    return F.when(low == "", F.array(c)).otherwise(F.array_distinct(F.flatten(F.array(*parts))))


def multi_query(c: Column, n: int) -> Column:
    """The first n of: the question, its entities as a phrase, its variants."""
    if n <= 1:
        return F.array(c)
    entity = F.array_join(entity_tokens(c), " ")
    return F.slice(F.array_distinct(F.concat(F.array(c), F.when(entity != "", F.array(entity)).otherwise(F.array().cast("array<string>")), query_variants(c))), 1, n)


def leads_with_pronoun(c: Column) -> Column:
    """Whether a question refers to something said before."""
    start = r"(?i)^\s*(what|who|where|when|why|how|is|are|does|do|can|could|would|tell|give)\s+(he|she|it|they|him|her|his|its|their|them|this|that)\b"
    return c.rlike(start) | c.rlike(r"(?i)\b(he|she|it|they|him|her|his|its|their|them)\b")
