"""Column functions on text: tokens, trimming, previews, citations, replies in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are not indexed, by alphabet.
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "an", "and", "any", "are", "as", "at", "be", "because",
    "before", "below", "between", "but", "by", "can", "could", "did", "do", "does", "doing", "down", "during", "few",
    "for", "from", "further", "has", "have", "he", "how", "i", "if", "in", "is", "it", "its", "just", "may", "might",
    "more", "most", "must", "no", "nor", "not", "now", "of", "on", "only", "or", "other", "out", "over", "own", "same",
    "shall", "she", "should", "so", "such", "than", "that", "the", "then", "there", "these", "they", "this", "those",
    "to", "too", "under", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom",
    "why", "will", "with", "would", "you",
)

# What may be uploaded.
UPLOAD_TYPES = {
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "text/plain": ".txt",
    "text/markdown": ".md",
}


def tokenize(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 of two characters or more, without stopwords, as an array."""
    return F.filter(words(text), lambda w: ~w.isin(*STOPWORDS))


def words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 of two characters or more.  Who explodes them filters
    STOPWORDS afterwards, in generated code."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


# White space by Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_all(text: Column) -> Column:
    """Without white space (any, by Unicode) at both ends.  (A pattern for the end would be tried at each blank
    of the text, and look through all of a run of them from each.)"""
    return F.btrim(text, F.lit(BLANKS))


def excerpt(text: Column, size: int) -> Column:
    """First size characters with white space collapsed, and an ellipsis if there is more."""
    head = trim_all(F.regexp_replace(F.substring(text, 1, size), r"(?U)\s+", " "))
    return F.concat(head, F.when(F.length(text) > size, "…").otherwise(""))


def preview(text: Column) -> Column:
    return excerpt(text, 160)


def judge_excerpt(text: Column) -> Column:
    return excerpt(text, 400)


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8; invalid ones become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def parse_reply(raw: Column, schema: T.StructType | str) -> Column:
    """JSON of a model's reply: fences are stripped; failing that, the widest {...} is tried; else null."""
    clean = F.regexp_replace(F.regexp_replace(trim_all(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    options = {"mode": "PERMISSIVE"}
    whole = F.when(clean.rlike(r"(?s)^\s*[\{\[].*[\}\]]\s*$"), F.from_json(clean, schema, options))
    return F.coalesce(whole, F.when(inner != "", F.from_json(inner, schema, options)))


def unwrap_answer(raw: Column) -> Column:
    """A reply that is an object gives its answer, text or content (the first not empty), else itself."""
    found = [F.nullif(F.get_json_object(raw, f"$.{k}"), F.lit("")) for k in ("answer", "text", "content")]
    return F.when(F.ltrim(raw).startswith("{"), F.coalesce(*found, raw)).otherwise(raw)


def citation_count(answer: Column) -> Column:
    """Distinct [n] in an answer ([2, 3] is none)."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))))


def format_duration(ms: Column) -> Column:
    """Whole milliseconds below a second as they are, else seconds with two places.

    Halves are those of the double nearest to ms / 1000, which mostly lies a little above or below;
    exact ones go up.  (Split in two, so that products with 1000 are exact, for some 24 days.)"""
    second = ms / 1000
    high = F.floor(second * 1048576) / 1048576
    above = (high * 1000 - ms) + (second - high) * 1000 >= 0
    cents = F.floor(ms / 10) + F.when(ms % 10 > 5, 1).when((ms % 10 == 5) & above, 1).otherwise(0)
    text = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.concat(text, F.lit("s")))


def answer_length(answer: Column) -> Column:
    """Characters (code points) of an answer; none for a missing one."""
    return F.length(F.coalesce(answer, F.lit("")))


def relevance_band(score: Column) -> Column:
    return F.when(score >= 9, "direct").when(score >= 7, "strong").when(score >= 4, "partial").when(score >= 1, "weak").otherwise("none")


def is_strong(score: Column) -> Column:
    return score >= 7


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot; none for a name whose only dot leads."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r".(\.[^.]*)$", 1))


def question_error(question: Column) -> Column:
    """missing, too_long or null (valid)."""
    q = trim_all(F.coalesce(question, F.lit("")))
    return F.when(q == "", "missing").when(F.length(q) > 1000, "too_long")
