import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [("The Cat 42 a éclair", ["cat", "42", "clair"]), (None, []), ("the of and", []), ("x", [])],
)
def test_tokenize(spark, value, want):
    assert one(spark, X.tokenize, value) == want


def test_trimming_takes_white_space_by_unicode_however_much_stands_within(spark):
    odd = spark.range(1, 0xD800).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    odd = odd.select(F.concat("c", F.lit("a"), "c", F.lit("b\n"), "c").alias("t"))
    assert odd.where(X.trim_all(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    assert odd.where(F.col("t").startswith("aa") | X.trim_all(F.col("t")).startswith("a")).count() == len(X.BLANKS) + 1
    begun = time.monotonic()
    assert spark.range(1).select(F.concat(F.lit(" a"), F.repeat(F.lit(" "), 500_000), F.lit("b ")).alias("t")).select(F.length(X.trim_all(F.col("t")))).first()[0] == 500_002
    assert time.monotonic() - begun < 20


def test_trim_preview_citations(spark):
    assert one(spark, X.trim_all, " \n a \n") == "a"
    assert one(spark, X.preview, "a  b\n" + "c" * 200) == "a b " + "c" * 155 + "…"
    assert one(spark, X.citation_count, "[1] [1] [2, 3] [4]") == 2
    assert one(spark, X.extension, ".profile") == "" and one(spark, X.extension, "a.b.TXT") == ".txt"
    shown = {999: "999ms", 1000: "1.00s", 3885: "3.88s", 4255: "4.25s", 1125: "1.13s", 59999: "60.00s", 86_399_995: f"{86399.995:.2f}s", 86_399_996: "86400.00s"}
    assert {ms: spark.range(1).select(X.format_duration(F.lit(ms))).first()[0] for ms in shown} == shown
    assert one(spark, X.answer_length, "éa") == 2 and one(spark, X.answer_length, None) == 0
    assert one(spark, lambda c: X.is_strong(c.cast("double")), "7") and not one(spark, lambda c: X.is_strong(c.cast("double")), "6.9")
    assert one(spark, X.question_error, "  ") == "missing" and one(spark, X.question_error, "x" * 1001) == "too_long"


@pytest.mark.parametrize(
    ("raw", "want"),
    [('```json\n{"answer": "x"}\n```', "x"), ('well {"answer": "x"} so', "x"), ("none", None), ('{"answer": ', None)],
)
def test_replies(spark, raw, want):
    got = one(spark, lambda c: X.parse_reply(c, "answer string")["answer"], raw)
    assert got == want


def test_unwrap(spark):
    assert one(spark, X.unwrap_answer, '{"answer": "", "text": "t"}') == "t"
    assert one(spark, X.unwrap_answer, "plain") == "plain"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n", max_size=3000))
def test_spans_cover_the_text(text):
    got = chunking.spans(text, 60, 8)
    assert got[0][0] == 0 and max(e for _, e in got) == len(text)
    assert all(e - s <= 60 for s, e in got)
    at = 0
    for s, e in got:
        assert s <= at
        at = max(at, e)


def test_character_windows():
    assert chunking.spans("x" * 1400) == [(0, 600), (520, 1120), (1040, 1400)]
    assert chunking.spans("") == [(0, 0)] and chunking.spans("y" * 600) == [(0, 600)]


def test_overlap_may_exceed_the_size():
    text = "a" * 590 + ". " + "b" * 590 + "."
    assert all(e - s <= 600 for s, e in chunking.spans(text))


def test_chunks_frame(spark):
    d = spark.createDataFrame([("d", "t", "x" * 700), ("e", "t", None)], "doc_id string, title string, content string")
    rows = chunking.chunk_documents(d, enrich=True).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == ["d#chunk-1", "d#chunk-2", "d#chunk-3", "e#chunk-1"] or rows[0].content == "t"
    assert chunking.chunk_lists(chunking.chunk_documents(d)).where("doc_id = 'e'").first().chunk_count == 1


def fold(text, size, overlap):
    """Chunks by strings, level by level: split after delimiters, pack, split again what is too long."""
    patterns = [r"\n\n+", r"\n", r"\.(?=\s|$)", r"[,;:](?=\s|$)", r"\s+", None]

    def pieces(t, level):
        if patterns[level] is None:
            return list(t)
        out, last = [], 0
        for m in re.finditer(patterns[level], t):
            out.append(t[last : m.end()])
            last = m.end()
        return [p for p in [*out, t[last:]] if p]

    def pack(t, offset, level):
        if len(t) <= size or level == len(patterns):
            return [(offset, t)]
        out, now, start, at = [], "", 0, 0
        for p in pieces(t, level):
            if now and len(now) + len(p) > size:
                out.append((start, now))
                keep = now[len(now) - overlap :] if overlap < len(now) else now
                start, now = at - len(keep), keep
            now += p
            at += len(p)
        out.append((start, now))
        return [c for a, chunk in out for c in (pack(chunk, offset + a, level + 1) if len(chunk) > size else [(offset + a, chunk)])]

    return pack(text, 0, 0)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc é.,;:\n", max_size=1500), st.integers(5, 90), st.integers(0, 4))
def test_spans_equal_a_fold_over_strings(text, size, overlap):
    assert [(a, text[a:b]) for a, b in chunking.spans(text, size, overlap)] == fold(text, size, overlap)
