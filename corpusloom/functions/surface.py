"""The library in SQL: text functions and the chunker, for queries written as SQL text.

    register(spark)
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL chunks(text, 600, 80) c")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusloom.functions.text import STOPWORDS
from corpusloom.operators import chunking

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

#: Name, arguments, type and body; each equals the function on columns that is named behind it.
FUNCTIONS = (
    ("text_words", "t STRING", "ARRAY<STRING>", "regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]{2,}', 0)"),  # words
    ("text_tokens", "t STRING", "ARRAY<STRING>", f"filter(regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]{{2,}}', 0), w -> w NOT IN ({_STOP}))"),  # tokenize
    ("text_trim", "t STRING", "STRING", r"regexp_replace(t, r'(?U)^\s+|\s+$', '')"),  # trim_all
    ("text_excerpt", "t STRING, size INT", "STRING", r"concat(text_trim(regexp_replace(substring(t, 1, size), r'(?U)\s+', ' ')), CASE WHEN length(t) > size THEN '…' ELSE '' END)"),  # excerpt
    ("citation_count", "t STRING", "INT", r"size(array_distinct(regexp_extract_all(coalesce(t, ''), r'\[(\d+)\]', 1)))"),  # citation_count
    ("relevance_band", "score DOUBLE", "STRING", "CASE WHEN score >= 9 THEN 'direct' WHEN score >= 7 THEN 'strong' WHEN score >= 4 THEN 'partial' WHEN score >= 1 THEN 'weak' ELSE 'none' END"),  # relevance_band
    ("question_error", "t STRING", "STRING", "CASE WHEN coalesce(text_trim(t), '') = '' THEN 'missing' WHEN length(text_trim(t)) > 1000 THEN 'too_long' END"),  # question_error
    ("file_extension", "name STRING", "STRING", r"lower(regexp_extract(regexp_extract(name, r'([^/]*)$', 1), r'.(\.[^.]*)$', 1))"),  # extension
)


@udtf(returnType="chunk_index int, start_offset int, raw_length int, content string", useArrow=True)
class Chunks:
    """A text's chunks, as chunk_documents cuts them (content not trimmed); a null text is empty, which is one chunk."""

    def eval(self, text: str, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Iterator[tuple]:
        text = text or ""
        for k, (a, b) in enumerate(chunking.spans(text, size, overlap), 1):
            yield k, a, b - a, text[a:b]


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS and the table function chunks(text, size, overlap) known to the session; registering them again changes nothing."""
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("chunks", Chunks)
