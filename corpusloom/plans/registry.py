"""The registered queries, the SQL they are compared with, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources.shared import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_stored: dict[tuple, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and time of each file under path, as its file system lists them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, out = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while listed.hasNext():
        f = listed.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def stored(spark: SparkSession, sf_dir: str, names: tuple[str, ...], kind: str, make: Callable[[str], None]) -> str:
    """A folder that make has filled from the tables of these names: made once in a session, and
    again where the tables' files have changed."""
    state = [spark.sparkContext.applicationId, kind, sf_dir]
    for name in names:
        state.extend(_files(spark, f"{sf_dir}/{name}.parquet"))
    if (key := tuple(state)) not in _stored:
        path = fresh_path(spark, kind)
        make(path)
        _stored[key] = path
    return _stored[key]


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def tokens_sql(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x))"


def vectors_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs tok, tf, idf and w (key as doc_id, term, weight) over a source, and q (query_id, term, weight)."""
    return f"""
    tok AS (SELECT {key} AS doc_id, unnest({tokens_sql(text)}) AS term FROM {source}),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
    w0 AS (SELECT doc_id, tf.term, tf / sum(tf) OVER (PARTITION BY doc_id) * idf AS w FROM tf JOIN idf ON tf.term = idf.term),
    w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0),
    qtok AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark),
    qtf AS (SELECT query_id, term, count(*) AS tf FROM qtok GROUP BY ALL),
    q0 AS (SELECT query_id, qtf.term, tf * idf AS w FROM qtf JOIN idf ON qtf.term = idf.term),
    q AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM q0)"""


def hits_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """And ranked (query_id, doc_id, score, rank): all texts of the source for each question."""
    return f"""{vectors_sql(source, key, text)},
    s AS (SELECT query_id, doc_id, round(sum(q.weight * w.weight), 9) AS score FROM q JOIN w ON q.term = w.term GROUP BY ALL),
    padded AS (SELECT a.query_id, d.{key} AS doc_id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM q) a CROSS JOIN {source} d
               LEFT JOIN s ON s.query_id = a.query_id AND s.doc_id = d.{key}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM padded)"""


VECTORS, HITS = vectors_sql(), hits_sql()


def chunks_sql(source: str, size: int = 600, overlap: int = 80) -> str:
    """CTE ck (doc_id, k, lo, hi, t) of the chunks of a source (doc_id, t not null), level by level of boundaries."""
    blank = lambda c: f"list_contains([' ', chr(9), chr(10), chr(11), chr(12), chr(13)], {c})"
    last = f"(e = hi OR {blank('ch[e + 1]')})"
    # whether a piece ends with character e of a span (lo, hi]
    levels = (
        "ch[e] = chr(10) AND e - 1 > lo AND ch[e - 1] = chr(10) AND (e = hi OR ch[e + 1] <> chr(10))", "ch[e] = chr(10)", f"ch[e] = '.' AND {last}",
        f"list_contains([',', ';', ':'], ch[e]) AND {last}", f"{blank('ch[e]')} AND (e = hi OR NOT {blank('ch[e + 1]')})", "true",
    )
    out = f"s0 AS (SELECT doc_id, t, string_split(t, '') AS ch, []::INT[] AS path, 0::BIGINT AS lo, length(t) AS hi FROM {source})"
    for n, ends in enumerate(levels):
        out += f""",
    e{n} AS (SELECT doc_id, t, ch, path, lo, hi, list_filter(range(lo + 1, hi + 1), lambda e: {ends}) AS ends FROM s{n} WHERE hi - lo > {size}),
    f{n} AS (SELECT doc_id, t, ch, path, list_reduce(CASE WHEN ends[-1] = hi THEN ends ELSE list_append(ends, hi) END,
             lambda a, e: CASE WHEN e - a.s > {size} AND a.x > a.s THEN {{'s': greatest(a.s, a.x - {overlap}), 'x': e, 'out': list_append(a.out, [a.s, a.x])}}
                               ELSE {{'s': a.s, 'x': e, 'out': a.out}} END, {{'s': lo, 'x': lo, 'out': []::BIGINT[][]}}) AS r FROM e{n}),
    g{n} AS (SELECT doc_id, t, ch, path, list_append(r.out, [r.s, r.x]) AS o FROM f{n}),
    s{n + 1} AS (SELECT doc_id, t, ch, path, lo, hi FROM s{n} WHERE hi - lo <= {size}
        UNION ALL SELECT doc_id, t, ch, list_append(path, k), o[k][1], o[k][2] FROM (SELECT *, unnest(range(1, len(o) + 1)) AS k FROM g{n}))"""
    return out + f""",
    ck AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS k, lo, hi,
           regexp_replace(substr(t, lo + 1, hi - lo), '^\\s+|\\s+$', '', 'g') AS content FROM s{len(levels)})"""


#: Documents as they are indexed: the source as title before the text.
TITLED = "titled AS (SELECT doc_id, concat_ws(chr(10) || chr(10), source, coalesce(text, '')) AS t FROM documents)"
