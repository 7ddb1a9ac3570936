"""Raw files, records of mixed shape, and the library in SQL."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import surface
from corpusloom.functions import text as X
from corpusloom.operators import chunking, trace
from corpusloom.sources import corpus, files, semistructured

FILES = [("a.txt", " café ".encode()), ("b.MD", b"\xff\xfe x"), ("c.pdf", b"%PDF\x00\x01"), ("d", b"no extension"), ("e.txt", b""), ("f.txt", None), ("g.h.txt", " x\n".encode())]


def _files(spark, rows):
    return spark.createDataFrame(rows, "name string, content binary")


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_files_come_back(spark, tmp_path, prefix):
    path = f"{prefix}{tmp_path}/up"
    written = files.write_files(_files(spark, FILES), path)
    assert {(r.name, r.size) for r in written.collect()} == {(n, len(c or b"")) for n, c in FILES}
    # once more, as by a task that is tried again
    written = files.write_files(_files(spark, FILES), path)
    got = files.texts_of(files.read_files(spark, path).unionByName(files.empty_files(written))).collect()
    want = {("a", ".txt", "café"), ("b", ".MD", "�� x"), ("c", ".pdf", None), ("d", "", None), ("e", ".txt", ""), ("f", ".txt", ""), ("g.h", ".txt", "x")}
    assert {(r.id, r.extension, r.text) for r in got} == want and len(got) == len(FILES)
    by_id = {n.rpartition(".")[0] or n: c or b"" for n, c in FILES}
    assert all(r.hash == hashlib.sha256(by_id[r.id]).hexdigest() and r.size == len(by_id[r.id]) for r in got)
    assert {r.id for r in files.read_files(spark, path, "*.{txt,MD}").select("id").collect()} == {"a", "b", "g.h"}


def test_names_stay_in_their_folder(spark, tmp_path):
    for name in ("../x.txt", "", None):
        with pytest.raises(Exception, match="not a file's name"):
            files.write_files(_files(spark, [(name, b"x")]), f"{tmp_path}/up")
    assert files.write_files(_files(spark, []), f"{tmp_path}/none").count() == 0


def test_a_stream_takes_each_file_once(spark, tmp_path):
    path, out, seen = f"{tmp_path}/up", f"{tmp_path}/texts", []
    for k in range(3):  # each a restart from the checkpoint; files of different sizes of micro-batches
        files.write_files(_files(spark, [(f"{k}-{n}.txt", f"text {k} {n}".encode()) for n in range(5)] + [(f"{k}.bin", b"x")]), path)
        files.start_extract(files.stream_files(spark, path, "*.txt", at_once=2), out, f"{tmp_path}/checkpoint").awaitTermination()
        seen += [(f"{k}-{n}", f"text {k} {n}") for n in range(5)]
        assert sorted((r.id, r.text) for r in spark.read.parquet(out).collect()) == sorted(seen)


RUN = {
    "question": "q", "answer": "a", "sources": [],
    "steps": [
        {"id": "1", "agent": "router", "status": "completed", "startedAt": 5, "finishedAt": 9, "output": {"queryType": "factual", "needsRetrieval": True}},
        {"agent": "retriever", "output": {"candidates": [{"score": 0.5}, {"score": 2}, {}, "odd"]}},
        {"agent": "reranker", "output": {"reranked": [{"llmScore": 7, "score": 9}]}},
        {"agent": "retriever", "output": {"candidates": []}}, {"agent": "retriever", "status": "error", "error": "late", "output": "none"},
        {"agent": "critic", "output": {"verdict": "partial", "faithfulnessScore": "85"}}, {"agent": "critic", "output": {"verdict": "partial", "faithfulnessScore": {}}},
        {"agent": "analyzer", "output": {"answer": "é😀"}}, {"agent": "coordinator", "output": {"finalVerdict": "faithful", "totalIterations": 2, "verdict": "x"}}, "text", 3, None, [],
    ],
}


def test_steps_of_mixed_shapes(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "r1.json").write_text(json.dumps(RUN, indent=2))
    (tmp_path / "runs" / "r2.json").write_text('{"steps": [')
    runs = semistructured.read_run_variants(spark, str(tmp_path / "runs"), per_line=False)
    assert {(r.run_id, r.problem) for r in runs.withColumn("problem", semistructured.run_problem(F.col("run"), F.col("run_id"), F.col("_corrupt_record"))).collect()} == {("r1", None), ("r2", "not_json")}
    s = trace.typed_steps(trace.variant_steps(runs)).orderBy("pos").collect()
    assert [r.pos for r in s] == list(range(13)) and [r.agent for r in s[9:]] == [None] * 4
    assert (s[0].id, s[0].query_type, s[0].needs_retrieval, s[0].finished_at - s[0].started_at) == ("1", "factual", True, 4)
    assert [(r.n_items, r.top_score) for r in s[1:5]] == [(4, 2.0), (1, 7.0), (0, None), (None, None)] and (s[4].status, s[4].error) == ("error", "late")
    assert [(r.verdict, r.faithfulness) for r in s[5:7]] == [("partial", 85.0), ("partial", None)]
    assert s[7].answer_length == 2 and (s[8].final_verdict, s[8].iterations, s[8].verdict) == ("faithful", 2, None)


def test_bad_records_are_kept_apart(spark, tmp_path):
    lines = ['{"run_id":"a","steps":[]}', '{"run_id":"b","steps":{}}', '{"run_id":"c"}', '{"steps":[]}', '{"run_id":"","steps":[]}', "[1]", "3", '{"run_id":"d', "", "null"]
    (tmp_path / "runs.json").write_text("\n".join(lines))
    schema, path = "run variant, _corrupt_record string, run_id string", f"{tmp_path}/kept"
    assert semistructured.aside(spark, path, schema).count() == 0
    for batch in (1, 2, 2):
        runs = semistructured.read_run_variants(spark, str(tmp_path / "runs.json"))
        good = semistructured.set_aside(runs, semistructured.run_problem(F.col("run"), F.col("run_id"), F.col("_corrupt_record")), path, batch)
        assert [r.run_id for r in good.select("run_id").collect()] == ["a"]
    bad = semistructured.aside(spark, path, schema)
    count = {(r.batch, r.problem): r["count"] for r in bad.groupBy("batch", "problem").count().collect()}
    assert count == {(b, p): n for b in (1, 2) for p, n in (("no_steps", 2), ("no_id", 2), ("not_an_object", 3), ("not_json", 1))}
    assert {r[0] for r in bad.where("problem = 'not_json'").select("_corrupt_record").collect()} == {'{"run_id":"d'}


def test_bad_events_are_kept_apart(spark, tmp_path):
    lines = ['{"doc_id":"a","seq":1,"status":"queued"}', '{"doc_id":"a","seq":"x","status":"queued"}', '{"doc_id":"a","seq":2}', '{"seq":2,"status":"queued"}', '{"doc_id":"a', '"text"', '{"doc_id":"b","seq":1,"status":"failed","more":1}']
    (tmp_path / "events.json").write_text("\n".join(lines))
    events = corpus.read_manifest(spark, str(tmp_path / "events.json"))
    good = semistructured.set_aside(events, semistructured.event_problem(), f"{tmp_path}/kept", 1)
    assert {(r.doc_id, r.seq, r.status) for r in good.collect()} == {("a", 1, "queued"), ("b", 1, "failed")}
    bad = semistructured.aside(spark, f"{tmp_path}/kept", f"{corpus.EVENT}, _corrupt_record string").collect()
    assert sorted(r.problem for r in bad) == ["no_id", "no_id", "not_an_object", "not_json", "wrong_kind"]
    none = semistructured.set_aside(corpus.read_manifest(spark, f"{tmp_path}/missing"), semistructured.event_problem(), f"{tmp_path}/kept", 2)
    assert none.count() == 0


def test_sql_functions_equal_those_on_columns(spark):
    surface.register(spark)
    surface.register(spark)
    rng = random.Random(5)
    texts = [None, "", " ", " The cat, and a DOG9 x ", "[1] [2] [1] [2, 3]", "é" * 170, "x" * 1001, "a.b/c.D.TXT", ".txt", "dir.d/none"]
    texts += ["".join(rng.choice("ab .[]12\n é/") for _ in range(rng.randrange(300))) for _ in range(60)]
    spark.createDataFrame([(t, s) for t, s in zip(texts, [None, 10.0, 9.0, 8.9, 7.0, 4.0, 3.9, 1.0, 0.9, 0.0] * 7)], "t string, s double").createOrReplaceTempView("surface_texts")
    t, s = F.col("t"), F.col("s")
    pairs = {
        "text_words(t)": X.words(t), "text_tokens(t)": X.tokenize(t), "text_trim(t)": X.trim_all(t), "text_excerpt(t, 160)": X.preview(t), "text_excerpt(t, 40)": X.excerpt(t, 40),
        "citation_count(t)": X.citation_count(t), "relevance_band(s)": X.relevance_band(s), "question_error(t)": X.question_error(t), "file_extension(t)": X.extension(t),
    }
    for sql, column in pairs.items():
        rows = spark.table("surface_texts").select(F.expr(sql).alias("a"), column.alias("b")).collect()
        assert all(r.a == r.b for r in rows), (sql, [r for r in rows if r.a != r.b][:3])


def test_the_chunker_as_a_table_function(spark):
    surface.register(spark)
    rng = random.Random(6)
    texts = [None, "", "short"] + ["".join(rng.choice(["word ", "and, ", "end. ", "\n", "\n\n", "é😀", "x" * 90]) for _ in range(rng.randrange(400))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    docs.createOrReplaceTempView("surface_docs")
    for size, overlap in ((600, 80), (50, 10)):
        got = spark.sql(f"SELECT doc_id, c.* FROM surface_docs, LATERAL chunks(content, {size}, {overlap}) c").collect()
        want = chunking.chunk_documents(docs.withColumn("title", F.lit("t")), size=size, overlap=overlap).select("doc_id", "chunk_index", "start_offset", "raw_length", F.col("raw").alias("content")).collect()
        assert sorted(got) == sorted(want) and len(got) >= len(texts)
    assert spark.sql("SELECT * FROM chunks('abc')").collect() == spark.sql("SELECT * FROM chunks(size => 600, text => 'abc')").collect()
