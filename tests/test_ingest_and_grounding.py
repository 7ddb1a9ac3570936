import json
import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import STOPWORDS
from corpusloom.operators import chunking, grounding, index, ingest, trace
from corpusloom.sources import corpus
from corpusloom.sources.shared import materialise
from corpusloom.streaming import ingest as stream
from corpusloom.streaming import questions


def test_quota_counts_accepted_files_only(spark):
    u = spark.createDataFrame([(1, i, s) for i, s in enumerate([10, 400, 200, 90, 5])], "batch_id long, pos int, size long")
    assert [r.accepted for r in ingest.quota_check(u, 0, 500).orderBy("pos").collect()] == [True, True, False, True, False]


def test_first_failing_rule(spark):
    u = spark.createDataFrame(
        [("a.exe", "text/plain", 1), ("a.txt", "x/y", 1), ("a.txt", "text/markdown", 1), ("a.md", "text/markdown", 0), ("a.md", "text/markdown", 26_214_401), ("a.md", "text/markdown", 26_214_400)],
        "n string, m string, s long",
    )
    assert [r[0] for r in u.select(ingest.upload_error(F.col("n"), F.col("m"), F.col("s"))).collect()] == ["extension", "mime", "mismatch", "empty", "too_large", None]


def test_duplicates_block_only_when_completed(spark):
    m = spark.createDataFrame([("a", "h1", "completed"), ("b", "h2", "failed")], "id string, hash string, processing_status string")
    u = spark.createDataFrame([("x", "h1"), ("y", "h2"), ("z", "h2")], "id string, hash string")
    assert [(r.id, r.existing_id) for r in ingest.duplicates(u, m).collect()] == [("x", "a")]
    assert [r.id for r in ingest.fresh(u, m).collect()] == ["y"]


def test_lifecycle(spark):
    e = spark.createDataFrame([("d", 1, "queued"), ("d", 2, "completed"), ("e", 1, "extracting")], "doc_id string, seq long, status string")
    e = e.withColumn("message", F.lit(None).cast("string")).withColumn("ts", F.current_timestamp())
    assert {r.doc_id: r.status for r in ingest.current_manifest(e).collect()} == {"d": "completed", "e": "extracting"}
    assert ingest.in_flight(ingest.current_manifest(e)).first()[0]
    gone = ingest.delete_documents(e, spark.createDataFrame([("d",), ("unknown",)], "doc_id string"))
    assert [r.doc_id for r in ingest.current_manifest(e.unionByName(gone)).collect()] == ["e"]


def test_refinement_and_fallbacks(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (2, 2, "y"), (3, 1, "z")], "query_id long, iteration int, raw_answer string")
    v = spark.createDataFrame(
        [(1, 1, "needs_revision", 40.0, False), (1, 2, "needs_revision", 90.0, False), (2, 1, "faithful", 95.0, False), (2, 2, "faithful", 95.0, False), (3, 1, None, None, True)],
        "query_id long, iteration int, verdict string, faithfulness_score double, judge_failed boolean",
    )
    got = {r.query_id: (r.iterations, r.verdict, r.answer) for r in grounding.refine_outcome(a, v).collect()}
    assert got == {1: (2, "needs_revision", "y"), 2: (1, "faithful", "x"), 3: (1, "faithful", "z")}
    assert {(r.query_id, r.iteration) for r in grounding.audited_verdicts(v).where("verdict_mismatch").collect()} == {(1, 2)}
    q = spark.createDataFrame([(1, "q"), (2, "r"), (9, "s")], "query_id long, question string")
    p = spark.createDataFrame([(1, "factual", "q2", False)], "query_id long, query_type string, rewritten_query string, needs_retrieval boolean")
    hits = spark.createDataFrame([(2, 4)], "query_id long, hits long")
    out = {r.query_id: r.outcome for r in grounding.terminal_outcome(grounding.routed(q, p), hits, grounding.refine_outcome(a, v)).collect()}
    assert out == {1: "skipped", 2: "faithful", 9: "no_candidates"}


def test_requests(spark):
    ask = lambda notes: grounding.answer_request(F.lit("q"), F.lit("factual"), F.lit("b"), F.lit(notes), F.lit(2))
    row = spark.range(1).select(ask("").alias("a"), ask("say less").alias("b"), grounding.critique_request(F.lit("q"), F.lit("x"), F.lit(None)).alias("c")).first()
    assert row.a == "## Asked\nq\n\n## Kind\nfactual\n\n## Sources, cited by number\nb" and row.b == row.a + "\n\n## To mend\nRound 2: say less"
    assert row.c == "## Asked\nq\n\n## Answered\nx"


def test_files_and_runs(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "u1.txt").write_bytes(b" hello \xff ")
    up = corpus.read_uploads(spark, str(tmp_path / "up"))
    assert corpus.extract_text(up).first().text == "hello �"
    (tmp_path / "runs").mkdir()
    run = {"question": "q", "answer": "a", "sources": [{"chunkId": "c"}], "steps": [{"id": "1", "agent": "router", "label": "l", "startedAt": 1, "finishedAt": 3, "durationMs": 2, "status": "completed", "input": {"k": 1}, "output": {"k": 2}}], "totalDurationMs": 2}
    (tmp_path / "runs" / "r1.json").write_text(json.dumps(run))
    runs = corpus.read_runs(spark, str(tmp_path / "runs"))
    assert trace.steps_of(runs).first().run_id == "r1" and trace.sources_of(runs).first().position == 1


def test_index_build(spark, tmp_path):
    """Postings of the stored index are the weights of its chunks, keyed by store order."""
    rows = [("b", 1, "T", "x", 2000, "s", "dogs and mice " * 60), ("a", 0, "Cats", "x", 2000, "s", "cats and dogs"), ("c", 2, None, "x", 2000, "s", None)]
    built = corpus.build_index(spark.createDataFrame(rows, corpus.DOCUMENT), str(tmp_path / "ix"))
    chunks = {r.ord: r for r in spark.read.parquet(str(tmp_path / "ix/chunks")).collect()}
    n = len(chunking.spans("T\n\n" + "dogs and mice " * 60))
    assert n > 1 and [chunks[k].chunk_id for k in sorted(chunks)] == ["a#chunk-1", *(f"b#chunk-{k}" for k in range(1, n + 1)), "c#chunk-1"] and len(chunks) == n + 2
    got = {(r.ord, r.term): (r.tf, round(r.weight, 9)) for r in built.weights().collect()}
    counts = {k: Counter(w for w in re.findall("[a-z0-9]{2,}", c.content.lower()) if w != "and") for k, c in chunks.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(chunks)) / (1 + n)) + 1 for t, n in df.items()}
    norm = {k: math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for k, c in counts.items()}
    assert got == {(k, t): (n, round(n * idf[t] / norm[k], 9)) for k, c in counts.items() for t, n in c.items()}
    assert built.stats.first().total == len(chunks) and {r.term: r.df for r in built.vocab.collect()} == df
    # rebuilt in place
    assert {r.term for r in corpus.build_index(spark.createDataFrame(rows[1:2], corpus.DOCUMENT), str(tmp_path / "ix")).weights().collect()} == {"cats", "dogs"}


def test_corpus_tables(spark, tmp_path):
    assert corpus.read_manifest(spark, str(tmp_path / "none")).count() == 0
    event = lambda i, seq, status: (i, seq, status, None, None)
    corpus.append_events(spark.createDataFrame([event("a", 1, "queued")], corpus.EVENT), str(tmp_path / "e"), 1)
    for _ in range(2):  # a retry doesn't repeat events
        corpus.append_events(spark.createDataFrame([event("a", 2, "completed"), event("b", 1, "failed")], corpus.EVENT), str(tmp_path / "e"), 2)
    (tmp_path / "e" / "odd.json").write_text("{broken\n")
    events = corpus.read_manifest(spark, str(tmp_path / "e")).cache()
    assert events.where("doc_id IS NOT NULL").count() == 3 and events.where("_corrupt_record IS NOT NULL").count() == 1
    manifest = ingest.current_manifest(events.where("doc_id IS NOT NULL")).select(F.col("doc_id").alias("id"), F.col("status").alias("processing_status"))
    corpus.write_extracted(spark.createDataFrame([("a", "text a"), ("b", "text b")], "id string, text string"), str(tmp_path / "x"), 1)
    assert [(r.id, r.text) for r in corpus.read_extracted(spark, str(tmp_path / "x"), manifest).collect()] == [("a", "text a")]
    docs = lambda *ids: spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "doc_id string, doc_ord long")
    assert [(r.doc_id, r.doc_ord) for r in corpus.corpus_union(docs("p", "q"), docs("r", "s")).orderBy("doc_ord").collect()] == [("p", 0), ("q", 1), ("r", 2), ("s", 3)]
    assert [r.doc_ord for r in corpus.corpus_union(docs("p").limit(0), docs("r")).collect()] == [0]


def test_recovery_and_lookup(spark):
    m = spark.createDataFrame([("a", "completed"), ("b", "completed"), ("c", "completed"), ("d", "failed")], "id string, processing_status string")
    text = lambda *rows: spark.createDataFrame(list(rows), "id string, text string")
    good, bad = ingest.recover_missing(m, text(("a", "x" * 30)), text(("b", " " + "y" * 20 + " "), ("d", "z" * 30)))
    assert [(r.id, r.text) for r in good.collect()] == [("b", "y" * 20)] and [(r.id, r.status) for r in bad.collect()] == [("c", "failed")]
    assert {(r.id, r.found) for r in ingest.lookup(m, text(("a", ""), ("e", ""))).collect()} == {("a", True), ("e", False)}


def test_results_of_a_request(spark):
    u = spark.createDataFrame(
        [(1, i, i, h, n, "text/plain", s) for i, (h, n, s) in enumerate([("h1", "a.txt", 10), ("h2", "a.exe", 10), ("h3", "a.txt", 400), ("h4", "a.txt", 200), ("h5", "a.txt", 90), (None, "a.txt", 5), ("h6", "a.txt", 0)])]
        + [(2, 3_000_000_000, 99, "h7", "a.txt", "text/plain", 500)],
        "batch_id long, pos long, id long, hash string, original_filename string, mime_type string, size long",
    )
    m = spark.createDataFrame([(7, "h1", "completed"), (8, "h2", "failed")], "id long, hash string, processing_status string")
    got = {r.id: (r.code, r.message, r.existing_id) for r in ingest.ingest_results(u, m, 0, 500).collect()}
    assert got == {0: (409, "duplicate", 7), 1: (400, "extension", None), 2: (201, None, None), 3: (400, "quota", None), 4: (201, None, None), 5: (201, None, None), 6: (400, "empty", None), 99: (201, None, None)}


UPLOAD = "id long, text string, original_filename string, mime_type string, size long"


@pytest.fixture
def streamed(spark, tmp_path):
    def run(name, *rows):
        full = [(i, t, n, "text/plain", len(t or "")) for i, t, n in rows]
        spark.createDataFrame(full, UPLOAD).write.parquet(str(tmp_path / "in" / name))
        source = spark.readStream.schema(UPLOAD).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        stream.start_ingest(source, str(tmp_path / "st"), str(tmp_path / "cp"), 200).awaitTermination()
        return str(tmp_path / "st")

    return run


def test_stream_equals_batches_and_deletion_a_rebuild(spark, tmp_path, streamed):
    one, two, three = "one fish swims in the sea", "two fish swim in the lake", "three birds in the old tree"
    state = streamed("a", (1, one, "a.txt"), (2, one, "b.txt"), (3, two, "c.exe"), (4, None, "d.txt"), (5, "too short", "e.txt"), (6, two, "f.md"))
    codes = lambda: {r.id: (r.code, r.message, r.existing_id) for r in stream.read_state(spark, state, "results").collect()}
    want = {1: (201, None, None), 2: (409, "duplicate", 1), 3: (400, "extension", None), 4: (400, "empty", None), 5: (201, None, None), 6: (400, "mismatch", None)}
    assert codes() == want
    streamed("b", (7, one, "g.txt"), (8, two, "h.txt"), (9, three, "i.txt"), (10, "x" * 180, "j.txt"))
    want |= {7: (409, "duplicate", 1), 8: (201, None, None), 9: (201, None, None), 10: (400, "quota", None)}
    assert codes() == want
    terms = lambda: {r.term: r.df for r in stream.chunk_index(spark, state).vocab.collect()}
    plain = lambda *texts: Counter(w for t in texts for w in {w for w in re.findall("[a-z0-9]{2,}", t) if w not in STOPWORDS})
    assert terms() == plain("a txt " + one, "h txt " + two, "i txt " + three)
    for _ in range(2):  # a retry of the deletion changes nothing
        stream.delete(spark, state, spark.createDataFrame([(8,), (5,), (77,)], "id long"), 1)
    assert {r.id for r in stream.documents(spark, state).collect()} == {1, 9} and terms() == plain("a txt " + one, "i txt " + three)
    rebuilt = {r.term: round(r.idf, 9) for r in stream.chunk_index(spark, state).vocab.collect()}
    assert rebuilt == {t: round(math.log(3 / (1 + n)) + 1, 9) for t, n in terms().items()}
    # what was deleted may come again
    streamed("c", (11, two, "k.txt"))
    assert codes()[11] == (201, None, None) and {r.id for r in stream.documents(spark, state).collect()} == {1, 9, 11}


def test_status_stream_follows_changes(spark, tmp_path, streamed):
    def counts():
        stream.start_status_counts(spark, state, str(tmp_path / "out"), str(tmp_path / "out-cp")).awaitTermination()
        return {r.status: r.n for r in stream.status_counts(spark, str(tmp_path / "out")).collect()}

    state = streamed("a", (1, "one fish swims in the sea", "a.txt"), (2, "short", "b.txt"))
    assert counts() == {"completed": 1, "failed": 1}
    streamed("b", (3, "two fish swim in the lake", "a.txt"))
    stream.delete(spark, state, spark.createDataFrame([(1,)], "id long"), 1)
    assert counts() == {"completed": 1, "failed": 1} and counts() == {"completed": 1, "failed": 1}


def test_a_batch_without_its_events_does_not_count(spark, tmp_path, streamed):
    state = streamed("a", (1, "one fish swims in the sea", "a.txt"))
    ghost = spark.createDataFrame([(9, 0, "h", 5, "g.txt", "ghost text that nobody accepted")], "id long, owner long, hash string, size long, title string, text string")
    stream._write(ghost, state, "documents", "7")
    assert {r.id for r in stream.documents(spark, state).collect()} == {1}


def test_copies_of_a_refused_file_are_refused_for_themselves(spark, tmp_path, streamed):
    big = "a text that is longer than what is left of the quota " * 3
    state = streamed("a", (1, "one fish swims in the sea " * 2, "a.txt"), (2, big, "b.txt"), (3, big, "c.txt"), (4, "one fish swims in the sea " * 2, "d.exe"), (5, "short", "e.txt"), (6, "short", "f.txt"))
    got = {r.id: (r.code, r.message, r.existing_id) for r in stream.read_state(spark, state, "results").collect()}
    assert got == {1: (201, None, None), 2: (400, "quota", None), 3: (400, "quota", None), 4: (409, "duplicate", 1), 5: (201, None, None), 6: (201, None, None)}


def judged_in_order(files, limit):
    """One file after the other, as a request is worked off."""
    used, held, out = {}, {}, {}
    for i, owner, h, name, size, good in sorted(files):
        if (owner, h) in held:
            out[i] = (409, "duplicate", held[owner, h])
        elif name.endswith(".exe"):
            out[i] = (400, "extension", None)
        elif used.get(owner, 0) + size > limit:
            out[i] = (400, "quota", None)
        else:
            out[i] = (201, None, None)
            used[owner] = used.get(owner, 0) + size
            if good:
                held[owner, h] = i
    return out


def test_uploads_are_judged_as_one_after_the_other(spark):
    rng = random.Random(12)
    contents = {h: (rng.choice([3, 10, 40, 90]), rng.random() < 0.8) for h in "abcdefghijklmnop"}
    files = [(i, rng.randint(0, 3), h := rng.choice("abcdefghijklmnop"), rng.choice(["x.txt", "x.txt", "y.exe"]), *contents[h]) for i in range(600)]
    rows = spark.createDataFrame(files, "id long, owner long, hash string, original_filename string, size long, good boolean").withColumn("mime_type", F.lit("text/plain"))
    known = spark.createDataFrame([], "owner long, hash string, old long")
    got = ingest.judged_uploads(rows, known, spark.createDataFrame([], "batch_id long, used long"), 250).collect()
    assert {r.id: (r.code, r.message, r.existing_id) for r in got} == judged_in_order(files, 250)


def test_quota_in_rounds_equals_the_fold(spark):
    rng = random.Random(5)
    rows = [(b, i, rng.choice([1, 5, 20, 100, 400, None])) for b in range(4) for i in range((900, 40, 300, 3)[b])]
    limits = {0: 0, 1: 350, 2: 990}
    want = {}
    for b in range(4):
        left = 1000 - limits.get(b, 0)
        for _, i, size in sorted(r for r in rows if r[0] == b):
            want[b, i] = (size or 0) <= left
            left -= (size or 0) if want[b, i] else 0
    uploads = spark.createDataFrame(rows, "batch_id long, pos long, size long").repartition(5)
    used = spark.createDataFrame(list(limits.items()), "batch_id long, used long")
    for fold in (10_000, 50, 5):
        got = ingest.quota_check(uploads, used, 1000, fold).collect()
        assert len(got) == len(rows) and {(r.batch_id, r.pos): r.accepted for r in got} == want
    assert ingest.quota_check(uploads.limit(0), 0, 10).count() == 0


def problems_in_order(events):
    """What a plain walk over the events finds."""
    before, out = {}, []
    for doc, seq, status, ts in sorted(events, key=lambda e: (str(e[0]), e[1])):
        was, at = before.get(doc, (None, None))
        if status not in ingest.FLOW or status is None:
            out.append((doc, seq, was, status, "unknown"))
        elif at and ts < at:
            out.append((doc, seq, was, status, "out_of_order"))
        elif status == was:
            out.append((doc, seq, was, status, "repeated"))
        elif at is None and status != "queued" or at and was in ingest.FLOW and was and status not in ingest.FLOW[was]:
            out.append((doc, seq, was, status, "illegal"))
        before[doc] = (status, ts)
    return sorted(out, key=str)


def test_a_task_folds_its_small_batches_one_after_the_other(spark):
    sizes = spark.range(12_000).select(F.nullif(F.col("id") % 3000, F.lit(7)).alias("batch_id"), F.col("id").alias("pos"), (F.col("id") * 7919 % 10).alias("size"))
    got = ingest.quota_check(sizes, limit=10)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    left, want = {}, {}
    for r in sizes.orderBy("pos").collect():
        want[r.pos] = fits = r.size <= left.setdefault(r.batch_id, 10)
        left[r.batch_id] -= r.size if fits else 0
    assert {r.pos: r.accepted for r in got.where("batch_id IS NOT NULL").collect()} == {r.pos: want[r.pos] for r in sizes.where("batch_id IS NOT NULL").collect()}
    assert False in want.values()


def test_texts_are_written_in_row_groups_that_tasks_can_share(spark, tmp_path):
    texts = spark.range(6000, numPartitions=1).select("id", F.concat(*(F.sha2(F.concat("id", F.lit(f"-{k}")), 512) for k in range(40))).alias("text"))
    held = index.Index(spark, str(tmp_path / "index"), "id", postings=False)
    held.add(texts.select("id", F.regexp_replace("text", "(.{8})", "$1 ").alias("text")), "first")
    for written in (materialise(texts, "texts", texts=True), stream._write(texts, str(tmp_path), "documents", "0"), held.forward()):
        groups = [pq.ParquetFile(f.split(":", 1)[1].replace("///", "/")).num_row_groups for f in written.inputFiles()]
        assert len(groups) == 1 and groups[0] > 2


def test_problems_of_lifecycles_equal_a_walk(spark):
    rng = random.Random(4)
    start, rows = datetime(2024, 1, 1), []
    stages = [*filter(None, ingest.FLOW), "lost", None]
    for seq in range(3000):  # one document has a third of all events
        doc = rng.choice([7, rng.randint(0, 60), None if seq % 50 == 0 else 3])
        status = rng.choice(stages) if rng.random() < 0.5 else rng.choice(stages[:5])
        rows.append((doc, seq, status, start + timedelta(minutes=seq - rng.choice([0, 0, 0, 90]))))
    frame = spark.createDataFrame(rows, "doc_id long, seq long, status string, ts timestamp").repartition(5).withColumn("was", F.lit("a clashing name"))
    found = ingest.lifecycle_problems(frame).collect()
    assert sorted((tuple(r) for r in found), key=str) == problems_in_order(rows)
    assert {r.problem for r in found} == {"unknown", "out_of_order", "repeated", "illegal"}
    good = [(1, k, s, start) for k, s in enumerate(("queued", "extracting", "chunking", "embedding", "completed", "deleted"))]
    assert ingest.lifecycle_problems(spark.createDataFrame(good, "doc_id long, seq long, status string, ts timestamp")).count() == 0
    # a row that is there twice repeats its status
    assert [tuple(r) for r in ingest.lifecycle_problems(spark.createDataFrame([good[0], *good], "doc_id long, seq long, status string, ts timestamp")).collect()] == [(1, 0, "queued", "queued", "repeated")]
    assert ingest.lifecycle_problems(frame.limit(0)).count() == 0


def test_lifecycles_of_the_stream_have_no_problems(spark, streamed):
    state = streamed("a", (1, "one fish swims in the sea", "a.txt"), (2, "short", "b.txt"))
    stream.delete(spark, state, spark.createDataFrame([(1,)], "id long"), 1)
    events = stream.read_state(spark, state, "events").selectExpr("id AS doc_id", "seq", "status", "CAST(NULL AS TIMESTAMP) AS ts")
    assert events.count() == 9 and ingest.lifecycle_problems(events).count() == 0


def test_questions_meet_earlier_ones(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(18)]
    asked = {q: " ".join(["common", *rng.choices(words, k=rng.randint(1, 6))]) for q in range(60)} | {60: "", 61: None, 62: "unheard"}
    store = spark.createDataFrame([(k, " ".join(["common", *rng.choices(words, k=5)])) for k in range(30)], "doc_id long, text string")
    held = index.build(store, str(tmp_path / "index"))
    schema, runs = "query_id long, question string", []

    def come(ids):
        runs.append(1)
        spark.createDataFrame([(q, asked[q]) for q in ids], schema).write.parquet(str(tmp_path / "in" / f"part-{len(runs)}"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "part-*"))
        questions.start_matching(source, str(tmp_path / "cache"), str(tmp_path / "cp"), held.weights_of, held.vocab, 0.7).awaitTermination()

    found = lambda: {(r.query_id, r.earlier): r.score for r in questions.matches(spark, str(tmp_path / "cache")).collect()}
    come(range(40, 63))
    first = found()
    come([])
    come([*range(0, 20), 5])  # a row twice
    come(range(20, 40))
    weights = held.weights_of(spark.createDataFrame(list(asked.items()), schema)).collect()
    vec = {}
    for r in weights:
        vec.setdefault(r.query_id, {})[r.term] = r.weight
    arrival = lambda q: (0 if q >= 40 else 1 if q < 20 else 2, q)
    want = {}
    for a in vec:
        for b in vec:
            score = round(sum(w * vec[b].get(t, 0.0) for t, w in vec[a].items()), 6)
            if arrival(b) < arrival(a) and score >= 0.7:
                want[a, b] = score
    assert found() == pytest.approx(want) and len(want) > 20
    assert first and all(min(p) >= 40 for p in first) and first.items() <= found().items()
