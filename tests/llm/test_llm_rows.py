"""Rows, not ids, decide: repeated and null ids, columns whose names operators use, crashes on the way."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chunk_dedup, content_sort, language_id, mixing, ngram_join, secret_scan, token_rollup
from corpusloom.llm.queries import vocabulary

#: Names that operators give to columns of their own.
CLASHES = "row, h, th, salt, salts, lead, place, key, size, bucket, times, copy, rank, alt, spans, again, of, id, cls, n, base, tested, redacted, deduplicated, _id, _spans, _copy, _times, start, end"
MORE = ", ".join(f"`{c.strip()}` int" for c in CLASHES.split(","))
KIND = f"doc_id long, text string, lang string, source string, {MORE}"
EXTRA = tuple(range(len(CLASHES.split(","))))


def frame(spark, rows, source=None):
    return spark.createDataFrame([(i, t, None, source, *EXTRA) for i, t in rows], KIND)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_exact_dedup_by_row(spark):
    rows = [(2, "same text"), (2, "a text of its own"), (1, "SAME text"), (3, "rep"), (3, "rep"), (None, "rep"), (None, "alone"), (None, "alone"), (7, None), (8, "")]
    df = frame(spark, rows)
    out = content_sort.exact_dedup(df)
    assert out.columns == df.columns and out.first().asDict()["end"] == EXTRA[-1]
    assert kept(out) == sorted([(1, "SAME text"), (2, "a text of its own"), (3, "rep"), (None, "alone"), (7, None)], key=str)
    assert kept(content_sort.exact_dedup(df, "max")) == sorted([(2, "same text"), (2, "a text of its own"), (3, "rep"), (None, "alone"), (8, "")], key=str)
    many = frame(spark, [(i, "x" * (i % 3)) for i in range(600)])  # texts that get salts
    assert [i for i, _ in kept(content_sort.exact_dedup(many))] == [0, 1, 2]
    assert content_sort.exact_dedup(df.limit(0)).count() == 0


def test_near_dedup_by_row(spark):
    rng = random.Random(3)
    w = words(rng, 60)
    near = " ".join([*w.split()[:-1], "other"])
    own = words(rng, 40)
    rows = [(5, w), (4, near), (4, own), (6, own), (6, own), (None, near), (None, ""), (9, ""), (9, ""), (9, None)]
    df = frame(spark, rows)
    out = ngram_join.near_dedup(df)
    assert out.columns == df.columns
    # the first rows of two components share an id; texts without words all stay
    assert kept(out) == sorted([(4, near), (4, own), (None, ""), (9, ""), (9, ""), (9, None)], key=str)
    again = ngram_join.near_dedup(frame(spark, [(1, w), (1, w), (1, w), (2, near)]))
    assert kept(again) == [(1, w)]
    assert ngram_join.near_dedup(df.limit(0)).count() == 0


def test_clashing_classes_are_told_apart(spark, monkeypatch):
    """All sets in one class key: the second hash must part them."""
    keys = ngram_join._class_keys
    monkeypatch.setattr(ngram_join, "_class_keys", lambda s: (7 if len(s) else 0, keys(s)[1]))
    rng = random.Random(5)
    a, b = words(rng, 30), words(rng, 30)
    df = spark.createDataFrame([(1, a), (2, a), (3, b), (4, None), (5, "x")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_take_mix_by_row(spark):
    rng = random.Random(4)
    rows = [(1, words(rng, n)) for n in (3, 3, 5, 9)] + [(None, words(rng, 4)), (None, words(rng, 4))] + [(i, words(rng, rng.randint(1, 12))) for i in range(10, 60)] + [(99, None)]
    df = frame(spark, rows, "s")
    out = mixing.take_mix(df)
    assert out.columns == df.columns
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    times = Counter((r.doc_id, r.text) for r in out.collect())
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r["size"]] += r.times
    got = Counter()
    for (i, t), k in times.items():
        got[i, size(t)] += k
    assert got == +want and max(times.values()) <= 2
    total = sum(size(t) for _, t in rows)
    assert abs(sum(size(t) * k for (_, t), k in times.items()) - 1.5 * total) <= 2
    assert mixing.take_mix(df.limit(0)).count() == 0


def test_redact_by_row(spark):
    rows = [(1, "a token = abcdefg b"), (1, "b token: hijklmn"), (2, None), (None, "é password=123456, api_key: 'abcdef1' z"), (3, "")]
    df = frame(spark, rows)
    out = secret_scan.redact(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = {(r.doc_id, r.text): r.redacted for r in out.collect()}
    assert got == {rows[0]: "a [secret] b", rows[1]: "b [secret]", rows[2]: None, rows[3]: "é [secret], [secret]' z", rows[4]: ""}
    assert out.first().asDict()["_spans"] == EXTRA[CLASHES.split(", ").index("_spans")]


def test_drop_repeated_by_row(spark):
    rng = random.Random(6)
    passage, own, other = words(rng, 80), words(rng, 120), words(rng, 200)
    rows = [(1, passage), (2, f"{own} {passage}"), (2, other), (3, f"{own[::-1]} {passage}"), (3, f"{own[::-1]} {passage}"), (None, passage), (5, None), (6, "")]
    df = frame(spark, rows)
    out = chunk_dedup.drop_repeated(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id, r.text].append(r.deduplicated)
    assert got[1, passage] == [passage] and got[2, other] == [other] and got[None, passage] == [passage] and got[5, None] == [None] and got[6, ""] == [""]
    (second,), third = got[2, rows[1][1]], got[3, rows[3][1]]
    assert second.startswith(own[:-40]) and len(second) < len(own) + 60 and len(third) == 2 and all(len(t) < len(own) + 60 for t in third)
    # equal rows are one: a passage that only they hold is no repeat
    alone = frame(spark, [(8, own), (8, own), (9, other)])
    assert chunk_dedup.repeated_passages(alone).count() == 0 and kept(chunk_dedup.drop_repeated(alone)) == sorted([(8, own), (8, own), (9, other)], key=str)


def plain(batches):
    """Totals after batches of (doc_id, version, op, source, lang, n)."""
    held = {}
    for batch in batches:
        last = {}
        for i, v, op, s, lang, n in batch:
            if i is not None and v is not None:
                last.setdefault((i, v), []).append((op == "delete", n or 0, s or "", lang or "", s, lang))
        for key, rows in last.items():
            gone, n, _, _, s, lang = max(rows, key=lambda r: r[:4])
            held.pop(key, None)
            if not gone:
                held[key] = (s, lang, n)
    out = defaultdict(lambda: [0, 0])
    for (_, v), (s, lang, n) in held.items():
        out[s, lang, v][0] += 1
        out[s, lang, v][1] += n
    return {k: tuple(x) for k, x in out.items()}


@pytest.fixture
def batches():
    rng = random.Random(9)
    row = lambda: (rng.choice([None, *range(12)]), rng.choice(["v", "w", None]), rng.choice(["insert", "revise", "delete"]), rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice([None, 1, 5, 9]))
    return [[row() for _ in range(rng.choice([0, 1, 8, 20]))] for _ in range(7)]


CHANGE = "doc_id long, version string, op string, source string, lang string, n_tokens long"


def totals(r):
    return {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_rollup_of_random_batches(spark, tmp_path, batches, monkeypatch):
    monkeypatch.setattr(token_rollup, "COMPACT", 3)
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    for k, batch in enumerate(batches, 1):
        assert r.apply(k, spark.createDataFrame(batch, CHANGE)) and not r.apply(k, spark.createDataFrame(batch, CHANGE))
        assert totals(r) == plain(batches[:k])
    assert len(r._commits()[-1]["ledger"]) < 3


@pytest.mark.parametrize("crash", ["ledger", "totals", "-all", "commits", "after commits"])
def test_rollup_after_a_crash(spark, tmp_path, batches, monkeypatch, crash):
    """A batch that dies before or in the middle of any write, then is tried again."""
    monkeypatch.setattr(token_rollup, "COMPACT", 2)
    path = str(tmp_path / "r")
    token_rollup.Rollup(spark, path).apply(1, spark.createDataFrame(batches[0] + batches[1], CHANGE))
    write = token_rollup.Rollup._write
    change = spark.createDataFrame(batches[2] + batches[3], CHANGE)

    def dies(self, rows, folder):
        hit = crash.removeprefix("after ") in folder
        if hit and not crash.startswith("after"):
            if crash != "commits":
                write(self, rows, folder)  # files are there, but no commit names them
            raise RuntimeError("lost")
        write(self, rows, folder)
        if hit:
            raise RuntimeError("lost")
        return folder

    with monkeypatch.context() as m:
        m.setattr(token_rollup.Rollup, "_write", dies)
        with pytest.raises(RuntimeError):
            token_rollup.Rollup(spark, path).apply(2, change)
    r = token_rollup.Rollup(spark, path)
    both = [batches[0] + batches[1], batches[2] + batches[3]]
    assert totals(r) == plain(both if crash.startswith("after") else both[:1])
    assert r.apply(2, change) != crash.startswith("after")
    assert totals(r) == plain(both)
    assert r.apply(3, spark.createDataFrame(batches[4], CHANGE)) and totals(r) == plain([*both, batches[4]])


def test_token_counts_are_those_of_tokenizers(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    odd = ["", "  \n\t x", "don't we'll I'VE 'tis", "日本語 ½ ٣ éé", "<|endoftext|> a<|endoftext|>", "x" * 3000, "a\u00a0b\u2003c", "🙂🙃 \x00"]
    texts = [*odd, *("".join(rng.choice("ab 'sé1½\n.🙂") for _ in range(rng.randint(1, 60))) for _ in range(200)), None]
    t = Tokenizer.from_file(vocabulary())
    df = spark.createDataFrame([(i, x, "s", None, 1) for i, x in enumerate(texts)], "doc_id long, text string, source string, lang string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_rollup.count_tokens(df.unionByName(df.limit(1)), vocabulary()).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_language_models_of_odd_tables(spark):
    rows = [(1, "abc abd", "x"), (1, "abc abd", "x"), (None, "abe", "x"), (2, None, "y"), (3, "", "y"), (4, "k" * 200_000, "z"), (5, "qqq", None)]
    df = spark.createDataFrame([(*r, 1.0, "c") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language_id.train(df)
    kept = language_id.keep_identified(df, model, accept=0.0)
    assert kept.columns == df.columns and kept.count() == 5 and model.langs == ["x", "z"]
    assert language_id.keep_identified(df.limit(0), model).count() == 0 and language_id.keep_identified(df, language_id.train(df.limit(0))).count() == 0


def test_packed_rows_of_equal_documents(spark):
    from corpusloom.llm import packing

    df = frame(spark, [(1, "a b"), (1, "a b"), (None, "a b")])
    rows = packing.pack(df, vocabulary()).collect()
    assert sum(r.length for r in rows) == 9 and all(r.doc_tokens == 3 for r in rows)
    assert np.all(np.array([r.offset + r.length for r in rows]) <= 1024)
    assert packing.pack(df.withColumn("doc_id", F.lit(None).cast("long")), vocabulary()).count() >= 3


def test_language_calibration_takes_all_rows(spark):
    df = spark.range(9_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "fr").otherwise("en").alias("lang"),
        F.concat(F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop"), F.repeat(F.lit(" the word"), (F.col("id") % 7).cast("int"))).alias("text"),
    )
    model = language_id.train(df)
    rows = df.toPandas()
    h, n = model.entropies(pa.array(rows["text"].tolist()))
    k = rows["lang"].map({"en": 0, "fr": 1}).to_numpy()
    own = h[np.arange(len(h)), k]
    for lang in (0, 1):
        mine, size = own[k == lang], n[k == lang]
        mean = np.average(mine, weights=size)
        off, long_ = (mine - mean) ** 2, size >= np.median(size)
        s0 = max(off[long_].mean(), 1e-6)
        np.testing.assert_allclose([model.mean[lang], *model.spread[:, lang]], [mean, s0, max(((off - s0) * size)[~long_].mean(), 1.0)], rtol=1e-9)
    np.testing.assert_allclose(model.limit, np.quantile(model.strays(own, n, k), language_id.QUANTILE) * language_id.MARGIN, rtol=1e-9)
