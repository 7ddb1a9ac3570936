"""Methods against brute force, planted cases and held-out rows."""

import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chunk_dedup, grid_join, language_id, quality, secret_scan
from corpusloom.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Letters of an encoding and from which length on nine of ten are found among many times as many words.
PLANTED = {
    "hex": (DIGITS + "ABCDEF", 24), "base32": (UPPER + "234567", 40), "base36": (LOWER + DIGITS, 24), "base52": (LOWER + UPPER, 64), "base64": (LOWER + UPPER + DIGITS + "+/", 40),
    "letters": (LOWER, 96),
}


def ordinary(rng):
    """Words run together, as names and compounds are."""
    parts = ["under", "stand", "ing", "wasser", "flasche", "inter", "nation", "al", "com", "mun", "ica", "tion", "get", "name", "value", "data", "set", "schaft", "recht", "eur", "ment", "able"]
    made = [rng.choice(parts) for _ in range(rng.randint(4, 9))]
    how = rng.randrange(5)
    if how == 0:
        return "".join(made)
    if how == 1:
        return "".join(p.capitalize() for p in made)
    if how == 2:
        return "_".join(made)
    if how == 3:
        return "-".join(made) + str(rng.randint(1, 2030))
    return "/".join(made).upper()


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(31)
    rows, truth = [], {}
    for name, (letters, _) in PLANTED.items():
        for n in (20, 24, 28, 40, 64, 96):
            for _ in range(60):
                code = "".join(rng.choice(letters) for _ in range(n))
                truth[len(rows)] = (name, n, code)
                rows.append(f"{ordinary(rng)} {code} {ordinary(rng)}")
    plain = len(rows)
    rows += [" ".join(ordinary(rng) for _ in range(6)) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    return rows, truth, plain, {r.doc_id: r for r in secret_scan.secret_spans(df).collect()}


def test_random_strings_are_found(planted):
    rows, truth, _, got = planted
    share = defaultdict(list)
    for i, (name, n, code) in truth.items():
        at = rows[i].index(code)
        share[name, n].append(any(s.start <= at and at + n <= s.end for s in (*got[i].base, *got[i].found)))
    share = {k: sum(v) / len(v) for k, v in share.items()}
    for (name, n), x in share.items():
        if n >= PLANTED[name][1]:
            assert x >= 0.9, (name, n, share)


def test_false_discoveries_stay_at_the_level(planted):
    rows, truth, plain, got = planted
    false = sum(len([s for s in r.found if i >= plain or truth[i][2] not in rows[i][s.start : s.end]]) for i, r in got.items())
    true = sum(len(r.found) for r in got.values()) - false
    assert true > 800 and false <= 2 * secret_scan.FDR * (true + false)


def test_base_spans_equal_re(spark):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rng = random.Random(5)
    bits = ["token", "Secret", "api_key", "APIKEY", "passwd", "=", ":", " ", "'", '"', "abc", "x1.", "AKIA", "Q2W3E4R5", "0f1e2d3c", "deadbeef", "é", "\n", "🙂", "==", "-/"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["token=abcdef " * 700]

    def spans(t):
        out = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = ("assign", "access", "hex")
        return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda s: (s[0], kinds.index(s[1]))))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in secret_scan.secret_spans(df).select("doc_id", secret_scan.spans_text(F.col("base")).alias("b")).collect()}
    assert got == {i: spans(t) for i, t in enumerate(texts)} and len(got[400].split(",")) == 700


def side(x, first, ids):
    batch = pa.record_batch({"seq": pa.array(ids), "copies": pa.array([1] * len(x), pa.int64()), "v": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))})
    return grid_join._Side([batch], np.eye(x.shape[1])[:, :16], first)


def test_a_dense_pair_of_intervals_takes_little_memory():
    """Two intervals of 4,096 vectors that all link: 16.8 million pairs."""
    rng = np.random.default_rng(2)
    x = np.ones((8192, 64)) + rng.normal(size=(8192, 64)) * 0.02
    tracemalloc.start()
    unit = grid_join._Unit(side(x[:4096], 0, range(4096)), side(x[4096:], 4096, range(4096, 8192)), 0.95)
    rows = unit.rows()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and rows.num_rows == 8192 + 8191
    assert set(rows.column("links").drop_null().to_pylist()) == {4096} and set(rows.column("b").drop_null().to_pylist()) == {0}


def test_grid_join_over_many_intervals(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "LEAST", 32)
    monkeypatch.setattr(grid_join, "MOST", 64)
    monkeypatch.setattr(grid_join, "LEAF", 8)
    monkeypatch.setattr(grid_join, "SPARSE", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 700)] + rng.normal(size=(700, 24)) * 0.17
    x[600:] = x[600]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(700), x)], "vec_id long, embedding array<float>")
    y = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    u = y / np.linalg.norm(y, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    label = np.arange(700)
    while (new := np.where(hit, label, 700).min(1)).tolist() != label.tolist():
        label = new
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_join.cosine_groups(df).collect()}
    assert got == {i: (int(hit[i].sum()) - 1, int(label[i])) for i in range(700)} and len(set(label.tolist())) >= 30


def test_passages_that_repeat_are_found(spark, monkeypatch):
    """Passages of 51 words and more in other surroundings; a common line that gets salts."""
    monkeypatch.setattr(chunk_dedup, "HEAVY", 20)
    monkeypatch.setattr(chunk_dedup, "SHARE", 64)
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    line = make(12)
    passages = [make(rng.randint(51, 90)) for _ in range(60)]
    rows, held = [], defaultdict(list)
    for i in range(300):
        parts = [make(rng.randint(5, 80)), line]
        for k in rng.sample(range(60), rng.choice([0, 0, 1, 2])):
            parts += [passages[k], make(rng.randint(3, 40))]
            held[k].append(i)
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert chunk_dedup._frequent(df, 4)
    text, spans = dict(rows), defaultdict(list)
    for r in chunk_dedup.repeated_passages(df).collect():
        spans[r.doc_id].append((r.start, r.end, r.is_first, r.first_doc_id))
    copies = [(k, i) for k, ids in held.items() if len(ids) > 1 for i in ids]
    found = 0
    for k, i in copies:
        at = text[i].index(passages[k])
        within = lambda a, b: min(b, at + len(passages[k])) - max(a, at)
        found += sum(max(0, within(a, b)) for a, b, *_ in spans[i]) > len(passages[k]) / 2
        assert all(f == (i == min(held[k])) for a, b, f, _ in spans[i] if within(a, b) > len(passages[k]) / 2)
    assert len(copies) > 150 and found >= 0.99 * len(copies)
    # nothing but repeated passages, and what stands around them for a chunk or two
    clean = set(text) - {i for _, i in copies}
    assert not clean & set(spans)
    kept = {r.doc_id: r.deduplicated for r in chunk_dedup.drop_repeated(df).collect()}
    for k, ids in held.items():
        # but for a chunk that begins in the common line and happens to end alike elsewhere
        assert passages[k][40:] in kept[min(ids)]


@given
def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").collect()}
    rows = QUERIES["op2_quality"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.THRESHOLD) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in out if y == 1], [s for s, y in out if y == 0]
    assert len(out) > 60 and sum((s >= 0.7) == (y == 1) for s, y in out) / len(out) >= 0.97
    assert np.mean([[a > b for b in bad] for a in good]) >= 0.98


@given
def test_languages_of_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, SF).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out and docs[r.doc_id].lang and any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert len(out) > 100 and sum(r.lang_pred == docs[r.doc_id].lang for r in out) / len(out) >= 0.98
    assert all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in docs[r.doc_id].text or ""))


@given
def test_rollup_query_equals_a_plain_count(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r.doc_id not in toxic:
            want[r.source, r.lang, "byte_bpe_50k"][0] += 1
            want[r.source, r.lang, "byte_bpe_50k"][1] += len(t.encode(r.text or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in QUERIES["op7_token_rollup"](spark, SF).collect()}
    assert got == dict(want)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept; rows of many kinds."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    parts = {"x": ["an", "the", "ing", "re"], "y": ["ou", "eau", "que", "é"]}
    make = lambda k, n: " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(n))
    rows = []
    for i in range(120):
        k = "xy"[i % 2]
        t = make(k, rng.choice([8, 20, 60]))
        rows.append((t, k))
        if i % 6 == 0:
            rows += [(t, k), (t.upper() if t.isascii() else t, k), (" ".join([*t.split()[:-1], "ing"]), k)]
    rows += [(None, "x"), ("", "y"), ("12 !!", "x"), ("日本語の文章" * 20, None), (make("x", 9000), "x")]
    data = [(i, t, k, [None, "s", "b", "z"][i % 4], len(t or ""), 7) for i, (t, k) in enumerate(rows)]
    data += [data[3], (None, rows[0][0], "x", "s", 5, 7), (data[4][0], "the the the ing another", "x", "b", 5, 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int"
    spark.createDataFrame(data, schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]

    def out(name, docs):
        steps[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    key = lambda r: (r.doc_id, r.text, r.source)
    kept = out("language_id", docs)
    model = language_id.train(docs)
    lang, score = model.predict(pa.array([r[1] for r in data], pa.string()))
    want = Counter((r[0], r[1], r[3]) for r, a, s in zip(data, lang, score) if a != "und" and s >= language_id.ACCEPT)
    held = kept.collect()
    assert Counter(map(key, held)) == want and kept.columns == docs.columns and 0 < len(held) < len(data)

    tr = str.maketrans(UPPER, LOWER)
    exact = out("exact_dedup", kept)
    first = {}
    for r in held:
        t = (r.text or "").translate(tr)
        if t not in first or (r.doc_id is not None and (first[t].doc_id is None or r.doc_id < first[t].doc_id)):
            first[t] = r
    held = exact.collect()
    assert Counter(r.text.translate(tr) for r in held) == Counter(list(first)) and Counter(r.doc_id for r in held) == Counter(r.doc_id for r in first.values())

    near = out("ngram_join", exact)
    sets = []
    for r in held:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(tr))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    label = list(range(len(held)))
    for i in range(len(held)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    best = defaultdict(list)
    for x, r in zip(label, held):
        best[x].append(r.doc_id)
    held = near.collect()
    assert Counter(r.doc_id for r in held) == Counter(min(v, key=lambda i: (i is None, i or 0)) for v in best.values()) and len(held) < len(label)

    mixed = out("mixing", near)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    total = Counter()
    for r in held:
        total[r.source] += size(r)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, free, target, left = dict(zip(names, (5, 2, 1, 5))), set(names), dict.fromkeys(names, 0.0), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    times = Counter(map(key, mixed.collect()))
    assert set(times) <= set(map(key, held)) and max(times.values()) <= 2
    for s in names:
        mine = [r for r in held if r.source == s]
        # whole passes, then the best that documents taken once more can give
        most = int(target[s] + 1e-6)
        rest, sums = most % total[s] if total[s] else 0, 1
        for r in mine:
            sums |= sums << size(r)
        best = max(x for x in range(rest + 1) if sums >> x & 1)
        assert sum(size(r) * times[key(r)] for r in mine) == most - rest + best

    packed = out("packing", mixed).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    length = {r.text: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in held}
    assert Counter(r.doc_id for r in packed for _ in range(r.length)) == Counter(i for (i, x, _), k in times.items() for _ in range(length[x] * k))
    ran = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in ran if r.start == 0) == Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0)
