"""Small fixtures against brute force: nulls, empty and long texts, copies, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chunk_dedup, components, content_sort, grid_join, language_id, mixing, ngram_join, packing, quality, secret_scan, token_rollup
from corpusloom.llm.queries import vocabulary

KIND = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, cls long, score double, keep_id long, rank int, size long, key string"
TR = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "ti", "é"]) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.choice([3, 12, 60, 200]))) for _ in range(25)]
    out = [None, "", " \n\t", "a", "one two three four", "ONE two three four", None, "É é", "é É"]
    for t in base:
        out += [t, t.upper() if t.isascii() else t]
        w = t.split()
        for _ in range(3):
            v = w[:]
            v[rng.randrange(len(v))] = word()
            out.append(" ".join(v))
    out.append(" ".join(word() for _ in range(30_000)))
    out += [base[0]] * 30
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, [None, "s", "b", "z"][i % 4], 1, 1, 2, 3, 0.5, 4, 5, 6, "k") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def normal(t):
    return (t or "").translate(TR)


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return lambda x: find(x)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    find = union_find([e for e in edges if e[0] != e[1]])
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_exact_groups(docs, empty, spark):
    by = defaultdict(list)
    for i, t in enumerate(texts()):
        by[normal(t)].append(i)
    for keep, best in (("max", max), ("min", min)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in content_sort.exact_groups(docs, keep).collect()}
        assert got == {i: (best(g), len(g), i == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for i in g}
    assert content_sort.exact_groups(empty).count() == 0
    assert content_sort.exact_dedup(docs).count() == len(by)
    nulls = spark.createDataFrame([(None, "x"), (None, "x"), (4, "y"), (4, "y")], "doc_id long, text string")
    assert sorted((str(r.keep_id), r.group_size, r.kept) for r in content_sort.exact_groups(nulls).collect()) == [("4", 2, False), ("4", 2, True), ("None", 2, False), ("None", 2, True)]


def test_ngram_join(docs, empty):
    sets = {}
    for i, t in enumerate(texts()):
        w = re.findall(r"[^\x20\x09-\x0D]+", normal(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    edges = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    find = union_find(edges)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_join.ngram_components(empty).count() == 0
    assert ngram_join.near_dedup(docs).count() == len({find(i) for i in sets})


def test_ngram_join_blocks_of_large_groups(spark, monkeypatch):
    """Many texts around the threshold in one group, compared in several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = base[:]
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(20, 120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    find = union_find([(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}


def test_ngram_links_gives_every_link(spark, docs, monkeypatch):
    """Of groups of near copies all pairs, in several blocks and parts; by default a spanning set."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "HUB_GROUP", 16)
    rng = random.Random(11)
    rows = []
    for i in range(70):
        w = [f"w{k}" for k in range(120)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(20, 120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = defaultdict(list)
    for i, t in rows:
        sets[frozenset(tuple(t.split()[k : k + 5]) for k in range(116))].append(i)
    first = {min(ids): s for s, ids in sets.items()}
    want = {(i, j): (len(first[i] & first[j]), len(first[i] | first[j])) for i in first for j in first if i < j}
    want = {k: common for k, (common, union) in want.items() if 100 * common >= 75 * union}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = ngram_join.ngram_links(df, every=True)[1].collect()
    assert len(links) == len(want) > 2 * len(first) and {(min(r.a, r.b), max(r.a, r.b)): r.common for r in links} == want
    some = {(min(r.a, r.b), max(r.a, r.b)) for r in ngram_join.ngram_links(df)[1].collect()}
    find, of_all = union_find(some), union_find(want)
    assert some < set(want) and all(find(i) == of_all(i) for i in first)


def test_ngram_join_of_rows_without_doc_id(spark):
    """A row with a null doc_id links, and links two documents that only it connects."""
    w = [f"w{k}" for k in range(200)]
    change = lambda t, at: [f"x{k}" if k in at else x for k, x in enumerate(t)]
    left, right = change(w, (20, 40, 60, 80)), change(w, (100, 120, 140, 160))
    other = [f"y{k}" for k in range(100)]
    rows = [(1, left), (2, right), (None, w), (None, w), (7, other), (None, change(other, (50,))), (None, ["z"] * 3), (None, []), (9, ["v"])]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (left, w, right)]
    ratio = lambda a, b: len(a & b) / len(a | b)
    assert ratio(sets[0], sets[1]) >= 0.75 and ratio(sets[1], sets[2]) >= 0.75 > ratio(sets[0], sets[2])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_components(df).collect())
    assert got == sorted(
        [("1", 196, "1"), ("2", 196, "1"), ("None", 196, "1"), ("None", 196, "1"), ("7", 96, "7"), ("None", 96, "7"), ("None", 1, "None"), ("None", 0, "None"), ("9", 1, "9")]
    )
    # rows without an id go where one with an id stays; of those that link with nothing all stay
    assert sorted(str(r.doc_id) for r in ngram_join.near_dedup(df).collect()) == ["1", "7", "9", "None", "None"]


def test_secret_spans(docs, empty, spark):
    rng = random.Random(2)
    code = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(64))
    rows = [
        'é token = "abc.def" tOKEN:xy Api-key', "AKIA" + "A1" * 8 + " AKIA12 " + "0f" * 12, "token=token\"=abcdef123", None, "", "x" * 50_000 + " secret: 123456",
        f"see {code} there", "Wordthatisverylongindeedandgoeson plain", "f" * 23,
    ]
    got = [r for r in secret_scan.secret_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").select("doc_id", secret_scan.spans_text(F.col("base")).alias("b"), secret_scan.spans_text(F.col("found")).alias("f")).collect()]
    assert [r.b for r in got] == ["assign:2:18", "access:0:20,hex:28:52", "", "", "", "assign:50001:50015", "", "", ""]
    assert [r.f for r in got] == ["", "", "", "", "", "", "random:4:68", "", ""]
    assert secret_scan.secret_spans(docs).count() == len(texts()) and secret_scan.secret_spans(empty).count() == 0


def test_budget_fit():
    """Against all sums that there are, 3,000 times."""
    rng = random.Random(4)
    for _ in range(3000):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 5) for _ in lengths])
        budget = rng.randint(0, int(lengths @ counts))
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = 1  # as bits
        for size, n in zip(lengths.tolist(), counts.tolist()):
            for _ in range(n):
                sums |= sums << size
        assert lengths @ take == max(s for s in range(budget + 1) if sums >> s & 1)


def test_budget_fit_beyond_what_is_exact(monkeypatch):
    """Where shares alone miss the budget, enough is kept back to meet it."""
    monkeypatch.setattr(mixing, "EXACT_WORDS", 400)
    rng = random.Random(5)
    for _ in range(300):
        lengths = np.array(sorted(rng.sample(range(5, 60), 6)))
        counts = np.array([rng.randint(20, 60) for _ in lengths])
        budget = rng.randint(1000, int(lengths @ counts) - 1000)
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and 0 <= budget - lengths @ take <= (0 if np.gcd.reduce(lengths) == 1 else 60)


def test_mixing(docs, empty):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts())}
    source = {i: [None, "s", "b", "z"][i % 4] for i in size}
    names = ["b", "s", "z", None]
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    weight, target, left = dict(zip(names, (5, 2, 1, 5))), dict.fromkeys(names, 0.0), 1.5 * sum(total.values())
    free = set(names)
    while left > 1e-9 and free:  # round by round
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if target[s] + level * weight[s] > 2 * total[s]}
        if not over:
            for s in free:
                target[s] += level * weight[s]
            break
        for s in over:
            left -= 2 * total[s] - target[s]
            target[s] = 2 * total[s]
        free -= over
    rows = mixing.mix(docs).collect()
    assert {r.doc_id: r["size"] for r in rows} == size
    for s in names:
        mine = [r for r in rows if source[r.doc_id] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == total[s] and r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
        gap = target[s] - sum(r.taken for r in mine)
        # a gap remains only where each document that may still be taken is longer (one has 30,000 words)
        assert 0 <= gap and (gap < 3 or all(r.taken == 2 * r["size"] or r["size"] > gap for r in mine))
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix(empty).count() == 0 and mixing.take_mix(docs).columns == docs.columns


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts())}
    rows = packing.pack(docs, vocabulary()).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert {i: sum(r.length for r in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(empty, vocabulary()).count() == 0


def test_level_choice_is_the_least_sum_of_squares():
    rng = random.Random(8)
    p = packing.LevelPacker(32, 0)
    for _ in range(400):
        before, size = p.count.copy(), rng.randint(1, 31)
        p.add(1, np.ones(size, np.uint32))

        def cost(level):
            n = before.copy()
            n[level] -= level > 0
            n[level + size] += level + size < 32
            return int((n[1:32] ** 2).sum())

        best = min(cost(h) for h in range(0, 33 - size) if h == 0 or before[h])
        assert int((p.count[1:32] ** 2).sum()) == best


def test_rollup(spark, tmp_path, docs, empty):
    kind = "doc_id long, version string, op string, source string, lang string, n_tokens long"
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.apply(1, spark.createDataFrame([(1, "v", "insert", "a", None, 10), (2, "v", "insert", "a", "en", 5), (3, "v", "insert", None, "en", 7), (None, "v", "insert", "a", "en", 1)], kind))
    second = spark.createDataFrame([(1, "v", "revise", "b", None, 12), (2, "v", "delete", None, None, None), (9, "v", "delete", None, None, None), (3, "w", "insert", "a", "en", 1)], kind)
    assert r.apply(2, second) and not r.apply(2, second)
    got = {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert got == {("b", None, "v"): (1, 12), (None, "en", "v"): (1, 7), ("a", "en", "w"): (1, 1)}
    with pytest.raises(ValueError):
        r.apply(0, second)
    assert token_rollup.count_tokens(docs, vocabulary()).count() == len(texts()) and token_rollup.count_tokens(empty, vocabulary()).count() == 0


def test_grid_join(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12))
    x[50:90] = x[49] + rng.normal(size=(40, 12)) * 0.12
    x[100:130] = x[99]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(400, None, 1), (401, [0.0] * 12, 1), (402, [float("nan")] * 12, 1), (403, [1.0, None] * 6, 1), (404, [3.0, 4.0], 1), (405, [6.0, 8.0], 1), (406, [float("inf")] * 12, 1)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    find = union_find([(i, j) for i, j in zip(*np.nonzero(hit)) if i < j] + [(404, 405)])
    links = dict(enumerate((hit.sum(1) - 1).tolist())) | {i: int(i in (404, 405)) for i in range(400, 407)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in grid_join.cosine_groups(df).collect()}
    assert got == {i: (links[i], find(i), find(i) == i) for i in links}
    assert grid_join.cosine_groups(df.limit(0)).count() == 0


def test_repeated_passages(spark, docs, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    own = [" ".join(word() for _ in range(150)) for _ in range(8)]
    rows = [(i, f"{t} é {passage} {t[::-1]}" if i < 3 else t) for i, t in enumerate(own)] + [(20, None), (21, ""), (None, passage)]
    got = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2]
    for r in got:
        assert rows[r.doc_id][1][r.start : r.end] in passage and r.first_doc_id == 0 and r.is_first == (r.doc_id == 0)
    clean = {r.doc_id: r.deduplicated for r in chunk_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == rows[0][1] and len(clean[1]) < len(rows[1][1]) and clean[20] is None
    assert chunk_dedup.repeated_passages(empty).count() == 0 and chunk_dedup.repeated_passages(docs).count() > 0


def test_first_copy_stays_when_parts_stand_earlier(spark):
    """A smaller doc_id holds one chunk of a passage, or half of it as a passage of its own."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    p, q = make(80), make(160)
    ends = chunk_dedup.cut(np.frombuffer(p.encode(), np.uint8), np.array([0, len(p)])).tolist()
    k = len(ends) // 2
    chunk = p[ends[k - 1] - 40 : ends[k]]  # with bytes before it, so that it is cut there too
    rows = [(1, f"{make(60)} {chunk} {make(60)}"), (2, f"{make(60)} {q[: len(q) // 2]} {make(60)}")]
    rows += [(i, f"{make(60)} {t} {make(60)}") for i, t in ((5, p), (6, p), (7, p), (8, q), (9, q))]
    text = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunk_dedup.repeated_passages(df).collect()
    own = {i: [(r.start, r.end, r.is_first) for r in sorted(got, key=lambda r: r.start) if r.doc_id == i] for i in text}
    assert not own[1] and [f for *_, f in own[2]] == [True] and [f for *_, f in own[5]] == [True]
    assert [f for *_, f in own[6]] == [f for *_, f in own[7]] == [f for *_, f in own[9]] == [False]
    assert [f for *_, f in own[8]] == [False, True] and own[8][0][1] == own[8][1][0]
    assert all(r.is_first == (r.first_doc_id == r.doc_id) for r in got)
    held = lambda i, first: "".join(text[i][a:b] for a, b, f in own[i] if f == first)
    # the first chunk of a passage may take bytes from before it
    assert held(8, False) == held(2, True) and (held(8, False) + held(8, True)).endswith(held(9, False)) and len(held(9, False)) > 0.9 * len(q)
    clean = {r.doc_id: r.deduplicated for r in chunk_dedup.drop_repeated(df).collect()}
    assert all(clean[i] == text[i] for i in (1, 2, 5)) and chunk in clean[5]
    assert all(len(clean[i]) < len(text[i]) - len(p) // 2 for i in (6, 7)) and held(8, True) in clean[8] and held(8, False) not in clean[8]


def test_cuts_survive_an_insertion():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    more = np.concatenate([data[:1000], np.frombuffer(b"inserted", np.uint8), data[1000:]])
    chunks = lambda d: Counter(d[a:b].tobytes() for a, b in zip([0, *chunk_dedup.cut(d, np.array([0, len(d)]))], chunk_dedup.cut(d, np.array([0, len(d)]))))
    a, b = chunks(data), chunks(more)
    assert (a & b).total() > 0.9 * a.total()


def test_language_id(spark, docs, empty):
    rng = random.Random(7)
    parts = {"x": ["an", "the", "ing"], "y": ["ou", "eau", "é"]}
    make = lambda k, n: " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(n))
    rows = [(i, make("xy"[i % 2], rng.randint(2, 80)), "xy"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where(~language_id.held_out(F.col("doc_id"))))
    odd = spark.createDataFrame([(1000, None, "x"), (1001, "12 !", "x"), (1002, "", None), (1003, "日本語の文章" * 9, None)], df.schema)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df.unionByName(odd), model).collect()}
    assert sum(got[i][0] == lang for i, _, lang in rows) >= 297
    assert all(got[i] == ("und", 0.0) for i in (1000, 1001, 1002)) and got[1003][1] < language_id.ACCEPT
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = language_id.keep_identified(df.unionByName(odd), model)
    assert kept.columns == df.columns and 285 <= kept.count() <= 300
    assert language_id.identify(empty, model).count() == 0 and language_id.identify(docs, language_id.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(10)
    good = lambda: " ".join("".join(rng.choices(["an", "er", "ti"], k=3)) for _ in range(50))
    rows = [(i, good() if i % 3 else " ".join(w + "$$$" for w in good().split())) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"))
    w = quality.train(df, labels.where(~quality.held_out(F.col("doc_id"))))
    got = quality.score(df, w).join(labels, "doc_id").collect()
    assert all((r.score >= 0.5) == (r.quality == 1) for r in got)
    assert np.array_equal(w, quality.train(df.repartition(7), labels.where(~quality.held_out(F.col("doc_id"))).repartition(3)))
    assert quality.score(docs, w).count() == len(texts()) and quality.score(empty, w).count() == 0
    assert not quality.train(empty, labels).any()
