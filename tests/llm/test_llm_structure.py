"""Fingerprints by consistent parsing, token alignment and runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import consistent_parsing as parsing
from corpusloom.llm import periodic_runs, queries, token_alignment
from corpusloom.sources.shared import materialise

SF = "/root/testdata/sf0.001"
WORDS = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents():
    """Nulls, empty, blank, very short, periodic, long and repeated texts, repeated and null ids."""
    rng = random.Random(3)
    base = prose(rng, 300)
    texts = [
        None, "", " ", "a", "ab", "aaaa", "\t\n", base, base, base[:800] + prose(rng, 100), "x " * 5000, "a b " * 100 + "c", prose(rng, 30) + " ", " lead", "two  blanks   three",
        "café 中文 \U0001f600", "▁ block", "say <|endoftext|> or </s> <s> <0x41>", "nul \x00 and \x0b tab", "é ﬁ Å  nbsp", "\r\n" * 40, "ab" * 3000, prose(rng, 6000),
        " ".join(["one two three"] * 8 + ["four"] + ["one two three"] * 9),
    ]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(7, base), (7, "other text under the same id"), (None, "no id " * 20), (None, None)]


def frame(spark, rows):
    made = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, n_chars string, block int, part int")
    return made.repartition(3)


# fingerprints


def key(row):
    return (row[0] is None, -(row[0] or 0))


def test_fingerprint_columns_by_brute_force(spark):
    rows = [r for r in odd_documents() if r[0] not in (7, None)] + [(None, "no id " * 20)]
    got = parsing.compare_with_next(frame(spark, rows))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = {r["doc_id"]: r for r in got.collect()}
    order = sorted(rows, key=key)
    assert len(got) == len(rows)
    prints = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        prints.setdefault(text, got[i]["fingerprint"])
        assert prints[text] == got[i]["fingerprint"]
        one, two, next_ = (parsing.Parsed([t.encode()]) for t in (text, new, after))
        assert got[i]["fingerprint"] == one.strings()[0] and got[i]["edited_fingerprint"] == two.strings()[0]
        assert got[i]["near_edited"] == parsing.likeness(one, two)[0] and got[i]["near_next"] == parsing.likeness(one, next_)[0]
        if text == new:
            assert got[i]["near_edited"] == 1
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_repeated_ids_and_empty_tables(spark):
    got = parsing.compare_with_next(frame(spark, odd_documents())).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd_documents())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert parsing.compare_with_next(frame(spark, []).limit(0)).count() == 0
    alone = parsing.compare_with_next(frame(spark, [(1, prose(random.Random(1), 200))])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1
    prints = {r["doc_id"]: r["fingerprint"] for r in parsing.fingerprints(frame(spark, [(1, "abc"), (2, None), (3, "")])).collect()}
    assert prints[2] == prints[3] != prints[1]
    back = parsing.parsed(list(prints.values()))
    assert back.strings() == list(prints.values())


def phrases(text):
    """Names of each level."""
    return [set(names.tolist()) for names, _, _ in parsing._levels([text.encode()])]


def test_equal_passages_have_equal_phrases_wherever_they_stand():
    rng = random.Random(5)
    for _ in range(30):
        passage = prose(rng, 120)
        at = [prose(rng, rng.randint(0, 40)) + "x" * rng.randint(0, 7) + passage + "y" * rng.randint(0, 7) + prose(rng, rng.randint(0, 40)) for _ in range(2)]
        for level, (own, a, b) in enumerate(zip(phrases(passage)[:4], phrases(at[0]), phrases(at[1]), strict=False), 1):
            # all but some at the ends
            ends = 16 if level < 4 else 20
            assert len(own - a) <= ends and len(own - b) <= ends, level
            assert len(own & a & b) >= len(own) - 2 * ends


def test_phrases_are_short_and_cover_their_text():
    rng = random.Random(6)
    for text in (prose(rng, 500), "ab" * 900, "abc" * 500, "a" * 999, "aab" * 400, "".join(chr(rng.randint(1, 0x2FF)) for _ in range(3000))):
        count = [int(c[0]) for _, _, c in parsing._levels([text.encode()])]
        assert count[-1] == 1 and all(y <= x / 2 + 1 for x, y in zip(count, count[1:]))
        assert count[0] >= len(set(text)) / 16


def test_likeness_estimates_the_common_share():
    rng = random.Random(8)
    near, far = [], []
    for _ in range(60):
        a, b = prose(rng, 400), prose(rng, 400)
        x, y, z = (parsing.Parsed([t.encode()]) for t in (a, parsing.edited(a, b), b))
        near.append(parsing.likeness(x, y)[0])
        far.append(parsing.likeness(x, z)[0])
        assert parsing.likeness(x, x)[0] == 1
    # two thirds of both: half of all phrases
    assert 0.42 < np.mean(near) < 0.58 and min(near) > 0.25 and np.mean(far) < 0.08


def test_op11_over_a_given_table(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op11_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        assert got[i]["edited_sha256"] == hashlib.sha256(parsing.edited(text, after).encode()).hexdigest()
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.98


# alignment


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.vocabulary())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(plain))}

    def tokens(text):
        """(id, bytes) of both sides, or two empty lists."""
        if not text:
            return [], []
        one = a.encode(f" {text}", add_special_tokens=False)
        left = [(i, bytes(map(byte_of.__getitem__, t))) for i, t in zip(one.ids, one.tokens, strict=True)]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = f" {text}".encode()
        return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])

    return tokens


def aligned_by_hand(rows, tokens):
    count, each = Counter(), []
    for i, text in rows:
        left, right = tokens(text)
        spans = []
        for side in (left, right):
            at, out = 0, []
            for k, x in side:
                out.append((at, at := at + len(x), k))
            spans.append(out)
        over = [(x, y) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(spans[0]) * len(spans[1]) < 10**6 else None
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        last = [{e: k for _, e, k in side} for side in spans]
        links = [(last[0][e], last[1][e]) for e in ends]
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(k) for a, z, k in side if start <= a and z <= e) for side in spans) if len(left) < 3000 else None)
            start = e
        count.update(links)
        each.append((i, left, right, groups, links, over))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, left, right, groups, links, over in each:
        sha = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(count[x] == most[x[1]] for x in links)
        out.append((i, len(left), len(right), len(groups), len(links), best, sum(count[x] for x in links), sha, None if over is None else len(over)))
    return out


def same_alignment(got, rows, tokens):
    want = sorted(aligned_by_hand(rows, tokens), key=str)
    got = sorted((tuple(r) for r in got), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and w[7] in (None, g[7]) and w[8] in (None, g[8]), (g, w)


def align(spark, rows):
    aligned = token_alignment.align(frame(spark, rows), queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model"))
    aligned = aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    out = token_alignment.alignment_counts(materialise(aligned, "aligned"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps").collect()


def test_alignment_of_odd_documents(spark, sides):
    same_alignment(align(spark, odd_documents()), odd_documents(), sides)
    assert align(spark, []) == []
    same_alignment(align(spark, [(1, None), (2, "▁")]), [(1, None), (2, "▁")], sides)


def test_overlaps_of_random_cuts():
    rng = random.Random(2)
    for _ in range(50):
        starts, docs, base = ([], []), ([], []), 0
        for d in range(3):
            n = rng.randint(1, 12)
            for side in (0, 1):
                cut = [0, *sorted(rng.sample(range(1, n), rng.randint(0, n - 1)))]
                starts[side].extend(base + c for c in cut)
                docs[side].extend([d] * len(cut))
            base += n
        ends = [[*s[1:], base] for s in starts]
        want = {(x, y) for x in range(len(starts[0])) for y in range(len(starts[1])) if starts[0][x] < ends[1][y] and starts[1][y] < ends[0][x]}
        a, b = token_alignment.overlaps(*(np.array(v) for v in (docs[0], starts[0], docs[1], starts[1])))
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_op12_over_a_given_table(spark, sides):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same_alignment(queries.op12_token_alignment(spark, SF).collect(), rows, sides)


# runs


def runs_by_hand(words):
    """(start, length, period) of all runs: for each period the stretches of equal words."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    w = np.array([ids[x] for x in words], np.int64)
    found = {}
    for q in range(1, len(w) // 3 + 1):
        equal = np.concatenate([[False], w[q:] == w[:-q], [False]])
        edge = np.flatnonzero(equal[1:] != equal[:-1])
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = end - start + q
            if length >= max(24, 3 * q):
                found.setdefault((start, length), q)  # the least period comes first
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def edited_words(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if i is not None and words:
        h = zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


def runs_row(i, words):
    runs = runs_by_hand(words)
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_runs_of_random_words(spark):
    rng = random.Random(9)
    rows = []
    for k in range(400):
        letters = "abcd"[: rng.randint(1, 4)]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):  # powers, some cut short, beside and within each other
            at, unit = rng.randint(0, len(words)), [rng.choice(letters) for _ in range(rng.randint(1, 14))]
            words[at:at] = (unit * 12)[: rng.randint(10, 80)]
        rows.append((k, rng.choice([" ", "\t", "  "]).join(words)))
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(frame(spark, rows)).collect()}
    seen = 0
    for i, text in rows:
        want = runs_by_hand(text.split())
        seen += len(want)
        assert [tuple(r) for r in got[i]["runs"]] == want, text
    assert seen > 300


def test_runs_of_odd_documents(spark):
    found = periodic_runs.find_runs(frame(spark, odd_documents())).collect()
    got = Counter((r["doc_id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in found)
    want = Counter()
    for i, text in odd_documents():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = runs_by_hand(words)
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[i, tuple(runs), " ".join(w for k, w in enumerate(words) if k not in drop)] += 1
    assert got == want
    assert periodic_runs.find_runs(frame(spark, [])).count() == 0


def test_a_long_document_of_one_word_and_one_of_a_long_period(spark):
    rng = random.Random(4)
    unit = [rng.choice(WORDS) for _ in range(20_000)]
    rows = [(1, "x " * 200_000), (2, " ".join(unit * 4)), (3, " ".join(f"{' '.join(unit[:16])} {k}" for k in range(8000)))]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs.find_runs(frame(spark, rows)).collect()}
    assert got == {1: [(0, 200_000, 1)], 2: [(0, 80_000, 20_000)], 3: []}


def test_op13_over_a_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect())
    assert got == sorted(runs_row(i, edited_words(i, t)) for i, t in rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_repeated_texts_by_brute_force(spark):
    rows = odd_documents() + [(k, prose(random.Random(k), k % 40)) for k in range(100, 400)]
    got = Counter((r["doc_id"], tuple((r["text"] or "").split())) for r in periodic_runs.repeated(frame(spark, rows)).collect())
    assert got == Counter((i, tuple(" ".join(edited_words(i, t)).split())) for i, t in rows)
