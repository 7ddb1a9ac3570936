"""Secret scan: fixed patterns, plus a randomness test battery on encoded-looking strings.

DataFrame functions only.  Positions come from matching text as gap, match, gap, match ...; they
count code points, the end exclusive.

Battery, for each run of 20 or more letters, digits and +/_=- outside the fixed patterns' spans.
Its encoding is inferred from its characters (see ENCODINGS); per encoding three tests are made:

* chi-squared of the characters' counts;
* runs: changes between letters and digits, or, where there are letters only, between vowels and
  consonants (changes of case are no sign: ordinary names change it with each word);
* serial correlation of neighbouring characters' places in the alphabet.

Each is held against two models.  Against a uniform choice from the alphabet it must stay within
GATE standard deviations.  Against ordinary text it gives a p-value, the chance that text comes as
near to random: text repeats its letters more, goes from letters to digits seldom but from vowel
to consonant often, and keeps to one end of an alphabet.  The three p-values, bounds from above, are
combined by Fisher's method.

False discoveries: Benjamini-Hochberg at level FDR within each class of encoding and length, over
the whole corpus, from counts of p-values by power of ten.  Short runs thus have to be more
striking than long ones, which are tested with more power.  Digits alone can't be told from
ordinary numbers, and short strings of letters alone seldom from words: such are mostly not found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

# The base patterns and their order.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}()"
HEX = r"[0-9a-f]{24,}()"
RUN = r"[A-Za-z0-9+/_=-]{20,}()"
MIN_VALUE = 6
VOWELS, CONSONANTS, DIGITS = "aeiouy", "bcdfghjklmnpqrstvwxz", "0123456789"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: name, pattern, alphabet in the order of the serial test (upper case is lowered where the alphabet
#: has none), chance of a change between neighbours if uniform, serial correlation that ordinary text
#: has at least; the first whose pattern fits is inferred.
ENCODINGS = (
    ("hex", "[0-9a-f]*|[0-9A-F]*", DIGITS + "abcdef", 0.469, 0.2),
    ("letters", "[a-z]*|[A-Z]*", VOWELS + CONSONANTS, 0.355, 0.0),
    ("base32", "[A-Z2-7]*", UPPER + "234567", 0.305, 0.05),
    ("base36", "[0-9a-z]*|[0-9A-Z]*", LOWER + DIGITS, 0.401, 0.1),
    ("base52", "[A-Za-z]*", LOWER + UPPER, 0.355, 0.15),
    ("base64", ".*", LOWER + DIGITS + "+/" + UPPER, 0.254, 0.25),
)
#: Encodings of letters only.
SOUNDS = (1, 4)

#: Standard deviations within which uniformity must hold.
GATE = 4.0
#: Level of false discoveries in each class.
FDR = 0.01
#: Ordinary text: chance that two characters coincide, that three do; that letters and digits change
#: places at a character, at most; that vowels and consonants do, at least.
COINCIDE, THREE, CHANGE, ALTERNATE = 0.0667, 0.0055, 0.02, 0.62
#: Starts of the length classes; p-values below 10 ** -P_BINS count as that.
LENGTHS = (20, 28, 40, 56, 80)
P_BINS = 30
#: Matches of a text that are gathered before they join the others.
BLOCK = 256


def _spans(text: Column, probe: str, pattern: str, kind: int, least: int = 0) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping matches."""
    parts = [F.regexp_extract_all(text, F.lit(f"(?s)(.*?)(?:({pattern})|\\z)"), F.lit(g)) for g in (1, 2, 3)]
    steps = F.arrays_zip(parts[0].alias("gap"), parts[1].alias("hit"), parts[2].alias("value"))
    kind_of = "array<struct<start:long,kind:int,end:long,value:string>>"
    none = F.array().cast(kind_of)
    # in blocks, as an array is copied when it grows
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("block"), F.array().cast(f"array<{kind_of}>").alias("full"))

    def add(acc: Column, s: Column) -> Column:
        a = acc["at"] + F.char_length(s["gap"])
        b = a + F.char_length(s["hit"])
        value = F.when(F.char_length(s["value"]) > 0, s["value"]).otherwise(s["hit"])
        one = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"), value.alias("value")))
        good = (F.char_length(s["hit"]) > 0) & (F.char_length(value) >= least)
        room = F.size(acc["block"]) < BLOCK
        return F.struct(
            b.alias("at"),
            F.when(~good, acc["block"]).when(room, F.concat(acc["block"], one)).otherwise(one).alias("block"),
            F.when(~good | room, acc["full"]).otherwise(F.concat(acc["full"], F.array(acc["block"]))).alias("full"),
        )

    found = F.aggregate(steps, start, add, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["block"]))))
    return F.when(text.rlike(probe), found).otherwise(none)


def _battery(runs: Column) -> Column:
    """Array of (start, end, enc, length, bin): bin is the whole part of -log10 p, or -1 where
    uniformity fails.  In passes, so that each value is computed once."""
    pick = lambda k, enc: F.element_at(F.array(*(F.lit(e[k]) for e in ENCODINGS)), enc + 1)

    def infer(r: Column) -> Column:
        s = F.replace(F.translate(r["value"], "-_", "+/"), F.lit("="), F.lit(""))
        enc = F.lit(len(ENCODINGS) - 1)
        for k, (_, pattern, *_) in reversed(list(enumerate(ENCODINGS[:-1]))):
            enc = F.when(s.rlike(f"^(?:{pattern})$"), k).otherwise(enc)
        classes = F.regexp_count(s, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))
        sounds = F.regexp_count(F.lower(s), F.lit("[aeiouy](?=[^aeiouy])|[^aeiouy](?=[aeiouy])"))
        changes = F.when(enc.isin(*SOUNDS), sounds).otherwise(classes)
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), s.alias("s"), enc.alias("enc"), changes.cast("double").alias("changes"))

    def count(r: Column) -> Column:
        letters = pick(2, r["enc"])
        s = F.when(r["enc"].isin(0, 1) | ((r["enc"] == 3) & ~r["s"].rlike("[a-z]")), F.lower(r["s"])).otherwise(r["s"])
        n = F.char_length(s).cast("long")
        squares = F.aggregate(
            F.split(letters, ""), F.lit(0).cast("long"),
            lambda acc, c: acc + (n - F.char_length(F.replace(s, c, F.lit("")))) * (n - F.char_length(F.replace(s, c, F.lit("")))),
        )
        size = F.char_length(letters)
        # twice the distance of each character's place from the alphabet's middle: odd whole numbers
        codes = F.transform(F.split(s, ""), lambda c: (2 * F.position(c, letters) - 1 - size).cast("long"))
        start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("product"))
        product = F.aggregate(codes, start, lambda acc, x: F.struct(x.alias("last"), (acc["product"] + acc["last"] * x).alias("product")), lambda acc: acc["product"])
        return F.struct(
            r["start"].alias("start"), r["end"].alias("end"), r["enc"].alias("enc"), r["changes"].alias("changes"),
            n.cast("double").alias("n"), size.cast("double").alias("size"), squares.cast("double").alias("squares"), product.cast("double").alias("product"),
        )

    def test(r: Column) -> Column:
        n, size, squares, c = r["n"], r["size"], r["squares"], r["changes"]
        change, kept = pick(3, r["enc"]), pick(4, r["enc"])
        serial = r["product"] / ((size * size - 1) / 3) / (n - 1)
        z_chi = (size * squares / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        z_runs = (c - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        uniform = (F.abs(z_chi) <= GATE) & (F.abs(z_runs) <= GATE) & (F.abs(serial * F.sqrt(n - 1)) <= GATE)
        pairs = n * (n - 1) / 2
        var = pairs * (COINCIDE - COINCIDE * COINCIDE) + n * (n - 1) * (n - 2) * (THREE - COINCIDE * COINCIDE)
        z_text = ((squares - n) / 2 - pairs * COINCIDE) / F.sqrt(var)
        # bounds of the tails as -log10 p: Gaussian, Chernoff of Poisson and binomial, Gaussian
        ten = math.log(10)
        p_chi = F.when(z_text < 0, z_text * z_text / (2 * ten) + math.log10(2)).otherwise(0.0)
        mean, share = n * CHANGE, F.greatest(c, F.lit(0.5)) / (n - 1)
        p_class = F.when(c > mean, c * F.log10(c / mean) - (c - mean) / ten).otherwise(0.0)
        apart = share * F.log10(share / ALTERNATE) + (1 - share) * F.log10((1 - share) / (1 - ALTERNATE))
        p_sound = F.when(share < ALTERNATE, (n - 1) * apart).otherwise(0.0)
        p_serial = F.when(serial < kept, (kept - serial) * (kept - serial) * (n - 1) / (2 * ten)).otherwise(0.0)
        p = p_chi + F.when(r["enc"].isin(*SOUNDS), p_sound).otherwise(p_class) + p_serial
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["enc"].alias("enc"), n.alias("n"), uniform.alias("uniform"), p.alias("p"))

    def judge(r: Column) -> Column:
        # chi-squared of 6 degrees of freedom at twice the sum of -ln p
        total = r["p"] * math.log(10)
        fisher = r["p"] - F.log10(1 + total + total * total / 2)
        found = F.least(F.floor(F.greatest(fisher, F.lit(0.0))), F.lit(P_BINS))
        kind = sum(((r["n"] >= x).cast("int") for x in LENGTHS[1:]), F.lit(0))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["enc"].alias("enc"), kind.alias("length"), F.when(r["uniform"], found).otherwise(-1).cast("int").alias("bin"))

    out = F.filter(F.transform(runs, infer), lambda r: F.char_length(r["s"]) >= LENGTHS[0])
    for step in (count, test, judge):
        out = F.transform(out, step)
    return out


def _tested(rows: DataFrame) -> DataFrame:
    """rows (text not null, ...) with base, the fixed patterns' spans, and tested, the battery's runs."""
    text = F.col("text")
    # the look-behind keeps the search from trying every place within a run again
    run = f"(?<![A-Za-z0-9+/_=-]){RUN}"
    rows = rows.withColumn("base", F.concat(_spans(text, ASSIGN, ASSIGN, 0, MIN_VALUE), _spans(text, ACCESS, ACCESS, 1), _spans(text, HEX, HEX, 2)))
    rows = rows.withColumn("runs", _spans(text, run, run, 3))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    thin = lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))
    return rows.withColumn("tested", _battery(free)).withColumn("base", F.transform("base", thin)).drop("runs")


def _limits(tested: DataFrame) -> dict[int, int]:
    """Benjamini-Hochberg per class: the least bin that passes, by 8 * encoding + length.

    From counts, of which there are at most 6 * 5 * 32."""
    each = tested.select(F.explode("tested").alias("t")).groupBy("t.enc", "t.length", "t.bin").agg(F.count("*").alias("c")).collect()
    least: dict[int, int] = {}
    for key in {(r["enc"], r["length"]) for r in each}:
        counts = {r["bin"]: r["c"] for r in each if (r["enc"], r["length"]) == key}
        passing = [b for b in range(1, P_BINS + 1) if (above := sum(c for k, c in counts.items() if k >= b)) and 10.0**-b * sum(counts.values()) <= FDR * above]
        if passing:
            least[key[0] * 8 + key[1]] = min(passing)
    return least


def _found(least: dict[int, int]) -> Column:
    if not least:
        return F.array().cast("array<struct<start:long,kind:int,end:long>>")
    limit = F.create_map(*(F.lit(x) for kv in sorted(least.items()) for x in kv))
    good = F.filter("tested", lambda t: t["bin"] >= F.coalesce(F.element_at(limit, t["enc"] * 8 + t["length"]), F.lit(P_BINS + 1)))
    return F.transform(good, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and found for each row: arrays of (start, kind, end), kind an index of KINDS.

    base holds the fixed patterns' spans, found the battery's.  Null text counts as empty and has
    no spans; each row counts, repeated doc_ids too; very long texts are read whole; other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tested = materialise(_tested(rows).select("doc_id", "base", "tested"), "tested")
    return tested.select("doc_id", "base", _found(_limits(tested)).alias("found"))


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with column redacted (one of that name is replaced): the text with each span, overlaps
    merged, replaced by mark.

    Each row's own text decides, whatever its doc_id; null text stays null; other columns stay as
    they are.  Texts are scanned twice: the limits of the battery come from all of them."""
    # the columns of docs travel in one, where no name clashes
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = _tested(rows.withColumn("text", F.coalesce("row.text", F.lit(""))))
    spans = F.array_sort(F.concat("base", _found(_limits(rows))))
    # (from, to) of what lies between spans; the last goes to the end
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:long,b:long>>").alias("gaps"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

    ends = F.struct(F.char_length("text").cast("long").alias("b"))
    gaps = F.aggregate(spans, start, step, lambda acc: F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("a"), ends["b"].alias("b")))))
    pieces = F.transform(gaps, lambda g: F.substring(F.col("text"), (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")))
    text = F.when(F.col("row.text").isNotNull(), F.array_join(pieces, mark))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "redacted"]
    return rows.select(*kept, text.alias("redacted"))
