"""Against the plain patterns, and against counting documents."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from labelquarry.llm import disclosure

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind, m[0]))
    return sorted(out)


def words(text):
    return [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{N}]+", text)]


def brute_terms(texts, threshold=0.95, reach=200):
    """Flagged words and what becomes of them."""
    near, held = defaultdict(set), defaultdict(set)
    met = defaultdict(set)
    for i, text in enumerate(texts):
        for _, _, w in words(text):
            met[w].add(i)
            met[w[:2] + "*"].add(i)
        for start, _, end, kind, value in brute_spans(text):
            key = kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()
            held[key].add(i)
            for a, b, w in words(text):
                left = b <= start and a >= max(start - reach, 0) or a < start < b and a >= max(start - reach, 0)
                right = a >= end and b <= min(end + reach, len(text)) or a < end < b and b <= min(end + reach, len(text))
                for piece in ([text[a : min(b, start)]] if left else []) + ([text[max(a, end) : b]] if right else []):
                    piece = piece.lower()
                    near[key, piece].add(i)
                    near[key, piece[:2] + "*"].add(i)
    strength = {}
    for (key, term), docs in near.items():
        if len({texts[i] for i in docs}) < 2 or len({texts[i] for i in held[key]}) < 2 or len(held[key]) == len(texts) or term not in met:
            continue
        share = math.log(len(docs) / len(met[term])) / math.log(len(texts) / len(held[key]))
        strength[term] = max(strength.get(term, -9), 1 + share)
    return {t: ("" if strength.get(t[:2] + "*", 0) >= threshold else t[:2] + "*") for t, s in strength.items() if s >= threshold and not t.endswith("*")}


def brute(texts):
    flagged = brute_terms(texts)
    out = []
    for text in texts:
        base = brute_spans(text)
        terms = [(a, 4, b, "term", w) for a, b, w in words(text) if w in flagged and not any(s[0] < b and a < s[2] for s in base)]
        line = lambda spans: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
        counts = [sum(s[3] == k for s in base) for k in PLAIN]
        out.append((*counts, hashlib.sha256(line(base).encode()).hexdigest(), line(sorted(base + terms))))
    return out


@pytest.fixture
def texts(rng):
    common = ["the", "and", "Über", "of", "naïve", "stone", "x1"]
    people = [("ann.lee@mail.example.com", "Zyxwort"), ("10.0.0.255", "Quokka"), ("4111 1111 1111 1111", "mühlrad"), ("+1 (555) 010-9999", "sasquatch"), ("bob%x@y.z", "Zyra")]
    out = []
    for i in range(120):
        w = [rng.choice(common) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            entity, term = rng.choice(people)
            at = rng.randint(0, len(w))
            w[at:at] = [term, f"{entity.upper() if 'ann' in entity and i % 2 else entity}" + rng.choice(["", ",", " "]), rng.choice(common)]
        if i == 7:
            w += ["Quokka", "sasquatch"]
        out.append(rng.choice([" ", "  ", "\n"]).join(w))
    return out + [out[0], out[3], out[3], "", "Zyxwort"]


ODD = [
    "a@b.c%d@e.f", "a@b c@d.e", "a@b@c.d", "a@b.c.@x.y", "a@b.", "@b.c", "x.y@z", "1.2.3.4.5.6.7.8", "1.2.3..4.5.6.7", "256.1.1.1 0001.02.0255.000",
    "a.1.2.3.4", "4111-1111-1111-1111", "4111 1111  1111 1111", "+1 (269) 555-3296 4524132264652876", "+1(269)555-3296.", "++12345678901", "+1 2", "+123456789()",
    "4111111111111111 1", "é😀ann@x.yz é 10.0.0.1 4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "9" * 6000, "1." * 6000, "a." * 4000 + "@" + "b." * 9000 + "c",
    "a" * 6000, "a" * 6000 + "@", "1" * 6000, "1-" * 30_000, "+1" + "(" * 30_000, "+1" + "(2" * 30_000, "10.0.0.1 " * 3000, "x@y.z 4111111111111111 " * 1500, None, "",
    "00000000000000", "10.0.0.1@x.y",
]


def test_spans_equal_the_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, text string")
    got = {r.i: [(s.start, s.rank, s.end, s.kind, s.value) for s in r.spans] for r in df.select("i", disclosure.base_spans(disclosure.F.coalesce("text", disclosure.F.lit(""))).alias("spans")).collect()}
    for i, text in enumerate(ODD):
        assert got[i] == brute_spans(text or ""), (text or "")[:60]


def test_long_runs_take_linear_time(spark):
    n = 100_000
    runs = ["a" * n, "a" * n + "@" + "b." * n + "c", "9" * n, "1." * n, "1-" * n, "+1" + "(2" * n, "a@" * n]
    df = spark.createDataFrame(list(enumerate(runs)), "i int, text string")
    got = {r.i: r.n for r in df.selectExpr("i", "text").select("i", disclosure.F.size(disclosure.base_spans(disclosure.F.col("text"))).alias("n")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: n // 4, 4: 0, 5: 0, 6: 0}


def test_equals_counting(spark, texts):
    rows = [(i if i % 9 else None, t or None, "mine") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    found = disclosure.summary(disclosure.find_personal_data(df))
    got = sorted([tuple(r) for r in found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()], key=repr)
    want = brute(texts)
    assert sum("term" in w[-1] for w in want) > 10
    assert got == sorted([(r[0], *w) for r, w in zip(rows, want)], key=repr)


def test_terms_are_generalised_or_removed(spark):
    lines = [f"call Zyxwort at ann@x.org now {i}" for i in range(3)] + [f"call Quokka at 10.1.2.3 now {i}" for i in range(3)]
    other = [f"call the quiet desk now {i}" for i in range(1200)]
    df = spark.createDataFrame([(t, 1) for t in [*lines, *other, "where is Zyxwort", None]], "text string, spans int")
    got = {r.text for r in disclosure.sanitise(df).collect()}
    assert "call  at [EMAIL] now 1" in got  # no other word begins with zy
    assert "call qu* at [IP] now 2" in got
    assert "where is " in got and None in got and "call the quiet desk now 7" in got


def test_empty_table(spark):
    found = disclosure.summary(disclosure.find_personal_data(spark.createDataFrame([], "doc_id long, text string")))
    assert found.count() == 0


def test_no_python_on_the_executors(spark):
    plan = disclosure.find_personal_data(spark.createDataFrame([("a@b.c",)], "text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_word_filter_is_short_in_plans(spark):
    """The driver keeps texts of plans, and each spells the filter out."""
    terms = spark.range(3000).select(F.concat(F.lit("t"), F.col("id")).alias("term"))
    words = disclosure.WordFilter(terms)
    asked = spark.range(6000).select(F.concat(F.lit("t"), F.col("id")).alias("w"), "id").withColumn("may", words.may_hold(F.col("w")))
    assert asked.where("id < 3000 AND NOT may").count() == 0
    assert asked.where("id >= 3000 AND may").count() < 30
    assert len(asked._jdf.queryExecution().analyzed().toString()) < words.size * 2  # at one byte each, 6 times the size
