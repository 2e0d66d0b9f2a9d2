"""Against counting every window."""

import hashlib
from collections import Counter

import pytest

from labelquarry.llm import superkmers


def brute(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


@pytest.fixture
def texts(rng):
    words = [f"w{i}" for i in range(40)]

    def some(low, high):
        return " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))

    base, passages = [some(0, 80) for _ in range(30)], [some(30, 60) for _ in range(5)]
    made = [f"{rng.choice(base)}\n{rng.choice(passages)} {some(30, 60)}  {rng.choice(base)}" if rng.random() < 0.7 else some(30, 60) for _ in range(80)]
    return made + [None, "", "x " * 700, "a b " * 100, "q " * 40, made[0], made[0], made[5], " ".join(words[:36]), " ".join(words[:35]), None]


@pytest.mark.parametrize("hot", [2000, 0, 40])
def test_equals_counting(spark, texts, hot):
    rows = [(i if i % 17 else None, t, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(5)
    want = brute(texts)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in superkmers.drop_repeats(df, hot=hot, texts=False).collect())
    assert got == Counter((r[0], *w[:3]) for r, w in zip(rows, want))


def test_texts_change_only_where_words_go(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = superkmers.drop_repeats(df)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "kept_sha256"]
    got = {r.doc_id: r for r in out.collect()}
    for i, w in enumerate(brute(texts)):
        assert got[i].n_removed == w[1]
        assert got[i].text == (w[3] if w[1] else texts[i])


def test_empty_table(spark):
    assert superkmers.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_that_repeats_itself_is_dealt(spark, rng):
    """One text holds a passage 4000 times; no bucket of the first level gets more than its share of windows."""
    passage = " ".join(f"p{i}" for i in range(60))
    text = " ".join(f"{passage} n{i}" for i in range(4000))
    df = spark.createDataFrame([(1, text), (2, "other " * 3 + passage)], "doc_id long, text string")
    keyed = superkmers.with_key(df, "text")
    places = superkmers.minimiser_places(keyed, "text", 35, 8)
    assert places.agg({"_n": "max"}).first()[0] > 20_000
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in superkmers.drop_repeats(df, hot=1000, texts=False).collect()}
    want = brute([text, "other " * 3 + passage])
    assert got == {1: want[0][:3], 2: want[1][:3]}


def test_buckets_of_a_hot_minimiser_are_even(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(i, f"a{i} b{i} c{i} {shared} d{i} e{i}") for i in range(3000)]
    keyed = superkmers.with_key(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    candidates = keyed.selectExpr("_k1", "_k2", "text as _text")
    minis = superkmers.minimiser_places(keyed, "text", 35, 8).selectExpr("_k1", "_k2", "struct(_mini, 20 as _parts) as x")
    candidates = candidates.join(minis.groupBy("_k1", "_k2").agg({"x": "collect_set"}).withColumnRenamed("collect_set(x)", "_minis"), ["_k1", "_k2"])
    packed = superkmers.packed_runs(candidates, 35, 8)
    largest = packed.groupBy("_mini", "_part").count().agg({"count": "max"}).first()[0]
    assert largest < 3000 / 20 * 2
    counted = superkmers.counted_in_buckets(packed, 35)
    # Sixteen windows lie in the shared passage: one representative for each in each of twenty buckets.
    assert counted.filter("_window is not null and not _alone").count() <= 16 * 20
