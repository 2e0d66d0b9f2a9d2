"""Against comparing all pairs of sets."""

import re
from collections import Counter

import pytest

from labelquarry.llm import bottom_k


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), 10**9), r[0])
    return [(r[0], len(s), low.get(root(i)), r[0] == low.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.fixture
def rows(rng):
    words = [f"v{i}" for i in range(60)]

    def some(n):
        return [rng.choice(words) for _ in range(n)]

    base, passage, hub = [some(rng.choice([3, 5, 6, 8, 20, 60, 150, 400])) for _ in range(25)], some(60), some(200)
    texts = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.2:
            w += passage
        texts.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
    for _ in range(60):
        w = list(hub)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(200)] = f"z{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    texts += [None, "", " \n ", "one two", "ONE two", "one", " ".join(some(20000))] + texts[:5]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    made = [(ids[i] if i != 3 else None, t, True) for i, t in enumerate(texts)]
    return made + [(7, "two texts of id seven are here", False), (7, "another one for id seven it is", False)]


@pytest.mark.parametrize(("small", "block"), [(16, 256), (2, 7)])
def test_equals_comparing_all(spark, rows, small, block, monkeypatch):
    monkeypatch.setattr(bottom_k, "BLOCK", block)
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean").repartition(4)
    want = brute(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in bottom_k.near_duplicates(df, small=small).collect()) == Counter(want)
    if small == 16:
        out = bottom_k.drop_near_duplicates(df)
        assert out.columns == df.columns
        assert Counter(r.doc_id for r in out.collect()) == Counter(w[0] for w in want if w[3])


def test_empty_table(spark):
    assert bottom_k.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
