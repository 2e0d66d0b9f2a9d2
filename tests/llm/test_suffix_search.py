"""Against looking every window up in every text."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from labelquarry.llm import suffix_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add("" if name is None else str(name))
    out = []
    for row in rows:
        w = words(row[1])
        hit, found = [0] * len(w), set()
        for size in range(1, 11):
            for i in range(len(w) - size + 1):
                if names := windows.get(tuple(w[i : i + size])):
                    found |= names
                    hit[i : i + size] = [1] * size
        out.append((row[0], len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0))
    return out


@pytest.fixture
def tables(rng):
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25, 30])))) for i in range(50)]
    items += [(7, "W1 w2, extra"), (None, "w3 w4 w5 w6 w7"), (100, None), (101, "w1 " * 12), (102, "é È zz 9"), (103, items[5][1])]

    def document():
        pieces = []
        for _ in range(rng.randint(0, 4)):
            w = (rng.choice(items)[1] or "").split()
            if w and rng.random() < 0.5:
                a = rng.randint(0, len(w) - 1)
                pieces += w[a : rng.randint(a, len(w))]
            pieces += [f"X{rng.randint(0, 9)}"] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 15))]
        return rng.choice([" ", ", "]).join(pieces).upper()

    rows = [(i, document(), "c") for i in range(150)]
    return rows + [(None, None, "c"), (5, "", "c"), (5, "É é È ZZ 9", "c"), (6, "w1-" * 40, "c"), (8, "w1 w2 " * 4000, "c")], items


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_equals_looking_up(spark, tables, block_bytes, monkeypatch):
    monkeypatch.setattr(suffix_search, "SHARD_WORDS", 500)
    rows, items = tables
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit string").repartition(3)
    known = spark.createDataFrame(items, "item_id long, text string")
    found = suffix_search.find_items(docs, known, block_bytes=block_bytes).collect()
    want = brute(rows, items)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == Counter(want)
    if block_bytes > 300:
        kept = suffix_search.drop_contaminated(docs, known)
        assert kept.columns == docs.columns
        assert kept.count() == sum(not w[5] for w in want)


def test_longest_match_and_location(spark):
    item = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"t{i}" for i in range(4, 25)) + " c")], "doc_id long, text string")
    (row,) = suffix_search.find_items(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [tuple(m) for m in row.matches] == [("9", 4, 2, 21)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in suffix_search.find_items(docs, none).collect()] == [False]
    assert suffix_search.find_items(docs.limit(0), none).count() == 0
