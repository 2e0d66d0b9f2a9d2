"""Against applying the filters one after the other, in every order."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from labelquarry.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, part in docs:
        smaller = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        rows.append((i, part or "", failures(text or "") | {"E": smaller}))
    out = {}
    for part in {r[1] for r in rows}:
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[1] == part]
            for step, f in enumerate(order, 1):
                stay, go = [r for r in left if not r[2][f]], [r for r in left if r[2][f]]
                fail = [r for r in rows if r[1] == part and r[2][f]]
                out[part, "".join(order), step] = [
                    len(stay), len(go), len(fail) - len(go), sum(sum(r[2].values()) == 1 for r in fail),
                    sum(r[0] in good for r in go), sum(r[0] in toxic for r in go),
                ]
                shapley[f] += len(go)
                left = stay
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


@pytest.fixture
def docs(rng):
    def some():
        words = [f"w{rng.randint(0, rng.choice([20, 5000]))}" for _ in range(rng.choice([3, 150, 260, 400]))]
        words = [w.upper() if rng.random() < rng.choice([0, 0.2]) else w for w in words]
        return " ".join(words + (["50%"] if rng.random() < 0.3 else []))

    texts = [some() for _ in range(50)] + [None, "", "", " \n", "é\xa0ü " * 300, "ÀÉ" * 500, "A" * 100_000]
    out = [(rng.randint(0, 60), t, rng.choice(["en", "de", "", None])) for t in texts + rng.choices(texts, k=30)]
    return out + [(None, out[0][1], "en"), (None, out[0][1], "en"), out[1], out[1]]


def test_equals_filtering_in_each_order(spark, rng, docs):
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(70)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, mask string").repartition(3)
    out = filter_audit.audit_orders(filter_audit.mask_cells(df, spark.createDataFrame(labels, LABELS)))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in out.collect()}
    assert got == brute(docs, labels)


def test_a_hot_text_and_an_empty_table(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'same' as text", "'en' as lang")
    labels = spark.createDataFrame([], LABELS)
    cells = filter_audit.mask_cells(docs, labels).collect()
    assert {(c.mask, c.n) for c in cells} == {(1, 1), (17, 4999)}
    assert filter_audit.audit_orders(filter_audit.mask_cells(docs.limit(0), labels)).count() == 0
