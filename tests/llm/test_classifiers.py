"""Accuracy on rows that were not learned from, and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelquarry.llm import conv_toxicity, kernel_quality

FOLDER = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    positive = label == 1
    return (order[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


def held_out_rows(spark, scored, label):
    rows = scored.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").select("doc_id", "held_out", "score", "predicted", label).toPandas()
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == h for d, h in zip(rows["doc_id"], rows["held_out"]))
    return rows[rows["held_out"]]


EDGES = [(1, None, "en"), (2, "", None), (2, "", None), (None, "word", "en"), (5, "Und " * 40000, "de"), (6, "fine words here", "xx")]


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = kernel_quality.score_quality(docs, labels)
    assert scored.count() == docs.count()
    rows = held_out_rows(spark, scored, "quality")
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.95
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95
    edges = spark.createDataFrame([(*e, 1.0) for e in EDGES], "doc_id long, text string, lang string, score double")
    out = kernel_quality.score_quality(edges.unionByName(docs.select("doc_id", "text", "lang").selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "0.5d as score")), labels.selectExpr("doc_id + 1000000 as doc_id", "quality")).filter("doc_id is null or doc_id < 1000").collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    nothing = kernel_quality.score_quality(edges, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}


def test_isotonic_blocks():
    x, y = kernel_quality.isotonic(np.arange(5.0), np.array([0, 1, 0.5, 0.2, 1]), np.ones(5))
    assert np.allclose(y, [0, (1 + 0.5 + 0.2) / 3, 1]) and np.allclose(x, [0, 2, 4])


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = conv_toxicity.train(docs, labels)
    scored = conv_toxicity.score_toxicity(docs, model)
    assert scored.count() == docs.count()
    rows = held_out_rows(spark, scored, "toxic")
    assert auc(rows["score"].to_numpy(), rows["toxic"].to_numpy()) > 0.8
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.9
    edges = spark.createDataFrame([(*e, "x") for e in EDGES], "doc_id long, text string, lang string, rejected string")
    out = conv_toxicity.score_toxicity(edges, model).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    empty = conv_toxicity.train(docs.limit(0), labels)
    assert {r.score for r in conv_toxicity.score_toxicity(edges, empty).collect()} == {0.0}
    assert conv_toxicity.score_toxicity(docs.limit(0), model).count() == 0


def labelled_texts(languages, seed):
    """Noisy texts: (doc_id, text, lang), (doc_id, toxic)."""
    rng = np.random.default_rng(seed)
    docs, labels, number = [], [], 0
    for lang, (toxic, clean) in languages.items():
        for label in [1] * toxic + [0] * clean:
            words = [f"w{i}" for i in rng.integers(0, 30, 12)] + ["grumsel"] * int(rng.random() < (0.8 if label else 0.15))
            # The first two words are met in no other text: a text's last filter windows reach into the next text of its batch.
            docs.append((number, " ".join([f"{number}"] * 2 + list(rng.permutation(words))), lang))
            labels.append((number, label))
            number += 1
    return docs, labels


@pytest.mark.parametrize("sample", [8000, 150])
def test_every_language_with_both_labels_has_its_best_threshold(spark, sample):
    languages = {"en": (150, 250), "xx": (20, 30), "one": (0, 30), None: (5, 5)}
    docs, labels = labelled_texts(languages, 3)
    docs += docs[:7]  # rows come twice
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*labels, (None, 1), (10**6, 1)], "doc_id long, toxic int")
    known = conv_toxicity.training_labels(labels, "toxic")
    chosen = {r.doc_id for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    learned = {i for i in chosen if conv_toxicity.xxhash.xxh3_64_intdigest(str(i), seed=5) % 5}
    model = conv_toxicity.train(docs, labels, sample=sample)
    scored = conv_toxicity.score_toxicity(docs, model).dropDuplicates(["doc_id"]).join(known, "doc_id").toPandas()
    fresh = scored[~scored["doc_id"].isin(learned)]
    assert set(model.thresholds) == {"en", "xx"}
    for lang in ("en", "xx"):
        mine = fresh[fresh["lang"] == lang]
        assert set(mine["label"]) == {0, 1} and min(mine["label"].value_counts()) < 20 or lang == "en"
        want = conv_toxicity.best_threshold(mine["score"].to_numpy(), mine["label"].to_numpy())
        assert model.thresholds[lang] == pytest.approx(np.clip(want, 0.5, 0.9), abs=1e-12)
        assert set(scored[scored["lang"] == lang]["threshold"]) == {model.thresholds[lang]}
    assert set(scored[scored["lang"] == "one"]["threshold"]) == {0.7}


def test_best_thresholds_of_many_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(lang, float(s), 1, int(rng.random() < s)) for lang in "ab" for s in rng.integers(0, 400, 3000) / 400] + [("c", 0.4, 3, 0), ("d", 0.1, 2, 2), ("e", 0.3, 2, 1)]
    rows += [("f", s, 1, h) for s, h in ((0.9, 1), (0.8, 0), (0.7, 0), (0.6, 1))]
    counts = spark.createDataFrame(rows, "lang string, score double, n long, hits long").groupBy("lang", "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    got = {r.lang: r.threshold for r in conv_toxicity.best_thresholds(counts).collect()}
    assert set(got) == {"a", "b", "e", "f"} and got["e"] == 0.3
    for lang in "abf":
        s, y = np.array([r[1] for r in rows if r[0] == lang]), np.array([r[3] for r in rows if r[0] == lang])
        assert got[lang] == pytest.approx(conv_toxicity.best_threshold(s, y), abs=1e-12)


@pytest.mark.parametrize("seed", [1, 2])
def test_network_gradient_lowers_the_loss(seed):
    rng = np.random.default_rng(seed)
    slots = np.arange(20)[:, None].repeat(conv_toxicity.PARTS, 1)
    texts = [rng.integers(1, 20, rng.integers(1, 30)).astype(np.int32) for _ in range(200)]
    y = np.array([float(7 in t) for t in texts], np.float32)
    network = conv_toxicity.Network(np.arange(20, dtype=np.int32), np.zeros(20), seed)
    network.train(texts, y, slots, 0, epochs=40)
    logits = network.logits(texts, network.taps(slots), 0)
    assert ((logits > 0) == (y > 0)).mean() > 0.95
