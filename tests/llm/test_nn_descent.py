"""Against comparing all vectors."""

from collections import Counter

import numpy as np
import pytest

from labelquarry.llm import nn_descent
from labelquarry.llm.nn_descent import link_vectors


def brute(ids, vectors, threshold=0.9):
    n = len(vectors)
    fit = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    parent, links, sizes = list(range(n)), [0] * n, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        if fit[i]:
            sizes.setdefault(len(vectors[i]), []).append(i)
    for members in sizes.values():
        x = np.array([vectors[i] for i in members], float)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        for a, i in enumerate(members):
            links[i] = int(near[a].sum())
            for b in np.flatnonzero(near[a]):
                parent[root(i)] = root(members[b])
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[root(i)] = min(low.get(root(i), 1 << 60), ids[i])
    return Counter((ids[i], links[i], low.get(root(i)), ids[i] == low.get(root(i))) for i in range(n))


def test_groups_unfit_vectors_and_copies(spark):
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(12):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 60)):
            vectors.append((centre + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35])).tolist())
    vectors += [[0.0] * 16, None, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] + [None] * 15, [], [1.0, 2.0], [2.0, 4.0], [1e300] * 16, vectors[0], vectors[0], vectors[5]]
    ids = list(range(len(vectors)))
    ids[9] = None
    df = spark.createDataFrame([(i, v, 3) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, kept int").repartition(5)
    assert Counter(tuple(r) for r in link_vectors(df).collect()) == brute(ids, vectors)


def test_empty_table(spark):
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def unit(rng, d):
    v = rng.normal(size=d)
    return v / np.linalg.norm(v)


def beside(v, cosine, rng):
    """A unit vector at this cosine to ``v``."""
    w = unit(rng, len(v))
    w -= (w @ v) * v
    return cosine * v + np.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w)


def test_linked_tight_groups_are_one_component(spark):
    rng = np.random.default_rng(3)
    vectors = []
    for cosines, sizes in (((1, 0.93), (50, 50)), ((1, 0.93, 0.8), (200, 15, 30))):
        first = unit(rng, 32)
        for cosine, size in zip(cosines, sizes, strict=True):
            centre = beside(first, cosine, rng)
            vectors += [(centre + rng.normal(size=32) * 0.012).tolist() for _ in range(size)]
    ids = list(range(len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>").repartition(4)
    wanted = brute(ids, vectors)
    assert len({component for _, _, component, _ in wanted}) == 3
    assert Counter(tuple(r) for r in link_vectors(df).collect()) == wanted


def test_isolated_pairs_beside_a_hot_group(spark):
    rng = np.random.default_rng(4)
    hot = unit(rng, 48)
    vectors = [(hot + rng.normal(size=48) * 0.01).tolist() for _ in range(600)] + [unit(rng, 48).tolist() for _ in range(1000)]
    for _ in range(600):
        one = unit(rng, 48)
        vectors += [one.tolist(), beside(one, 0.902, rng).tolist()]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(4)
    links = {r.vec_id: r.n_links for r in link_vectors(df).collect()}
    assert {links[i] for i in range(600)} == {599} and {links[i] for i in range(600, 1600)} == {0}
    assert sum(links[i] == 1 for i in range(1600, 2800)) >= 0.99 * 1200


def test_lost_links_are_an_error(spark, monkeypatch):
    rng = np.random.default_rng(5)
    hot = unit(rng, 8)
    df = spark.createDataFrame([(i, (hot + rng.normal(size=8) * 0.01).tolist()) for i in range(20)], "vec_id long, embedding array<double>")
    start = nn_descent._start
    monkeypatch.setattr(nn_descent, "_start", lambda *a: start(*a).limit(0))
    with pytest.raises(RuntimeError, match="of the links"):
        link_vectors(df)


def test_tables_follow_planes():
    for bits in (0, 1, 6, 14, 18, 21):
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** nn_descent._tables(bits, 0.9, 0.99) <= 0.0026
