"""Flows against all integer plans, shards by their law."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelquarry.llm.flow_reshard import minimum_cost_flow, number_slots, reshard


@pytest.mark.parametrize("seed", range(4))
def test_flow_costs_least(seed):
    rng = np.random.default_rng(seed)
    supply, cost = rng.integers(0, 4, 2).tolist(), rng.integers(0, 5, (2, 3)).tolist()
    capacity = rng.integers(1, 4, 3).tolist()
    if sum(capacity) < sum(supply):
        with pytest.raises(ValueError):
            minimum_cost_flow(supply, capacity, cost)
        return
    flow = minimum_cost_flow(supply, capacity, cost)
    assert flow.sum(axis=1).tolist() == supply and all(flow.sum(axis=0) <= capacity)
    best = min(
        sum(p[i * 3 + j] * cost[i][j] for i in range(2) for j in range(3)) for p in itertools.product(range(4), repeat=6)
        if [sum(p[:3]), sum(p[3:])] == supply and all(p[j] + p[3 + j] <= capacity[j] for j in range(3)))
    assert sum(flow[i][j] * cost[i][j] for i in range(2) for j in range(3)) == best


def test_bytes_are_even_groups_whole_slots_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, plan = reshard(docs)
    rows = number_slots(rows, "_shard", ("doc_id",))
    seen = rows.select("doc_id", "text", "_size", "_shard", "slot").collect()
    assert Counter(r.doc_id for r in seen) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    size = Counter()
    for r in seen:
        assert r._size == len((r.text or "").encode()) + 8
        size[r._shard] += r._size
    assert set(size) == set(range(24))
    assert max(size.values()) / (sum(size.values()) / 24) < 1.01
    assert len({(r.text, r._shard) for r in seen}) == len({r.text for r in seen})
    for shard in range(24):
        assert sorted(r.slot for r in seen if r._shard == shard) == list(range(sum(r._shard == shard for r in seen)))
    assert 0 < plan.moved_bytes < sum(size.values())


def test_hot_text_nulls_and_repeats(spark):
    rows = [(i, "hot " * 50, "a") for i in range(3000)] + [(None, None, "b"), (1, "", "b"), (1, "", "b")] + [(i, f"text {i} " * 30, "b") for i in range(3000, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    out, plan = reshard(df, blocks=256)
    assert plan.hot
    size = out.groupBy("_shard").agg(F.sum("_size").alias("s")).collect()
    assert out.count() == len(rows) and max(r.s for r in size) < 1.1 * sum(r.s for r in size) / 24
    assert reshard(df.limit(0))[0].count() == 0


def test_same_shards_move_nothing(spark):
    df = spark.createDataFrame([(i, f"text {i % 40:02d}" * 20) for i in range(4000)], "doc_id long, text string")
    rows, plan = reshard(df, old_shards=1, new_shards=1)
    assert plan.moved_bytes == 0 and not plan.affected and rows.count() == 4000
