import hashlib
import random

import pytest
from pyspark.sql import functions as F

from labelquarry.operators import sampling as s


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def pool_rows():
    rng = random.Random(5)
    # Two thirds of the scores are one tied value.
    return [(i, f"S{i % 3}", 0.25 if i % 3 else round(rng.uniform(-1, 1), 3)) for i in range(900)]


@pytest.fixture(scope="module")
def pool(spark, pool_rows):
    return spark.createDataFrame(pool_rows, "object_id long, slide string, score double")


def test_pool_and_labelled_are_disjoint(pool):
    labeled = pool.where("object_id % 4 = 0")
    rest = s.unlabeled_pool(pool, labeled)
    assert rest.join(labeled, "object_id", "left_semi").count() == 0
    assert rest.count() + labeled.count() == pool.count()


def test_ties_are_spread_by_seed(pool, pool_rows):
    tied = pool.where("score = 0.25")
    got = [r["object_id"] for r in s.uncertain_spread(tied, 8, seed=3).collect()]
    ids = sorted((i for i, _, v in pool_rows if v == 0.25), key=lambda i: md5(f"3:{i}"))
    assert got == ids[:8]
    assert got != [r["object_id"] for r in s.uncertain_spread(tied, 8, seed=4).collect()]


def test_random_sample_exhausts(pool):
    assert s.random_sample(pool.limit(5), 8).count() == 5


@pytest.mark.parametrize("strata,groups", [(2, 1), (4, 2), (5, 3), (1, 2)])
def test_display_strata(pool, pool_rows, strata, groups):
    got = {r["position"]: r["object_id"] for r in s.display_strata(pool, strata, groups).collect()}
    want = {}
    for positive in (0, 1):
        ordered = sorted(
            (r for r in pool_rows if (r[2] >= 0) == bool(positive)), key=lambda r: (r[2], md5(str(r[0])))
        )
        n = len(ordered)
        for g in range(groups):
            for i in range(strata):
                if strata == 1:
                    rank = (0 if positive else n - groups) + g
                else:
                    rank = (0 if i == 0 else n - groups - 1 if i == strata - 1 else i * n // (strata - 1)) + g
                want[g * 2 * strata + positive * strata + i] = ordered[rank][0]
    assert got == want


def test_empty_bins_borrow_from_the_next(spark):
    rows = [(i, "S", v) for i, v in enumerate([-0.9, -0.1, -0.05, -0.2, 0.05, 0.07, 0.02, 0.9])]
    df = spark.createDataFrame(rows, "object_id long, slide string, score double")
    got = {r["asked_bin"]: (r["source"], r["object_id"]) for r in s.bin_samples(df, seed=1).collect()}
    # Bin 1 borrows from bin 2; bins 4 to 6 borrow from bin 7, which has one object only.
    order2 = sorted([1, 2, 3], key=lambda i: md5(f"1:{i}"))
    assert got[1] == (2, order2[0]) and got[2] == (2, order2[1])
    assert got[0] == (0, 0) and got[4] == (7, 7)
    assert len({v[1] for v in got.values()}) == len(got)


def test_rank_filter_runs_before_the_shuffle(pool):
    plan = s.bin_samples(pool)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_weighted_prefers_untouched_slides(spark):
    pool = spark.createDataFrame([(1, "A", 0.1), (2, "B", 0.2)], "object_id long, slide string, score double")
    labeled = spark.createDataFrame([("A",), ("A",), ("A",)], "slide string")
    assert s.uncertain_weighted(pool, labeled, 1).first()["object_id"] == 2


def test_score_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-0.5, -0.49, 0.0, 0.1, 0.3, 0.31, 1.0, 1.7)], "score double")
    assert [r["bin"] for r in s.with_score_bin(df).orderBy("score").collect()] == [0, 1, 2, 3, 5, 6, 7, 7]
    assert df.where(F.col("score") > 1).count() == 1
