import random

import pytest
from pyspark.sql import functions as F

from labelquarry.operators import ranks


@pytest.fixture(scope="module")
def rows():
    """One key holds most of the rows, many of them with the same value."""
    rng = random.Random(3)
    data = [("hot", rng.choice([0.0, 0.0, round(rng.uniform(-5, 5), 2), rng.uniform(-1e6, 1e6)])) for _ in range(3000)]
    return data + [(k, rng.uniform(-1, 1)) for k in "abc" for _ in range(rng.randint(1, 40))] + [("one", 7.0)]


def groups(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in out.items()}


def test_upper_median(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in ranks.upper_median(df, ["k"], "v").collect()}
    assert got == {k: v[len(v) // 2] for k, v in groups(rows).items()}


def test_median_of_all(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    values = sorted(v for _, v in rows)
    n = len(values)
    want = (values[(n - 1) // 2] + values[n // 2]) / 2
    assert ranks.median(df, [], "v").first()["median"] == pytest.approx(want)


def test_running_totals(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["k"], r["v"]): r["upto"] for r in ranks.running_totals(df, ["k"], "v", {"upto": "n"}).collect()}
    for k, values in groups(rows).items():
        for v in set(values):
            assert got[k, v] == sum(1 for w in values if w <= v)


def test_previous_values(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double").distinct().withColumn("w", F.col("v") * 2)
    got = {(r["k"], r["v"]): r["previous"] for r in ranks.previous_values(df, ["k"], "v", "w").collect()}
    for k, values in groups(rows).items():
        ordered = sorted(set(values))
        assert got[k, ordered[0]] is None
        for before, v in zip(ordered, ordered[1:]):
            assert got[k, v] == before * 2


def test_ties_report_their_place(spark):
    counts = spark.createDataFrame([(1.0, 2), (2.0, 5), (3.0, 1)], "v double, n long")
    hits = ranks.values_at_ranks(counts, [], "v", lambda n: ranks.ranks(a=F.lit(0), b=F.lit(4), c=n - 1, gone=n))
    got = {r["label"]: (r["v"], r["tie_rank"]) for r in hits.collect()}
    assert got == {"a": (1.0, 0), "b": (2.0, 2), "c": (3.0, 0)}


def test_nan_sorts_last_and_null_keys_are_refused(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, nan, float("inf"), 3.0)], "k string, v double")
    assert ranks.median(df, ["k"], "v").first()["median"] == 3.0
    with pytest.raises(Exception, match="null in k"):
        ranks.median(spark.createDataFrame([(None, 1.0)], "k string, v double"), ["k"], "v").collect()


NARROW = {
    "narrow": lambda rng, i: rng.uniform(0, 0.02),
    "epoch": lambda rng, i: 1_700_000_000 + rng.randint(0, 40_000),
    "saturated": lambda rng, i: rng.choice([-1, 1]) * (1 - rng.random() ** 6 * 1e-9),
    "skewed": lambda rng, i: rng.random() ** 40 * 1e12,
}


@pytest.mark.parametrize("kind", [*NARROW, "texts"])
def test_buckets_are_even_whatever_the_values(spark, kind):
    """A bucket holds under three times the rows of an average one, also where all values share their first letters."""
    rng = random.Random(11)
    if kind == "texts":
        values = {f"TCGA-02-0001-slide-{'x' * (i % 2)}{rng.randint(0, 10**9):010d}" for i in range(20_000)}
    else:
        values = {NARROW[kind](rng, i) for i in range(20_000)}
    rows = [("hot", v) for v in values] + [("cold", v) for v in sorted(values)[:50]]
    df = spark.createDataFrame(rows, ["k", "v"])
    placed = ranks.place(df, ["k"], "v", rows_per_bucket=200)
    sizes = {r["_bucket"]: (r["n"], r["lo"], r["hi"]) for r in placed.where("k = 'hot'").groupBy("_bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    assert len(sizes) > 50
    assert max(n for n, _, _ in sizes.values()) < 3 * len(values) / len(sizes)
    in_order = [sizes[b] for b in sorted(sizes)]
    assert all(a[2] < b[1] for a, b in zip(in_order, in_order[1:]))


def test_two_levels_of_cuts(spark):
    df = spark.range(60_000).selectExpr("id * 3 as v", "1 as n")
    placed = ranks.place(df, [], "v", rows_per_bucket=32)
    buckets = placed.groupBy("_bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_bucket").collect()
    assert len(buckets) > 1000 and max(b["n"] for b in buckets) < 200
    assert all(a["hi"] < b["lo"] for a, b in zip(buckets, buckets[1:]))


def test_falling_totals(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = ranks.place(df, ["k"], "v", rows_per_bucket=50)
    down = ranks.running_totals(placed, ["k"], "v", {"from_here": "n"}, falling=True)
    got = {(r["k"], r["v"]): (r["from_here"], r["upto"]) for r in ranks.running_totals(down, ["k"], "v", {"upto": "n"}).collect()}
    for k, values in groups(rows).items():
        for v in set(values):
            assert got[k, v] == (sum(1 for w in values if w >= v), sum(1 for w in values if w <= v))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, v double, n long")
    assert ranks.running_totals(df, ["k"], "v", {"t": "n"}).count() == 0
    assert ranks.running_totals(df.drop("k"), [], "v", {"t": "n"}).count() == 0
    assert ranks.median(df, ["k"], "v").count() == 0
