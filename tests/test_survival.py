import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelquarry.operators import cox
from labelquarry.operators import survival as sv

TIMES = [(1, 1), (2, 1), (2, 0), (3, 1), (3, 1), (5, 0), (6, 1)]


def test_curve_by_hand(spark):
    df = spark.createDataFrame([(float(t), e) for t, e in TIMES], "time double, event int")
    rows = sv.kaplan_meier(df).orderBy("time").collect()
    assert [r["n_at_risk"] for r in rows] == [7, 6, 4, 2, 1]
    s1, s2, s3 = 6 / 7, 6 / 7 * 5 / 6, 6 / 7 * 5 / 6 * 2 / 4
    assert [r["survival"] for r in rows] == pytest.approx([s1, s2, s3, s3, 0.0])
    gw = 1 / (7 * 6) + 1 / (6 * 5) + 2 / (4 * 2)
    assert rows[2]["se"] == pytest.approx(math.sqrt(gw) * s3)
    assert rows[2]["se_log"] == pytest.approx(math.sqrt(gw))
    assert rows[2]["se_loglog"] == pytest.approx(math.sqrt(gw) / math.log(s3)) and rows[2]["se_loglog"] < 0
    assert rows[4]["se"] is None
    assert {r["group"] for r in rows} == {"Default Group"}


def test_missing_event_counts_as_event(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "time double")
    assert [r["n_events"] for r in sv.kaplan_meier(df).collect()] == [1, 1]


def test_confidence_limits(spark):
    df = spark.createDataFrame([(float(t), e) for t, e in TIMES], "time double, event int")
    curve = sv.kaplan_meier(df)
    for kind in ("ordinary", "log", "loglog"):
        for r in sv.km_confidence(curve, kind=kind).where("lower IS NOT NULL").collect():
            assert 0 <= r["lower"] <= 1 and 0 <= r["upper"] <= 1
    row = sv.km_confidence(curve, kind="log").where("time = 2").first()
    assert row["upper"] == pytest.approx(min(1, math.exp(math.log(row["survival"]) + 1.96 * row["se_log"])))


def test_step_points(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 0)], "time double, event int")
    got = [(r["x"], r["y"]) for r in sv.km_step_points(sv.kaplan_meier(df)).orderBy("x", "part").collect()]
    assert [x for x, _ in got] == [1, 2, 2, 3, 3]
    assert [y for _, y in got] == pytest.approx([2 / 3, 2 / 3, 1 / 3, 1 / 3, 1 / 3])


def test_logrank_by_hand(spark):
    rows = [(1.0, 1, 1), (2.0, 1, 0), (3.0, 1, 1), (4.0, 1, 0), (4.0, 0, 1)]
    row = sv.logrank_test(spark.createDataFrame(rows, "time double, event int, in_first int")).first()
    expected = 3 / 5 + 2 / 4 + 2 / 3 + 1 / 2
    variance = 3 / 5 * 2 / 5 + 2 / 4 * 2 / 4 + 2 / 3 * 1 / 3 + 1 / 2 * 1 / 2
    assert row["observed"] == 2 and row["expected"] == pytest.approx(expected) and row["variance"] == pytest.approx(variance)
    chi2 = (2 - expected) ** 2 / variance
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(chi2 / 2)), abs=1e-6)


def test_median_split(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "age double")
    got = {r["age"]: r["group"] for r in sv.median_split(df, "age").collect()}
    assert got == {1.0: "below median of age", 2.0: "below median of age", 3.0: "above median of age", 10.0: "above median of age"}
    two = spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "flag double")
    assert sorted(r["group"] for r in sv.median_split(two, "flag").collect()) == ["flag", "flag", "not flag"]


def test_standardising_leaves_binary_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (4.0, 1.0)], "a double, b double")
    got = np.array([[r["a"], r["b"]] for r in sv.standardize_covariates(df, ["a", "b"]).collect()])
    assert got[:, 0].mean() == pytest.approx(0) and got[:, 0].std(ddof=1) == pytest.approx(1)
    assert sorted(got[:, 1]) == [0, 1, 1]


def efron_fit(time, event, x):
    """Newton's method straight from the definition."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        theta = np.exp(x @ beta)
        gradient, info = np.zeros_like(beta), np.zeros((len(beta), len(beta)))
        for t in np.unique(time[event == 1]):
            risk, dead = time >= t, (time == t) & (event == 1)
            d = dead.sum()
            gradient += x[dead].sum(axis=0)
            for i in range(d):
                w = theta * (risk - i / d * dead)
                mean = w @ x / w.sum()
                gradient -= mean
                info += (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
        step = np.linalg.solve(info, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    return beta, np.linalg.inv(info)


@pytest.fixture(scope="module")
def study():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=120), rng.integers(0, 2, 120)])
    time = np.ceil(rng.exponential(8 / np.exp(0.6 * x[:, 0] - 0.4 * x[:, 1])))
    return time, (rng.random(120) < 0.7).astype(int), x


def test_cox_with_ties(spark, study):
    time, event, x = study
    df = spark.createDataFrame([(float(t), int(e), float(a), float(b)) for t, e, (a, b) in zip(time, event, x)],
                               "time double, event int, a double, b double")
    fit = cox.fit_cox(df, ["a", "b"])
    beta, covariance = efron_fit(time, event, x)
    assert np.allclose(fit.beta, beta, atol=1e-5) and np.allclose(fit.covariance, covariance, atol=1e-5)
    single = cox.fit_cox_univariate(df, ["a", "b"])
    for i, one in enumerate(single):
        assert one.beta[0] == pytest.approx(efron_fit(time, event, x[:, [i]])[0][0], abs=1e-5)
    table = cox.cox_table(spark, [fit], rounded=False).collect()
    assert table[0]["hazard_ratio"] == pytest.approx(math.exp(beta[0]), rel=1e-4)
    assert table[0]["lower"] < table[0]["hazard_ratio"] < table[0]["upper"]
    joined = cox.join_cox_tables(cox.cox_table(spark, single), cox.cox_table(spark, [fit]))
    assert joined.count() == 2 and "multi_hazard_ratio" in joined.columns


def test_cox_event_flip(spark, study):
    time, event, x = study
    df = spark.createDataFrame([(float(t), int(1 - e), float(a)) for t, e, (a, _) in zip(time, event, x)],
                               "time double, event int, a double")
    assert cox.fit_cox(df, ["a"], flip_event=True).beta[0] == pytest.approx(efron_fit(time, event, x[:, [0]])[0][0], abs=1e-5)


def test_risk_split(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "a double")
    split = sv.risk_index_split(df, {"a": math.e})
    assert split.agg(F.sum("high_risk")).first()[0] == 3


def test_ties_are_folded_without_a_shuffle(spark):
    """A time with more ties than one row folds, against the sums written out."""
    rng = np.random.default_rng(3)
    time, event, x = rng.integers(0, 4, 12_000).astype(float), rng.integers(0, 2, 12_000), rng.normal(size=12_000)
    time[:9000], event[:9000] = 2.0, 1
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(time, event, x)], "time double, event int, x double")
    row = cox.cox_derivatives(df, ["x"], [0.3]).first()
    theta, want = np.exp(0.3 * x), np.zeros(3)
    for at in np.unique(time):
        risk, dead = time >= at, (time == at) & (event == 1)
        d = dead.sum()
        f = np.arange(d) / d
        w = [(theta * x**p)[risk].sum() - f * (theta * x**p)[dead].sum() for p in range(3)]
        want += [0.3 * x[dead].sum() - np.log(w[0]).sum(), x[dead].sum() - (w[1] / w[0]).sum(), (w[2] / w[0] - (w[1] / w[0]) ** 2).sum()]
    assert [row["ll"], row["g0"], row["h0_0"]] == pytest.approx(want.tolist(), rel=1e-9)
    data = cox._placed_times(df.select("time", "event", F.col("x").alias("x0")), [])
    plan = cox._derivatives(data, [], 1, F.col("x0") * 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2  # by bucket, for totals and rows: one shared exchange


def test_ties_are_summed_in_slabs(spark, monkeypatch):
    """Rows across slabs and chunks, against the sums written out; no step of the JVM for each tied event."""
    monkeypatch.setattr(cox, "TIE_SLAB", 5000)
    rng = np.random.default_rng(5)
    d = np.concatenate([rng.integers(1, 4, 3000), [9000, 1, 12_000]])
    whole, tied = rng.random(len(d)) * 50 + 10, rng.random(len(d)) * 10
    start = np.zeros(len(d), int)
    start[-1] = 2 * cox.TIE_CHUNK
    for got, s, t, n, low in zip(cox.efron_sums(whole, tied, d, start), whole, tied, d, start):
        f = np.arange(low, min(low + cox.TIE_CHUNK, n)) / n
        w = s - f * t
        assert got.tolist() == pytest.approx([np.log(w).sum(), (1 / w).sum(), (f / w).sum(), (1 / w**2).sum(), (f / w**2).sum(), (f * f / w**2).sum()], rel=1e-12)
    with pytest.raises(FloatingPointError):
        cox.efron_sums(np.zeros(1), np.zeros(1), np.ones(1, int), np.zeros(1, int))
    df = spark.createDataFrame([(1.0, 1, 0.5), (1.0, 1, 0.1), (2.0, 1, 0.3)], "time double, event int, x double")
    plan = cox.cox_derivatives(df, ["x"], [0.3])._jdf.queryExecution().optimizedPlan().toString()
    assert "_tie_sums" in plan and "aggregate(sequence" not in plan


def test_equal_rows_count_as_often_as_they_occur(spark, study):
    time, event, x = study
    kept = [(float(t), int(e), float(b)) for t, e, (_, b) in zip(time, event, x) for _ in range(1 + int(t) % 3)]
    df = spark.createDataFrame(kept, "time double, event int, x0 double")
    counted = cox._counted(df)
    assert counted.count() < len(kept) and counted.agg(F.sum("n")).first()[0] == len(kept)
    once, all_ = (cox._derivatives(d, [], 1, F.col("x0") * 0.4).first() for d in (counted, df))
    assert list(once) == pytest.approx(list(all_), rel=1e-12)
    t, e, v = (np.array(c) for c in zip(*kept))
    beta = efron_fit(t, e.astype(int), v[:, None])[0][0]
    assert cox.fit_cox(df, ["x0"]).beta[0] == pytest.approx(beta, abs=1e-5)
    assert cox.fit_cox_univariate(df, ["x0"])[0].beta[0] == pytest.approx(beta, abs=1e-5)
