"""Kaplan–Meier curves, log-rank tests and group assignment.

Subjects are counted per (group, time) before anything is ordered, and running totals go
through :func:`running_totals`, so a group of any size is spread over its time buckets.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.operators.ranks import BUCKET, median, place, previous_values, running_totals, single_row


def survival_clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a number in every named column."""
    clean = df
    for c in columns:
        clean = clean.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return clean


def with_defaults(df: DataFrame) -> DataFrame:
    """A missing event flag counts as an event; a missing group is the default group."""
    group = F.col("group") if "group" in df.columns else F.lit(None).cast("string")
    event = F.col("event") if "event" in df.columns else F.lit(None).cast("int")
    return df.withColumns(
        {"event": F.coalesce(event, F.lit(1)), "group": F.coalesce(group, F.lit("Default Group"))}
    )


def _per_time(df: DataFrame, keys: list[str]) -> DataFrame:
    event = F.col("event").cast("long")
    return df.groupBy(*keys, "time").agg(
        F.sum(event).alias("n_events"), F.sum(1 - event).alias("n_censored"),
        F.count(F.lit(1)).alias("_n"),
    )


def kaplan_meier(df: DataFrame) -> DataFrame:
    """The curve of :func:`placed_curve` without its buckets."""
    return placed_curve(df).drop(BUCKET)


def placed_curve(df: DataFrame) -> DataFrame:
    """Columns group, time, n_at_risk, n_events, n_censored, survival and the Greenwood errors.

    The survival product is the exponential of a running sum of logarithms; a step at which
    everybody at risk has the event sets it to zero from there on. Errors that are infinite or
    undefined after such a step are null. Times are placed once (column ``_bucket``), for both running totals and
    for whatever works along the curve.
    """
    counts = place(_per_time(with_defaults(df), ["group"]), ["group"], "time")
    # Counted from the latest time back, the running total is the number at risk.
    at_risk = running_totals(counts, ["group"], "time", {"n_at_risk": "_n"}, falling=True)
    d, n = F.col("n_events").cast("double"), F.col("n_at_risk").cast("double")
    last = F.col("n_events") == F.col("n_at_risk")
    terms = at_risk.select(
        BUCKET, "group", "time", "n_at_risk", "n_events", "n_censored",
        F.when(last, F.lit(0.0)).otherwise(F.log1p(-d / n)).alias("_log"),
        F.when(last, F.lit(0.0)).otherwise(d / (n * (n - d))).alias("_gw"),
        last.cast("long").alias("_zero"),
    )
    sums = running_totals(terms, ["group"], "time", {"_slog": "_log", "_sgw": "_gw", "_szero": "_zero"})
    alive = F.col("_szero") == 0
    root = F.sqrt("_sgw")
    survival = F.when(alive, F.exp("_slog")).otherwise(F.lit(0.0))
    return sums.select(
        BUCKET, "group", "time", "n_at_risk", "n_events", "n_censored",
        survival.alias("survival"),
        F.when(alive, root * survival).alias("se"),
        F.when(alive, root).alias("se_log"),
        F.when(alive & (F.col("_slog") < 0), root / F.col("_slog")).alias("se_loglog"),
    )


def km_confidence(curve: DataFrame, z: float = 1.96, kind: str = "ordinary") -> DataFrame:
    """Lower and upper limits on the plain, ``log`` or ``loglog`` scale, clipped to [0, 1]."""
    s = F.col("survival")
    error = {"ordinary": "se", "log": "se_log", "loglog": "se_loglog"}[kind]
    if kind == "ordinary":
        centre, back = s, lambda v: v
    elif kind == "log":
        centre, back = F.when(s > 0, F.log(s)), F.exp
    else:
        centre, back = F.when((s > 0) & (s < 1), F.log(-F.log(s))), lambda v: F.exp(-F.exp(v))
    low, high = back(centre - z * F.col(error)), back(centre + z * F.col(error))
    limit = lambda v, edge: F.when(v.isNotNull(), edge)
    return curve.withColumns({
        "lower": limit(low, F.greatest(F.lit(0.0), low)),
        "upper": limit(high, F.least(F.lit(1.0), high)),
    })


def km_step_points(curve: DataFrame, value: str = "survival") -> DataFrame:
    """Corner points of the step function: at each time the previous value, then the own one. A curve that kept its buckets
    is not placed again."""
    points = F.array(
        F.struct(F.lit(0).alias("part"), F.col("previous").alias("y")),
        F.struct(F.lit(1).alias("part"), F.col(value).alias("y")),
    )
    return (
        previous_values(curve, ["group"], "time", value)
        .select("group", F.col("time").alias("x"), F.inline(points))
        .where(F.col("y").isNotNull() & ~F.isnan("y"))
    )


def logrank_statistic(df: DataFrame, group: str = "in_first") -> DataFrame:
    """Two-group log-rank test: observed and expected events of the first group, variance, χ².

    ``group`` is a 0/1 or boolean column.
    """
    first = F.col(group).cast("long")
    event = F.col("event").cast("long")
    counts = df.groupBy("time").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(first).alias("_n1"),
        F.sum(event).alias("_d"), F.sum(event * first).alias("_d1"),
    )
    backward = running_totals(counts, [], "time", {"n": "_n", "n1": "_n1"}, falling=True)
    at_risk = backward.select(
        *[F.col(c).cast("double").alias(out) for out, c in (("n", "n"), ("n1", "n1"), ("d", "_d"), ("d1", "_d1"))]
    ).where("d > 0")
    share = F.col("n1") / F.col("n")
    spread = F.when(
        F.col("n") > 1, F.col("d") * share * (1 - share) * (F.col("n") - F.col("d")) / (F.col("n") - 1)
    ).otherwise(F.lit(0.0))
    return at_risk.agg(
        F.sum("d1").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(spread).alias("variance")
    ).withColumn("chi2", F.try_divide(F.pow(F.col("observed") - F.col("expected"), 2), F.col("variance")))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(chi2: pd.Series) -> pd.Series:
    """Upper tail of χ² with one degree of freedom."""
    return chi2.map(lambda v: math.erfc(math.sqrt(v / 2.0)), na_action="ignore")


def logrank_test(df: DataFrame, group: str = "in_first") -> DataFrame:
    return logrank_statistic(df, group).withColumn("p_value", F.round(chi2_p_value("chi2"), 6))


def median_split(df: DataFrame, covariate: str) -> DataFrame:
    """Column ``group``: at or above / below the median when the covariate has more than two
    values, otherwise equal to 1 / not."""
    clean = survival_clean(df, [covariate])
    middle = median(clean, [], covariate).select("median").scalar()
    # A third distinct value shows in the smallest and largest ones: nothing lies between two.
    ends = single_row(clean.agg(F.min(covariate).alias("lo"), F.max(covariate).alias("hi")))
    between = clean.withColumn("_ends", ends).agg(
        F.bool_or((F.col(covariate) > F.col("_ends.lo")) & (F.col(covariate) < F.col("_ends.hi"))).alias("many")
    ).scalar()
    above = F.when(F.col(covariate) >= F.col("_median"), f"above median of {covariate}").otherwise(
        f"below median of {covariate}"
    )
    flag = F.when(F.col(covariate) == 1, covariate).otherwise(f"not {covariate}")
    return (
        clean.withColumns({"_median": middle, "_many": between})
        .withColumn("group", F.when(F.col("_many"), above).otherwise(flag))
        .drop("_median", "_many")
    )


def covariate_cardinality(df: DataFrame, covariates: list[str]) -> DataFrame:
    """Distinct values and whether the covariate is binary, one row per covariate.

    Distinct (covariate, value) pairs are found by an ordinary grouped aggregation, so a
    covariate with many values is spread over the cluster.
    """
    pairs = melt(df, [], covariates).groupBy("variable", "value").agg(F.lit(1).alias("_one"))
    return pairs.where("value IS NOT NULL").groupBy("variable").agg(
        F.count(F.lit(1)).alias("distinct_values")
    ).withColumn("is_binary", F.col("distinct_values") == 2)


def melt(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(ids, columns, "variable", "value")


def standardize_covariates(df: DataFrame, covariates: list[str]) -> DataFrame:
    """Sample z-scores; binary covariates stay as they are, and constant ones become null."""
    binary = covariate_cardinality(df, covariates).where("is_binary").agg(
        F.collect_list("variable").alias("v")
    ).scalar()
    moments = single_row(df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in covariates], *[F.stddev_samp(c).alias(f"s_{c}") for c in covariates]
    ))
    scaled: dict[str, Column] = {
        c: F.when(F.array_contains("_binary", c), F.col(c).cast("double")).otherwise(
            F.try_divide(F.col(c) - F.col(f"_moments.m_{c}"), F.col(f"_moments.s_{c}"))
        )
        for c in covariates
    }
    return df.withColumns({"_binary": binary, "_moments": moments}).withColumns(scaled).select(*df.columns)


def risk_index(df: DataFrame, hazard_ratios: dict[str, float]) -> DataFrame:
    """Column ``risk``: Σ covariate · ln(hazard ratio)."""
    total = F.lit(0.0)
    for name, ratio in hazard_ratios.items():
        total = total + F.col(name) * math.log(ratio)
    return df.withColumn("risk", total)


def risk_index_split(df: DataFrame, hazard_ratios: dict[str, float]) -> DataFrame:
    """``risk`` and ``high_risk`` (at or above the median)."""
    scored = risk_index(df, hazard_ratios)
    middle = median(scored, [], "risk").select("median").scalar()
    return scored.withColumn("_median", middle).withColumn(
        "high_risk", (F.col("risk") >= F.col("_median")).cast("int")
    ).drop("_median")
