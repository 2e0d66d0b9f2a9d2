"""Cox proportional hazards with Efron's handling of ties.

Equal rows are counted, once per fit. Each Newton step is one Spark job: sums per event time, running sums
from the last time back, ties summed by numpy beside their row, and one row of derivatives per model. Only
that row — D and D×D numbers — reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from labelquarry.functions.numbers import two_digit_scientific
from labelquarry.operators.ranks import BUCKET, cuts_of, place_by, running_totals
from labelquarry.operators.survival import melt, standardize_covariates, survival_clean

# Fixed value: half-width of the 95 % limits in standard errors.
Z_95 = 1.959963984540054
TIE_CHUNK = 4096
TIE_MANY = 256  # events from which a row is summed by itself
TIE_SLAB = 1 << 18  # events of several rows summed at once
TIE_SUMS = ["log", "a0", "a1", "b0", "b1", "b2"]


@dataclass
class CoxFit:
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    steps: int


def _pairs(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


def _derivatives(data: DataFrame, keys: list[str], width: int, linear: Column) -> DataFrame:
    """Log-likelihood, gradient and information per ``keys``; covariates are x0 … x{D−1}. A row stands for ``n`` equal
    ones if it has that column (:func:`_counted`)."""
    times = F.col("n") if "n" in data.columns else F.lit(1).cast("long")
    theta = F.exp(linear) * times
    xs = [F.col(f"x{i}") for i in range(width)]
    weighted = {"w": F.lit(1.0)}
    weighted.update({f"w{i}": xs[i] for i in range(width)})
    weighted.update({f"w{i}_{j}": xs[i] * xs[j] for i, j in _pairs(width)})
    event = F.col("event").cast("double")
    events = event * times
    at_time = data.withColumns({"_theta": theta, "_eta": linear}).groupBy(*keys, *[c for c in data.columns if c == BUCKET], "time").agg(
        F.sum(F.col("event").cast("long") * times).alias("d"),
        F.sum(events * F.col("_eta")).alias("eta"),
        *[F.sum(events * xs[i]).alias(f"e{i}") for i in range(width)],
        *[F.sum(F.col("_theta") * v).alias(f"r_{k}") for k, v in weighted.items()],
        *[F.sum(event * F.col("_theta") * v).alias(f"t_{k}") for k, v in weighted.items()],
    )
    # Running sums from the latest time back give the sums over the risk set.
    backward = running_totals(at_time, keys, "time", {f"s_{k}": f"r_{k}" for k in weighted}, falling=True)
    tied = backward.where("d > 0").withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("d") - 1, F.lit(TIE_CHUNK))))
    known = F.col("s_w").isNotNull() & F.col("t_w").isNotNull()
    sums = tied.withColumn("_f", F.when(known, _tie_sums("s_w", "t_w", "d", "_from"))).withColumn("_once", (F.col("_from") == 0).cast("double"))
    f, s, t = (lambda k: F.col(f"_f.{k}")), (lambda k: F.col(f"s_{k}")), (lambda k: F.col(f"t_{k}"))
    mean = lambda k: s(k) * f("a0") - t(k) * f("a1")
    product = lambda i, j: s(i) * s(j) * f("b0") - (s(i) * t(j) + s(j) * t(i)) * f("b1") + t(i) * t(j) * f("b2")
    once = F.col("_once")
    return sums.groupBy(*keys).agg(
        F.sum(once * F.col("eta") - f("log")).alias("ll"),
        *[F.sum(once * F.col(f"e{i}") - mean(f"w{i}")).alias(f"g{i}") for i in range(width)],
        *[F.sum(mean(f"w{i}_{j}") - product(f"w{i}", f"w{j}")).alias(f"h{i}_{j}") for i, j in _pairs(width)],
    )


def efron_sums(whole: np.ndarray, tied: np.ndarray, d: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Efron's sums over tied events, one row of six for each row given.

    The l-th of d tied events sees the risk set W = whole − f · tied with f = l / d. What the derivatives need of it are
    Σ ln W, Σ 1/W, Σ f/W, Σ 1/W², Σ f/W² and Σ f²/W², however many covariates there are. A row sums at most
    ``TIE_CHUNK`` events from ``start``; more ties make more rows in the same task.
    """
    sizes = np.minimum(start + TIE_CHUNK, d) - start
    out = np.empty((len(d), 6))
    for i in np.flatnonzero(sizes >= TIE_MANY):
        f = np.arange(start[i], start[i] + sizes[i]) / d[i]
        w = whole[i] - f * tied[i]
        with np.errstate(divide="raise"):
            one = 1 / w
        part = f * one
        out[i] = np.log(w).sum(), one.sum(), part.sum(), one @ one, part @ one, part @ part
    few = np.flatnonzero(sizes < TIE_MANY)
    slab = (np.cumsum(sizes[few]) - 1) // TIE_SLAB
    for rows in np.split(few, np.flatnonzero(np.diff(slab)) + 1) if len(few) else []:
        first = np.cumsum(sizes[rows]) - sizes[rows]
        row = np.repeat(np.arange(len(rows)), sizes[rows])
        f = (np.arange(len(row)) - first[row] + start[rows][row]) / d[rows][row]
        w = whole[rows][row] - f * tied[rows][row]
        with np.errstate(divide="raise"):
            one = 1 / w
        part = f * one
        for k, terms in enumerate((np.log(w), one, part, one * one, part * one, part * part)):
            out[rows, k] = np.add.reduceat(terms, first)
    return out


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in TIE_SUMS]))
def _tie_sums(whole: pd.Series, tied: pd.Series, d: pd.Series, start: pd.Series) -> pd.DataFrame:
    sums = efron_sums(whole.to_numpy(), tied.to_numpy(), d.to_numpy(), start.to_numpy()) if len(d) else np.empty((0, 6))
    return pd.DataFrame(sums, columns=TIE_SUMS)


def _counted(data: DataFrame) -> DataFrame:
    """Equal rows once, with their number ``n``: every Newton step reads each time and covariate that occur once."""
    return data.groupBy(*data.columns).agg(F.count(F.lit(1)).alias("n"))


def _placed_times(data: DataFrame, keys: list[str]) -> DataFrame:
    """Times keep their buckets over all steps of a fit."""
    times = data.groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("n"))
    return place_by(data, cuts_of(times, keys, "time"), keys, "time")


def cox_derivatives(df: DataFrame, covariates: list[str], beta: list[float]) -> DataFrame:
    """One row: log-likelihood ``ll``, gradient ``g<i>`` and information ``h<i>_<j>`` at given coefficients."""
    clean = survival_clean(df, ["time", "event", *covariates])
    data = clean.select(
        F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)],
    )
    return _derivatives(data, [], len(covariates), _linear(beta))


def _linear(beta) -> Column:
    total = F.lit(0.0)
    for i, b in enumerate(beta):
        total = total + F.col(f"x{i}") * float(b)
    return total


def fit_cox(df: DataFrame, covariates: list[str], flip_event: bool = False, standardize: bool = False,
            max_steps: int = 25, tolerance: float = 1e-9) -> CoxFit:
    """Fit all covariates together. Expects columns time, event and the covariates."""
    clean = survival_clean(df, ["time", "event", *covariates])
    if standardize:
        clean = standardize_covariates(clean, covariates)
    event = 1 - F.col("event") if flip_event else F.col("event")
    data = clean.select(
        F.col("time").cast("double").alias("time"), event.cast("int").alias("event"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)],
    )
    data = _placed_times(_counted(data), []).persist()
    try:
        return _newton(data, covariates, max_steps, tolerance)
    finally:
        data.unpersist()


def _newton(data: DataFrame, names: list[str], max_steps: int, tolerance: float) -> CoxFit:
    width = len(names)
    beta, previous, step = np.zeros(width), -math.inf, np.zeros(width)
    for count in range(1, max_steps + 1):
        row = _derivatives(data, [], width, _linear(beta)).first()
        value = row["ll"]
        if not math.isfinite(value) or value < previous - 1e-12 * abs(previous):
            step = step / 2.0
            beta = beta - step
            continue
        gradient = np.array([row[f"g{i}"] for i in range(width)])
        info = np.zeros((width, width))
        for i, j in _pairs(width):
            info[i, j] = info[j, i] = row[f"h{i}_{j}"]
        covariance = np.linalg.inv(info)
        step = covariance @ gradient
        if count > 1 and float(gradient @ step) < tolerance:
            return CoxFit(names, beta, covariance, value, count)
        beta, previous = beta + step, value
    raise RuntimeError("the Cox fit did not converge")


def fit_cox_univariate(df: DataFrame, covariates: list[str], flip_event: bool = False,
                       standardize: bool = False, max_steps: int = 25, tolerance: float = 1e-9) -> list[CoxFit]:
    """One model per covariate, all advanced by the same Newton jobs over the melted table."""
    clean = survival_clean(df, ["time", "event", *covariates])
    if standardize:
        clean = standardize_covariates(clean, covariates)
    event = 1 - F.col("event") if flip_event else F.col("event")
    wide = clean.withColumns({"time": F.col("time").cast("double"), "event": event.cast("int")})
    data = _placed_times(_counted(melt(wide, ["time", "event"], covariates).withColumnRenamed("value", "x0")), ["variable"]).persist()
    beta = {c: 0.0 for c in covariates}
    step = {c: 0.0 for c in covariates}
    best = {c: -math.inf for c in covariates}
    done: dict[str, CoxFit] = {}
    try:
        for count in range(1, max_steps + 1):
            open_models = [c for c in covariates if c not in done]
            if not open_models:
                break
            coefficient = F.lit(None).cast("double")
            for c in open_models:
                coefficient = F.when(F.col("variable") == c, float(beta[c])).otherwise(coefficient)
            # The linear term is a column of its own: written into the aggregates, the chain of
            # conditions makes code that does not compile, and Spark falls back to slow paths.
            part = data.select(
                "variable", BUCKET, "time", "event", "x0", "n", (F.col("x0") * coefficient).alias("linear")
            ).where(F.col("variable").isin(open_models))
            for row in _derivatives(part, ["variable"], 1, F.col("linear")).collect():  # one row per model
                c, value = row["variable"], row["ll"]
                if not math.isfinite(value) or value < best[c] - 1e-12 * abs(best[c]):
                    step[c] /= 2.0
                    beta[c] -= step[c]
                    continue
                variance = 1.0 / row["h0_0"]
                step[c] = variance * row["g0"]
                if count > 1 and row["g0"] * step[c] < tolerance:
                    done[c] = CoxFit([c], np.array([beta[c]]), np.array([[variance]]), value, count)
                    continue
                beta[c], best[c] = beta[c] + step[c], value
    finally:
        data.unpersist()
    missing = [c for c in covariates if c not in done]
    if missing:
        raise RuntimeError(f"the Cox fit did not converge for {missing}")
    return [done[c] for c in covariates]


def cox_table(spark: SparkSession, fits: list[CoxFit], rounded: bool = True) -> DataFrame:
    """Hazard ratio, 95 % limits and p value per variable (one row per coefficient)."""
    rows = []
    for fit in fits:
        for i, name in enumerate(fit.names):
            b, se = float(fit.beta[i]), math.sqrt(float(fit.covariance[i, i]))
            p = math.erfc(abs(b / se) / math.sqrt(2.0))
            rows.append((name, math.exp(b), math.exp(b - Z_95 * se), math.exp(b + Z_95 * se), p))
    table = spark.createDataFrame(rows, "variable string, hazard_ratio double, lower double, upper double, p double")
    if not rounded:
        return table
    return table.select(
        "variable", *[F.round(c, 2).alias(c) for c in ("hazard_ratio", "lower", "upper")],
        two_digit_scientific(F.col("p")).alias("p"),
    )


def join_cox_tables(univariate: DataFrame, multivariate: DataFrame) -> DataFrame:
    """Both result tables side by side by variable; a variable in one of them only stays."""
    multi = multivariate.select(
        "variable", *[F.col(c).alias(f"multi_{c}") for c in multivariate.columns if c != "variable"]
    )
    return univariate.join(multi, "variable", "full_outer")
