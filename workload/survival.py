"""Survival curves, tests and splits."""

import math

from pyspark.sql import functions as F

from labelquarry.operators import cox
from labelquarry.operators import survival as sv
from workload import tables as t
from workload.registry import query
from workload.tables import STUDY, with_ctes

KM = """
steps AS (
  SELECT grp, time, sum(n) OVER w AS n_at_risk, d AS n_events, n - d AS n_censored FROM (
    SELECT grp, time, count(*) AS n, CAST(sum(event) AS BIGINT) AS d FROM study GROUP BY grp, time)
  WINDOW w AS (PARTITION BY grp ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
sums AS (
  SELECT *, sum(CASE WHEN n_events = n_at_risk THEN 1 ELSE 0 END) OVER w AS zeros,
         sum(CASE WHEN n_events = n_at_risk THEN 0 ELSE ln(1 - n_events / CAST(n_at_risk AS DOUBLE)) END) OVER w AS slog,
         sum(CASE WHEN n_events = n_at_risk THEN 0 ELSE n_events / (CAST(n_at_risk AS DOUBLE) * (n_at_risk - n_events)) END) OVER w AS sgw
  FROM steps WINDOW w AS (PARTITION BY grp ORDER BY time)),
km AS (
  SELECT grp, time, CAST(n_at_risk AS BIGINT) AS n_at_risk, n_events, n_censored, CASE WHEN zeros > 0 THEN 0 ELSE exp(slog) END AS survival,
         CASE WHEN zeros = 0 THEN sqrt(sgw) * exp(slog) END AS se, CASE WHEN zeros = 0 THEN sqrt(sgw) END AS se_log,
         CASE WHEN zeros = 0 AND slog < 0 THEN sqrt(sgw) / slog END AS se_loglog
  FROM sums)"""


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("kaplan_meier", with_ctes("""
SELECT grp AS "group", time, n_at_risk, n_events, n_censored, round(survival, 6) AS survival FROM km""", STUDY, KM))
def kaplan_meier(spark, d):
    curve = sv.kaplan_meier(t.study(spark, d)).select("group", "time", "n_at_risk", "n_events", "n_censored", "survival")
    return _rounded(curve, "survival")


@query("km_greenwood", with_ctes("""
SELECT grp AS "group", time, round(se, 6) AS se, round(se_log, 6) AS se_log, round(se_loglog, 6) AS se_loglog FROM km""", STUDY, KM))
def km_greenwood(spark, d):
    curve = sv.kaplan_meier(t.study(spark, d)).select("group", "time", "se", "se_log", "se_loglog")
    return _rounded(curve, "se", "se_log", "se_loglog")


def _confidence_sql():
    parts = []
    for kind, centre, back, error in (
        ("ordinary", "survival", "{}", "se"),
        ("log", "CASE WHEN survival > 0 THEN ln(survival) END", "exp({})", "se_log"),
        ("loglog", "CASE WHEN survival > 0 AND survival < 1 THEN ln(-ln(survival)) END", "exp(-exp({}))", "se_loglog"),
    ):
        limit = lambda sign: back.format(f"{centre} {sign} 1.96 * {error}")  # noqa: B023, E731
        low, high = limit("-"), limit("+")
        parts.append(f"""
SELECT grp AS "group", time, '{kind}' AS kind, round(CASE WHEN {low} IS NOT NULL THEN greatest(0, {low}) END, 6) AS lower,
       round(CASE WHEN {high} IS NOT NULL THEN least(1, {high}) END, 6) AS upper FROM km""")
    return " UNION ALL ".join(parts)


@query("km_confidence", with_ctes(_confidence_sql(), STUDY, KM))
def km_confidence(spark, d):
    """Limits of all three kinds."""
    curve = sv.kaplan_meier(t.study(spark, d))
    kinds = [
        sv.km_confidence(curve, kind=k).select("group", "time", F.lit(k).alias("kind"), "lower", "upper")
        for k in ("ordinary", "log", "loglog")
    ]
    return _rounded(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), "lower", "upper")


@query("km_step_points", with_ctes("""
SELECT grp AS "group", time AS x, 0 AS part, round(y, 6) AS y FROM (SELECT *, lag(survival) OVER (PARTITION BY grp ORDER BY time) AS y FROM km) WHERE y IS NOT NULL
UNION ALL SELECT grp, time, 1, round(survival, 6) FROM km""", STUDY, KM))
def km_step_points(spark, d):
    return _rounded(sv.km_step_points(sv.placed_curve(t.study(spark, d))), "y")


LOGRANK = """
SELECT CAST(sum(d1) AS BIGINT) AS observed, round(sum(d * n1 / n), 6) AS expected,
       round(sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END), 6) AS variance,
       round(pow(sum(d1) - sum(d * n1 / n), 2) / sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END), 6) AS chi2
FROM (SELECT d, d1, CAST(sum(c) OVER w AS DOUBLE) AS n, CAST(sum(c1) OVER w AS DOUBLE) AS n1 FROM (
        SELECT time, sum(event) AS d, sum(event * first) AS d1, count(*) AS c, sum(first) AS c1 FROM two GROUP BY time)
      WINDOW w AS (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
WHERE d > 0"""


@query("logrank_statistic", with_ctes(LOGRANK, STUDY, "two AS (SELECT time, event, returned AS first FROM study)"))
def logrank_statistic(spark, d):
    test = sv.logrank_statistic(t.study(spark, d), "returned")
    return _rounded(test.withColumn("observed", F.col("observed").cast("long")), "expected", "variance", "chi2")


# The error function by its series of positive terms; beyond 60 the tail is below a billionth.
P_VALUE = """
SELECT round(chi2, 6) AS chi2, CASE WHEN chi2 > 60 THEN 0 ELSE round(1 - 2 / sqrt(pi()) * exp(-chi2 / 2) * list_sum(list_transform(range(0, 300),
         lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(sqrt(chi2 / 2)) + lgamma(n + 1) - lgamma(2 * n + 2)))), 6) END AS p_value
FROM (SELECT pow(sum(d1) - sum(d * n1 / n), 2) / sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS chi2
""" + LOGRANK[LOGRANK.index("FROM (SELECT d, d1"):] + ")"


@query("logrank_p_value", with_ctes(P_VALUE, STUDY, "two AS (SELECT time, event, returned AS first FROM study)"))
def logrank_p_value(spark, d):
    return sv.logrank_test(t.study(spark, d), "returned").select(F.round("chi2", 6).alias("chi2"), "p_value")


@query("survival_clean", with_ctes("""
SELECT time, event, discount, tax FROM (SELECT time, event, nullif(discount, 0) AS discount, CASE WHEN tax = 0 THEN NULL ELSE tax END AS tax FROM study)
WHERE discount IS NOT NULL AND tax IS NOT NULL""", STUDY))
def survival_clean(spark, d):
    """Zero discounts become null, zero taxes NaN; both kinds of rows go."""
    rows = t.study(spark, d).select(
        "time", "event", F.nullif("discount", F.lit(0.0)).alias("discount"),
        F.when(F.col("tax") == 0, F.lit(float("nan"))).otherwise(F.col("tax")).alias("tax"),
    )
    return sv.survival_clean(rows, ["time", "event", "discount", "tax"])


@query("km_median_split", with_ctes("""
SELECT CASE WHEN quantity >= (SELECT median(quantity) FROM study) THEN 'above median of quantity' ELSE 'below median of quantity' END AS "group",
       count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM study GROUP BY 1
UNION ALL SELECT CASE WHEN returned = 1 THEN 'returned' ELSE 'not returned' END, count(*), CAST(sum(event) AS BIGINT) FROM study GROUP BY 1""", STUDY))
def km_median_split(spark, d):
    """Sizes of the groups by a many-valued and by a binary covariate."""
    rows = t.study(spark, d).drop("group")
    size = lambda c: sv.median_split(rows, c).groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("events")
    )
    return size("quantity").unionByName(size("returned"))


@query("covariate_cardinality", with_ctes("""
SELECT variable, distinct_values, distinct_values = 2 AS is_binary FROM (
  SELECT 'quantity' AS variable, count(DISTINCT quantity) AS distinct_values FROM study UNION ALL
  SELECT 'discount', count(DISTINCT discount) FROM study UNION ALL SELECT 'tax', count(DISTINCT tax) FROM study UNION ALL
  SELECT 'returned', count(DISTINCT returned) FROM study)""", STUDY))
def covariate_cardinality(spark, d):
    return sv.covariate_cardinality(t.study(spark, d), ["quantity", "discount", "tax", "returned"])


@query("standardize_covariates", with_ctes("""
SELECT time, event, round((quantity - (SELECT avg(quantity) FROM study)) / (SELECT stddev_samp(quantity) FROM study), 6) + 0.0 AS quantity,
       CAST(returned AS DOUBLE) AS returned FROM study""", STUDY))
def standardize_covariates(spark, d):
    rows = t.study(spark, d).select("time", "event", "quantity", F.col("returned").cast("double").alias("returned"))
    return sv.standardize_covariates(rows, ["quantity", "returned"]).withColumn("quantity", F.round("quantity", 6) + 0.0)


HAZARDS = {"quantity": 1.02, "discount": 0.7, "tax": 1.5, "returned": 0.9}
RISK = f"""
risks AS (SELECT time, event, 0.0 + quantity * CAST({math.log(1.02)!r} AS DOUBLE) + discount * CAST({math.log(0.7)!r} AS DOUBLE)
                 + tax * CAST({math.log(1.5)!r} AS DOUBLE) + returned * CAST({math.log(0.9)!r} AS DOUBLE) AS risk FROM study),
two AS (SELECT time, event, CASE WHEN risk >= (SELECT median(risk) FROM risks) THEN 1 ELSE 0 END AS first FROM risks)"""


@query("risk_index_split", with_ctes("""
SELECT first AS high_risk, count(*) AS n, CAST(sum(event) AS BIGINT) AS events, sum(time) AS time_sum FROM two GROUP BY first""", STUDY, RISK))
def risk_index_split(spark, d):
    return sv.risk_index_split(t.study(spark, d), HAZARDS).groupBy("high_risk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"), F.sum("time").alias("time_sum")
    )


@query("risk_index_logrank", with_ctes(LOGRANK, STUDY, RISK))
def risk_index_logrank(spark, d):
    test = sv.logrank_statistic(sv.risk_index_split(t.study(spark, d), HAZARDS), "high_risk")
    return _rounded(test.withColumn("observed", F.col("observed").cast("long")), "expected", "variance", "chi2")


@query("cox_derivatives", with_ctes("""
SELECT round(sum(once * eta - ln(w)), 3) AS ll, round(sum(once * e0 - w0 / w), 3) AS g0, round(sum(once * e1 - w1 / w), 3) AS g1,
       round(sum(w00 / w - (w0 / w) * (w0 / w)), 3) AS h0_0, round(sum(w01 / w - (w0 / w) * (w1 / w)), 3) AS h0_1, round(sum(w11 / w - (w1 / w) * (w1 / w)), 3) AS h1_1
FROM (SELECT CASE WHEN l = 0 THEN 1 ELSE 0 END AS once, eta, e0, e1, s - l / d * t AS w, s0 - l / d * t0 AS w0, s1 - l / d * t1 AS w1,
             s00 - l / d * t00 AS w00, s01 - l / d * t01 AS w01, s11 - l / d * t11 AS w11
      FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM at_risk WHERE d > 0))""", STUDY, """
terms AS (SELECT time, CAST(event AS DOUBLE) AS event, quantity / 10 AS a, discount * 10 AS b, 0.05 * (quantity / 10) - 0.2 * (discount * 10) AS eta FROM study),
per_time AS (
  SELECT time, sum(event) AS d, sum(event * eta) AS eta, sum(event * a) AS e0, sum(event * b) AS e1,
         sum(exp(eta)) AS r, sum(exp(eta) * a) AS r0, sum(exp(eta) * b) AS r1, sum(exp(eta) * a * a) AS r00, sum(exp(eta) * a * b) AS r01, sum(exp(eta) * b * b) AS r11,
         sum(event * exp(eta)) AS t, sum(event * exp(eta) * a) AS t0, sum(event * exp(eta) * b) AS t1, sum(event * exp(eta) * a * a) AS t00,
         sum(event * exp(eta) * a * b) AS t01, sum(event * exp(eta) * b * b) AS t11
  FROM terms GROUP BY time),
at_risk AS (
  SELECT *, sum(r) OVER w AS s, sum(r0) OVER w AS s0, sum(r1) OVER w AS s1, sum(r00) OVER w AS s00, sum(r01) OVER w AS s01, sum(r11) OVER w AS s11
  FROM per_time WINDOW w AS (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""))
def cox_derivatives(spark, d):
    """Log-likelihood, gradient and information of two covariates at fixed coefficients."""
    rows = t.study(spark, d).select("time", "event", (F.col("quantity") / 10).alias("a"), (F.col("discount") * 10).alias("b"))
    out = cox.cox_derivatives(rows, ["a", "b"], [0.05, -0.2])
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


@query("cox_table_join", with_ctes("""
SELECT variable, u.n AS n, m.n AS multi_n FROM (SELECT o_orderpriority AS variable, count(*) AS n FROM orders GROUP BY 1) u
FULL OUTER JOIN (SELECT CASE WHEN grp = '1-URGENT' THEN 'other' ELSE grp END AS variable, count(*) AS n FROM study GROUP BY 1) m USING (variable)""", STUDY))
def cox_table_join(spark, d):
    """Side-by-side tables whose variables overlap in part."""
    uni = t.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("variable")).agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("group") == "1-URGENT", "other").otherwise(F.col("group"))
    multi = t.study(spark, d).groupBy(name.alias("variable")).agg(F.count(F.lit(1)).alias("n"))
    return cox.join_cox_tables(uni, multi)
