"""Choosing objects to label."""

from pyspark.sql import functions as F

from labelquarry.operators import sampling as s
from workload import tables as t
from workload.registry import query
from workload.tables import LABELED, OBJ, with_ctes

POOL = "pool AS (SELECT * FROM obj WHERE object_id NOT IN (SELECT object_id FROM labeled))"
SHOWN = ["object_id", "slide", "score"]


def _pool(spark, d):
    return s.unlabeled_pool(t.objects(spark, d), t.labeled(spark, d))


@query("unlabeled_pool", with_ctes("SELECT object_id, slide, score FROM pool", OBJ, LABELED, POOL))
def unlabeled_pool(spark, d):
    return _pool(spark, d).select(*SHOWN)


@query("uncertain_topk", with_ctes(
    "SELECT object_id, slide, score FROM pool ORDER BY abs(score), object_id LIMIT 8", OBJ, LABELED, POOL))
def uncertain_topk(spark, d):
    return s.uncertain(_pool(spark, d)).select(*SHOWN)


@query("uncertain_topk_weighted", with_ctes("""
SELECT object_id, slide, score, round(weighted, 9) AS weighted FROM (
  SELECT p.*, abs(score) + coalesce(taken / CAST((SELECT count(*) FROM labeled) AS DOUBLE), 0) AS weighted
  FROM pool p LEFT JOIN (SELECT slide, count(*) AS taken FROM labeled GROUP BY slide) USING (slide))
ORDER BY weighted, object_id LIMIT 8""", OBJ, LABELED, POOL))
def uncertain_topk_weighted(spark, d):
    top = s.uncertain_weighted(_pool(spark, d), t.labeled(spark, d))
    return top.select(*SHOWN, F.round("weighted", 9).alias("weighted"))


@query("uncertain_topk_ties", with_ctes("""
SELECT object_id, slide, coarse_score AS score FROM pool
ORDER BY abs(coarse_score), md5('7:' || object_id), object_id LIMIT 8""", OBJ, LABELED, POOL))
def uncertain_topk_ties(spark, d):
    pool = _pool(spark, d).withColumn("score", F.col("coarse_score"))
    return s.uncertain_spread(pool, seed=7).select(*SHOWN)


@query("most_uncertain", with_ctes(
    "SELECT object_id, slide, score FROM pool ORDER BY abs(score), object_id LIMIT 1", OBJ, LABELED, POOL))
def most_uncertain(spark, d):
    return s.most_uncertain(_pool(spark, d)).select(*SHOWN)


@query("random_sample", with_ctes(
    "SELECT object_id, slide, score FROM pool ORDER BY md5('7:' || object_id), object_id LIMIT 8", OBJ, LABELED, POOL))
def random_sample(spark, d):
    return s.random_sample(_pool(spark, d), 8, seed=7).select(*SHOWN)


@query("uncertain_subsample", with_ctes("""
SELECT object_id, slide, score FROM pool
WHERE CAST('0x' || substr(md5('7:' || object_id), 1, 8) AS BIGINT) < 429496729
ORDER BY abs(score), object_id LIMIT 8""", OBJ, LABELED, POOL))
def uncertain_subsample(spark, d):
    return s.uncertain_subsample(_pool(spark, d), seed=7).select(*SHOWN)


BINNED = """
binned AS (SELECT *, CASE WHEN score <= -0.5 THEN 0 WHEN score <= -0.25 THEN 1 WHEN score <= 0 THEN 2 WHEN score <= 0.1 THEN 3
                          WHEN score <= 0.25 THEN 4 WHEN score <= 0.3 THEN 5 WHEN score <= 0.5 THEN 6 ELSE 7 END AS bin FROM pool)"""


@query("score_bins", with_ctes("SELECT bin, count(*) AS n FROM binned GROUP BY bin", OBJ, LABELED, POOL, BINNED))
def score_bins(spark, d):
    return s.with_score_bin(_pool(spark, d)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("bin_samples", with_ctes("""
SELECT bin AS asked_bin, bin AS source, object_id, slide, score
FROM binned QUALIFY row_number() OVER (PARTITION BY bin ORDER BY md5('7:' || object_id), object_id) = 1""",
    OBJ, LABELED, POOL, BINNED))
def bin_samples(spark, d):
    return s.bin_samples(_pool(spark, d), seed=7).select("asked_bin", "source", *SHOWN)


@query("visualization_strata", with_ctes("""
, sizes AS (SELECT positive, count(*) AS n FROM ranked GROUP BY positive),
wanted AS (
  SELECT positive, s AS stratum, g AS grp,
         CASE WHEN s = 0 THEN 0 WHEN s = 3 THEN n - 3 ELSE CAST(floor(s * n / 3) AS BIGINT) END + g AS rnk
  FROM sizes, range(0, 4) a(s), range(0, 2) b(g))
SELECT CAST(grp * 8 + r.positive * 4 + stratum AS INTEGER) AS position, CAST(stratum AS INTEGER) AS stratum,
       CAST(grp AS INTEGER) AS grp, r.positive, object_id, score
FROM ranked r JOIN wanted w ON r.positive = w.positive AND r.rnk = w.rnk""".strip(), OBJ, LABELED, POOL, """
ranked AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY score, md5(object_id)) - 1 AS rnk
           FROM (SELECT *, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS positive FROM pool))"""))
def visualization_strata(spark, d):
    """Four strata, two groups."""
    return s.display_strata(_pool(spark, d), 4, 2).select("position", "stratum", "grp", "positive", "object_id", "score")
