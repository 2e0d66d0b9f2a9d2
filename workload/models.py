"""Scores and fits of models. Fitted models have no SQL; the fixed linear scorer has."""

from pyspark.sql import functions as F

from labelquarry.operators import cox, scoring
from workload import tables as t
from workload.registry import query
from workload.tables import VEC, with_ctes


@query("apply_scores", with_ctes("SELECT object_id, slide, round(score, 6) AS score FROM vec", VEC))
def apply_scores(spark, d):
    model = scoring.LinearScorer(t.WEIGHTS).fit(t.vectors(spark, d))
    return model.score(t.vectors(spark, d)).select("object_id", "slide", F.round("score", 6).alias("score"))


@query("class_priors", with_ctes("""
SELECT label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS prior FROM vec WHERE label <> 0 GROUP BY label""", VEC))
def class_priors(spark, d):
    return scoring.class_priors(t.vectors(spark, d)).withColumn("prior", F.round("prior", 9))


@query("insample_accuracy", with_ctes("""
SELECT round(avg(CASE WHEN (score >= 0) = (label = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM vec WHERE label <> 0""", VEC))
def insample_accuracy(spark, d):
    return scoring.insample_accuracy(t.vectors(spark, d), scoring.LinearScorer(t.WEIGHTS)).select(
        F.round("accuracy", 9).alias("accuracy")
    )


def _model_scores(spark, d, scorer):
    vectors = t.vectors(spark, d)
    return scorer.fit(vectors).score(vectors).select("object_id", "label", F.round("score", 6).alias("score"))


@query("random_forest_scores")
def random_forest_scores(spark, d):
    return _model_scores(spark, d, scoring.RandomForestScorer(seed=1))


@query("network_scores")
def network_scores(spark, d):
    return _model_scores(spark, d, scoring.NetworkScorer(seed=1))


@query("rbf_margin_scores")
def rbf_margin_scores(spark, d):
    return _model_scores(spark, d, scoring.RbfMarginScorer(seed=1))


COVARIATES = ["quantity", "discount", "tax", "returned"]


@query("cox_multivariate")
def cox_multivariate(spark, d):
    return cox.cox_table(spark, [cox.fit_cox(t.study(spark, d), COVARIATES, standardize=True)])


@query("cox_univariate")
def cox_univariate(spark, d):
    return cox.cox_table(spark, cox.fit_cox_univariate(t.study(spark, d), COVARIATES))
