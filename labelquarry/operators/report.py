"""Counts, confusion, ROC and review reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelquarry.functions.numbers import score_to_probability, sign_class
from labelquarry.operators.ranks import running_totals


def slide_positive_counts(scored: DataFrame, tie_positive: bool = False) -> DataFrame:
    """Positive and total objects per slide; a zero score is negative unless ``tie_positive``."""
    positive = F.col("score") >= 0 if tie_positive else F.col("score") > 0
    return scored.groupBy("slide").agg(
        F.sum(positive.cast("long")).alias("positive"), F.count(F.lit(1)).alias("total")
    )


def slide_class_counts(classified: DataFrame) -> DataFrame:
    positive = (F.col("predicted") == 1).cast("long")
    return classified.groupBy("slide").agg(
        F.sum(positive).alias("positive"), F.sum(1 - positive).alias("negative")
    )


def slide_percent_positive(counts: DataFrame) -> DataFrame:
    return counts.withColumn("percent", F.round(100.0 * F.col("positive") / F.col("total")))


def count_report(classified: DataFrame) -> DataFrame:
    """Long form of the count report: one row per (class, slide)."""
    counts = slide_class_counts(classified)
    return counts.select(
        "slide", F.expr("stack(2, 'positive', positive, 'negative', negative) AS (class, n)")
    )


def count_report_pivot(classified: DataFrame, slides: list[str]) -> DataFrame:
    """Two rows, one column per slide named; for reports over a chosen slide list."""
    return (
        count_report(classified).groupBy("class").pivot("slide", slides).agg(F.first("n"))
        .select("class", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s) for s in slides])
    )


def roc_points(labeled_scores: DataFrame, key: str = "object_id") -> DataFrame:
    """True label and probability of each object."""
    return labeled_scores.select(key, "label", score_to_probability(F.col("score")).alias("probability"))


def confusion_matrix(labeled_scores: DataFrame) -> DataFrame:
    """Counts and rates in one row; labels other than 1 are negative, a zero score is positive."""
    actual, predicted = F.col("label") == 1, sign_class(F.col("score")) == 1
    count = lambda c: F.sum(c.cast("long"))
    totals = labeled_scores.agg(
        count(actual & predicted).alias("tp"), count(~actual & predicted).alias("fp"),
        count(~actual & ~predicted).alias("tn"), count(actual & ~predicted).alias("fn"),
    )
    c = F.col
    return totals.select(
        "tp", "fp", "tn", "fn",
        (c("tp") + c("fn")).alias("p"), (c("fp") + c("tn")).alias("n"),
        F.try_divide(c("fp").cast("double"), c("fp") + c("tn")).alias("fpr"),
        F.try_divide(c("tp").cast("double"), c("tp") + c("fn")).alias("tpr"),
        F.try_divide(c("tp").cast("double"), c("tp") + c("fp")).alias("precision"),
        F.try_divide((c("tp") + c("tn")).cast("double"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"),
    )


def slide_score_map(scored: DataFrame, slide: str) -> DataFrame:
    return scored.where(F.col("slide") == slide).select("score", "x", "y")


def review_totals(labeled: DataFrame) -> DataFrame:
    """Distinct slides, samples, positives and negatives."""
    return labeled.agg(
        F.countDistinct("slide").alias("slides"), F.count(F.lit(1)).alias("samples"),
        F.sum((F.col("label") == 1).cast("long")).alias("positives"),
        F.sum((F.col("label") == -1).cast("long")).alias("negatives"),
    )


def samples_by_slide(labeled: DataFrame, key: str = "object_id", per_list: int = 1000) -> DataFrame:
    """Lists of (id, label) per slide for display, in numbered pages of ``per_list`` samples in the order of the
    id, a number or a text (rows of one id share a page, those without an id the first one).

    A slide of any size becomes several bounded lists rather than one.
    """
    counts = labeled.groupBy("slide", key).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, ["slide"], key, {"_upto": "_n"})
    page = F.floor((F.col("_upto") - F.col("_n")) / per_list).cast("int")
    pages = placed.select(F.col("slide").alias("_slide"), F.col(key).alias("_key"), page.alias("page"))
    return (
        labeled.join(pages, (F.col("slide") == F.col("_slide")) & F.col(key).eqNullSafe(F.col("_key")))
        .groupBy("slide", "page")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), "label"))).alias("samples"))
    )


def samples_json(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Each sample as a JSON object."""
    return samples.select(F.to_json(F.struct(*columns)).alias("json"))
