"""Feature ingest: validity, magnification, normalisation and slide layout."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelquarry.functions.numbers import unzscore, zscore
from labelquarry.operators.ranks import single_row

# Fixed value: slides scanned at this magnification are stored at half scale.
DOUBLE_SCALE_MAGNIFICATION = 40.0


def is_finite_vector(features: Column) -> Column:
    return F.forall(
        features,
        lambda f: f.isNotNull() & ~F.isnan(f.cast("double")) & (F.abs(f.cast("double")) < float("inf")),
    )


def reject_nonfinite(df: DataFrame, features: str = "features") -> DataFrame:
    return df.where(is_finite_vector(F.col(features)))


def ingest_rejects(df: DataFrame, by: list[str], features: str = "features") -> DataFrame:
    """Kept and rejected row counts."""
    bad = (~is_finite_vector(F.col(features))).cast("long")
    return df.groupBy(*by).agg(
        (F.count(F.lit(1)) - F.sum(bad)).alias("kept"), F.sum(bad).alias("rejected")
    )


def scale_factor(scan_mag: Column, always: bool = False) -> Column:
    if always:
        return F.lit(2.0)
    return F.when(scan_mag == DOUBLE_SCALE_MAGNIFICATION, F.lit(2.0)).otherwise(F.lit(1.0))


def scale_coordinates(df: DataFrame, always: bool = False, boundary: str | None = "boundary") -> DataFrame:
    """Centroid and outline in analysis coordinates."""
    factor = scale_factor(F.col("scan_mag"), always)
    changes = {"x": F.col("x") * factor, "y": F.col("y") * factor}
    if boundary and boundary in df.columns:
        changes[boundary] = F.transform(
            boundary, lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y"))
        )
    return df.withColumns(changes)


def feature_stats(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: ``mean`` and sample ``std`` of every feature, in one pass over the vectors."""
    vector = array_to_vector(F.col(features).cast("array<double>"))
    summary = df.select(Summarizer.metrics("mean", "std").summary(vector).alias("s"))
    return summary.select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std")
    )


def zscore_features(df: DataFrame, params: DataFrame, features: str = "features") -> DataFrame:
    """Normalise by a one-row parameter table."""
    return df.withColumn("_p", single_row(params)).withColumn(
        features, zscore(F.col(features), F.col("_p.mean"), F.col("_p.std"))
    ).drop("_p")


def renormalize(df: DataFrame, own: DataFrame, target: DataFrame, features: str = "features") -> DataFrame:
    """Vectors normalised with ``own`` parameters, expressed in those of ``target``."""
    raw = unzscore(F.col(features), F.col("_own.mean"), F.col("_own.std"))
    return (
        df.withColumns({"_own": single_row(own), "_target": single_row(target)})
        .withColumn(features, zscore(raw, F.col("_target.mean"), F.col("_target.std")))
        .drop("_own", "_target")
    )


def slide_offsets(objects: DataFrame) -> DataFrame:
    """First row number of each slide when rows are stored slide by slide, in name order.

    The window runs over one row per slide.
    """
    before = Window.orderBy("slide").rowsBetween(Window.unboundedPreceding, -1)
    return (
        objects.groupBy("slide").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("first_row", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )


def compact_slide_index(labeled: DataFrame, slide: str = "slide") -> DataFrame:
    """The slides in use, numbered from zero in ascending order (one row per slide)."""
    return labeled.select(slide).distinct().withColumn(
        "slide_idx", F.row_number().over(Window.orderBy(slide)) - 1
    )
