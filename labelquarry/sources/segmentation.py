"""Segmentation text: one line per object with centroid, features and outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelquarry.functions.text import polygon_points, slide_from_directory


def parse_segmentation(lines: DataFrame, column: str = "value", with_magnification: bool = True,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """Tab separated lines to columns; the feature count is taken from each line.

    Header lines (a first coordinate that is no number) are left out.
    """
    parts = lines.select(*keep, F.split(F.col(column), "\t").alias("_p"))
    named = parts.where(_number(1).isNotNull() & (F.size("_p") > _lead(with_magnification)))
    return named.select(*keep, *_columns(with_magnification))


def _lead(with_magnification: bool) -> int:
    """Fields before the features."""
    return 5 if with_magnification else 3


def _number(i: int) -> Column:
    return F.get("_p", i).try_cast("double")


def _columns(with_magnification: bool) -> list[Column]:
    """The columns of a line split into ``_p``; null where there is no field or no number."""
    lead = _lead(with_magnification)
    magnification = (
        [_number(3).alias("scan_mag"), _number(4).alias("analysis_mag")]
        if with_magnification
        else [F.lit(None).cast("double").alias("scan_mag"), F.lit(None).cast("double").alias("analysis_mag")]
    )
    return [
        F.trim(F.get("_p", 0)).alias("slide"),
        _number(1).alias("x"),
        _number(2).alias("y"),
        *magnification,
        F.transform(
            F.slice("_p", F.lit(lead + 1), F.greatest(F.size("_p") - (lead + 1), F.lit(0))), lambda f: _to_double(f)
        ).alias("features"),
        polygon_points(F.element_at("_p", -1), ";").alias("boundary"),
    ]


def _to_double(text):
    """A number in text form; ``-nan`` is a spelling the cast does not know."""
    t = F.trim(text)
    return F.when(F.lower(t) == "-nan", F.lit(float("nan"))).otherwise(t.try_cast("double"))


def read_segmentation(spark: SparkSession, root: str, pattern: str = "*/*.seg.*.txt",
                      with_magnification: bool = True, slide_from_folder: bool = False) -> DataFrame:
    """Every matching file below ``root``; the folder name can stand in for the slide name."""
    lines = spark.read.text(f"{root.rstrip('/')}/{pattern}").withColumn(
        "folder", slide_from_directory(F.col("_metadata.file_path"))
    )
    rows = parse_segmentation(lines, with_magnification=with_magnification, keep=("folder",))
    if slide_from_folder:
        rows = rows.withColumn("slide", F.col("folder"))
    return rows.drop("folder")
