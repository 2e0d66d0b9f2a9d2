"""Segmentation lines with the reason why they can't be used, and their split into good and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelquarry.operators.features import is_finite_vector
from labelquarry.sources.segmentation import _columns, _lead

# Looked at in this order; a row has the first that holds.
REASONS = ("fields", "slide", "coordinate", "magnification", "length", "feature", "vertex")


def _unusable(number: Column) -> Column:
    return number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))


def check_segmentation(lines: DataFrame, column: str = "value", with_magnification: bool = True, dims: int | None = None,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """Every line but headers as a row with ``reason``, null if it is good, and the ``line`` itself.

    ``fields``: too few of them; ``slide``: no name; ``coordinate``, ``magnification``: no finite number; ``length``: not
    ``dims`` features (if given); ``feature``: one that is no finite number; ``vertex``: none, or one that is not a pair of
    finite numbers. A header is a line without a digit in its second and third field that holds no spelling of nan or
    infinity either; null and blank lines are no rows.
    """
    lead = _lead(with_magnification)
    parts = lines.where(F.trim(F.col(column)) != "").select(*keep, F.col(column).alias("line"), F.split(F.col(column), "\t").alias("_p"))
    named = lambda i: ~F.coalesce(F.get("_p", i), F.lit("")).rlike(r"(?i)[0-9]|^\s*-?(nan|inf(inity)?)\s*$")
    rows = parts.where(~(named(1) & named(2) & (F.size("_p") > 2))).select(*keep, "line", "_p", *_columns(with_magnification))
    wrong = {
        "fields": F.size("_p") <= lead,
        "slide": F.coalesce(F.col("slide"), F.lit("")) == "",
        "coordinate": _unusable(F.col("x")) | _unusable(F.col("y")),
        "magnification": (_unusable(F.col("scan_mag")) | _unusable(F.col("analysis_mag"))) if with_magnification else F.lit(False),
        "length": (F.size("features") != dims) if dims is not None else F.lit(False),
        "feature": ~is_finite_vector(F.col("features")),
        "vertex": (F.size("boundary") == 0) | F.exists("boundary", lambda p: _unusable(p["x"]) | _unusable(p["y"])),
    }
    return rows.withColumn("reason", F.coalesce(*[F.when(wrong[r], F.lit(r)) for r in REASONS])).drop("_p")


def quarantine(checked: DataFrame, root: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Writes good and rejected rows apart, in one pass, and counts them.

    Returns the good rows, the rejected ones (``line`` and ``reason`` with what could be read) and the counts: ``rows``,
    ``good`` and one for each reason, which add up to ``rows``. ``root`` must not exist yet.
    """
    split = checked.withColumn("state", F.when(F.col("reason").isNull(), "good").otherwise("rejected"))
    split.write.partitionBy("state").parquet(root)
    table = checked.sparkSession.read.schema(split.schema).parquet(root)
    # Read back from one column: an Observation would leave a session in which Spark ML models can't be applied.
    counts = {r["reason"]: r["count"] for r in table.groupBy("reason").count().collect()}
    told = {"rows": sum(counts.values()), "good": counts.get(None, 0)} | {r: counts.get(r, 0) for r in REASONS}
    part = lambda state: table.where(F.col("state") == state).drop("state")
    return part("good").drop("reason", "line"), part("rejected"), told
