"""Reading object, label, catalog and study tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry import schemas
from labelquarry.functions.numbers import bind
from labelquarry.functions.text import clean_header


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, cast; columns the table lacks become typed nulls."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def load_objects(spark: SparkSession, path: str) -> DataFrame:
    """The object table; Parquet partitioned by slide prunes on ``slide``."""
    df = spark.read.parquet(path)
    missing = {"slide", "x", "y", "features"} - set(df.columns)
    if missing:
        raise ValueError(f"object table lacks {sorted(missing)}")
    return with_schema(df, schemas.OBJECTS)


def load_labeled(spark: SparkSession, path: str) -> DataFrame:
    """A training or test set; optional columns (iteration, click position) may be absent."""
    return with_schema(spark.read.parquet(path), schemas.LABELED)


def load_norm_params(spark: SparkSession, path: str) -> DataFrame:
    return with_schema(spark.read.parquet(path), schemas.NORM_PARAMS)


def load_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Tab separated slide, centroid and polygon text."""
    return spark.read.csv(path, sep="\t", schema=schemas.BOUNDARIES, ignoreLeadingWhiteSpace=True,
                          ignoreTrailingWhiteSpace=True)


def load_slides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schemas.SLIDES)


def load_regions_of_interest(spark: SparkSession, path: str) -> DataFrame:
    """Exactly five columns per row; any other row fails the read."""
    return spark.read.csv(path, schema=schemas.ROI, mode="FAILFAST", enforceSchema=True)


def load_slide_list(spark: SparkSession, path: str) -> DataFrame:
    """Slide names: the first column of a CSV, deduplicated."""
    return spark.read.csv(path).select(F.trim("_c0").alias("name")).where("name <> ''").distinct()


def load_slide_percentages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schemas.SLIDE_PERCENT)


def load_clinical(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV with every column read as a number; text that is none becomes null."""
    raw = spark.read.csv(path, header=True)
    names = [clean_header(c) for c in raw.columns]
    renamed = raw.toDF(*names)
    return renamed.select(*[F.trim(F.regexp_replace(F.col(c), "\r", "")).try_cast("double").alias(c) for c in names])


def load_catalog(spark: SparkSession, table: str, jdbc_url: str | None = None, path: str | None = None,
                 **options: str) -> DataFrame:
    """A catalog table, from a database or from Parquet."""
    if jdbc_url:
        return spark.read.format("jdbc").options(url=jdbc_url, dbtable=table, **options).load()
    return spark.read.parquet(f"{path.rstrip('/')}/{table}")


def lookup(catalog: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Catalog rows whose name is asked for (the filter side holds the names)."""
    return catalog.join(names.select(key).distinct(), key, "left_semi")


def json_columns_to_rows(df: DataFrame, payload: str, keys: list[str], by: list[str]) -> DataFrame:
    """Column-wise JSON ``[{key, value: [...]}, ...]`` to one row per array position.

    The columns of one payload meet in its own row, so no shuffle is needed.
    """
    def values(columns: Column, key: str) -> Column:
        return F.get(F.filter(columns, lambda c: c["key"] == key), F.lit(0))["value"].alias(key)

    parsed = F.from_json(F.col(payload), schemas.COLUMN_PAYLOAD)
    rows = bind(parsed, lambda columns: F.arrays_zip(*[values(columns, k) for k in keys]))
    return (
        df.select(*by, F.posexplode(rows))
        .select(*by, F.col("pos"), *[F.col(f"col.{k}").alias(k) for k in keys])
    )


def decode_label_batch(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """JSON label samples to rows; whole-number coordinates and numeric slide names are coerced."""
    return df.select(*keep, F.inline(F.from_json(F.col(payload), schemas.LABEL_SAMPLES)))


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()
