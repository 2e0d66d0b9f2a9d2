"""Writing object, label, catalog and report tables."""

from __future__ import annotations

import socket

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelquarry.functions.text import fixed_point, polygon_text


def save_objects(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by slide. The rebalance hint brings a slide's rows together and lets
    adaptive execution split a slide that is too large for one file."""
    df.hint("rebalance", "slide").write.mode(mode).partitionBy("slide").parquet(path)


def save_labeled(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A training or test set; these are small."""
    df.write.mode(mode).parquet(path)


def versioned_path(spark: SparkSession, path: str, tag: str) -> str:
    """``path``, or ``path_tag`` (first three characters of the tag) when it exists."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path}_{tag[:3]}" if files.exists(hadoop) else path


def save_without_clobbering(df: DataFrame, path: str, tag: str) -> str:
    target = versioned_path(df.sparkSession, path, tag)
    df.write.mode("errorifexists").parquet(target)
    return target


def record_run(spark: SparkSession, path: str, version: str, command: str) -> None:
    """Append host, version, time and command line to the table of runs."""
    spark.range(1).select(
        F.lit(socket.gethostname()).alias("host"), F.lit(version).alias("version"),
        F.date_format(F.current_timestamp(), "MM-dd-yyyy, HH:mm").alias("created"),
        F.lit(command).alias("command"),
    ).write.mode("append").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_log(spark: SparkSession, path: str, kind: str, message: str, address: str = "") -> None:
    spark.range(1).select(
        F.lit(address).alias("remote_addr"), F.lit(kind).alias("type"), F.lit(message).alias("message"),
        F.current_timestamp().alias("log_date"),
    ).write.mode("append").parquet(path)


def overwrite_slides(df: DataFrame, path: str) -> None:
    """Replace only the slides present in ``df`` in a table partitioned by slide."""
    df.hint("rebalance", "slide").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "slide"
    ).parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True) -> None:
    df.write.mode(mode).csv(path, header=header)


def segmentation_lines(df: DataFrame) -> DataFrame:
    """One tab separated line per object: slide, centroid, features and outline."""
    features = F.array_join(F.transform("features", lambda f: F.format_string("%f", f.cast("double"))), "\t")
    return df.select(
        F.concat_ws(
            "\t", F.col("slide"), fixed_point(F.col("x")), fixed_point(F.col("y")), features,
            polygon_text(F.col("boundary")),
        ).alias("value")
    )


def boundary_lines(df: DataFrame) -> DataFrame:
    """Import rows for the boundary table from parsed segmentation rows in analysis
    coordinates: slide name up to its first dot, centroid, ``x,y`` points with blanks between.

    Doubled coordinates keep one decimal, others lose theirs.
    """
    doubled = F.col("scan_mag") == 40.0
    point = lambda p: F.when(
        doubled, F.concat(fixed_point(p["x"]), F.lit(","), fixed_point(p["y"]))
    ).otherwise(F.concat(p["x"].cast("long").cast("string"), F.lit(","), p["y"].cast("long").cast("string")))
    return df.select(
        F.substring_index("slide", ".", 1).alias("slide"),
        fixed_point(F.col("x")).alias("centroid_x"), fixed_point(F.col("y")).alias("centroid_y"),
        F.array_join(F.transform("boundary", point), " ").alias("boundary"),
    )


def save_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).text(path)


def save_boundary_import(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t")
