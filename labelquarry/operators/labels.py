"""The labelled set: adding, changing, ignoring and reviewing labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: samples of each class a first round needs.
PRIME_PER_CLASS = 4


def append_labels(labeled: DataFrame, new: DataFrame) -> DataFrame:
    return labeled.unionByName(new, allowMissingColumns=True)


def latest_labels(history: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last label of each key. The rank filter runs before the shuffle as well, so a key
    with many changes sends one row per task."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return history.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def training_rows(labels: DataFrame) -> DataFrame:
    """Rows that take part in training."""
    return labels.where(F.col("label") != 0)


def ignored_rows(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("label") == 0)


def apply_review(labeled: DataFrame, changes: DataFrame, key: str = "object_id") -> DataFrame:
    """Labelled and ignored rows with reviewed labels; ``changes`` holds (key, label, seq) and
    the last change of an object counts. Column ``updated`` marks the rows that were named."""
    last = latest_labels(changes, [key], ["seq"]).select(key, F.col("label").alias("_new"))
    return labeled.join(last, key, "left").withColumns({
        "label": F.coalesce("_new", "label"), "updated": F.col("_new").isNotNull(),
    }).drop("_new")


def review_union(training: DataFrame, ignored: DataFrame) -> DataFrame:
    return training.unionByName(ignored, allowMissingColumns=True)


def last_iteration(labeled: DataFrame) -> DataFrame:
    return labeled.agg(F.max("iteration").alias("last_iteration"))


def restore_session(labeled: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled rows with the features of their object by (slide, x, y), and the rows whose
    object the dataset lacks (which should be none)."""
    keys = ["slide", "x", "y"]
    have = labeled.drop("features", "object_id")
    found = have.join(objects, keys)
    missing = have.join(objects.select(*keys), keys, "left_anti")
    return found, missing


def click_corrections(clicked: DataFrame, key: str = "object_id") -> DataFrame:
    """Objects to correct: clicked an odd number of times, they get the opposite of their
    predicted class. Expects one row per click with ``predicted``."""
    return (
        clicked.groupBy(key).agg(F.count(F.lit(1)).alias("clicks"), F.max("predicted").alias("predicted"))
        .where(F.col("clicks") % 2 == 1)
        .withColumn("label", -F.col("predicted"))
    )


def priming_status(samples: DataFrame, key: str = "object_id") -> DataFrame:
    """Per session the distinct samples of each class and whether priming is complete: four of
    each, none twice."""
    per_object = samples.groupBy("uid", key, "label").agg(F.count(F.lit(1)).alias("_times"))
    label, times = F.col("label"), F.col("_times")
    return per_object.groupBy("uid").agg(
        F.sum(F.when(label == 1, times).otherwise(0)).alias("positives"),
        F.sum(F.when(label == -1, times).otherwise(0)).alias("negatives"),
        (F.sum(times) - F.count(F.lit(1))).alias("repeated"),
    ).withColumn(
        "ready",
        (F.col("positives") == PRIME_PER_CLASS) & (F.col("negatives") == PRIME_PER_CLASS) & (F.col("repeated") == 0),
    )


def session_status(events: DataFrame, now) -> DataFrame:
    """Per session: number of requests and whole seconds since the last one."""
    return events.groupBy("uid").agg(
        F.count(F.lit(1)).alias("requests"), F.max("ts").alias("last_seen")
    ).withColumn("idle_seconds", F.unix_timestamp(now) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))).drop("last_seen")


def pending_work(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output."""
    return inputs.select(key).distinct().join(outputs.select(key), key, "left_anti")
