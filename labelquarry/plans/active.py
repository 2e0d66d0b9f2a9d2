"""One labelling round, and scores kept between rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelquarry.operators.catalog import enrich_samples
from labelquarry.operators.labels import append_labels, latest_labels, training_rows
from labelquarry.operators.sampling import BATCH_SIZE, Strategy, unlabeled_pool
from labelquarry.operators.scoring import Model, Scorer
from labelquarry.operators.spatial import attach_boundaries
from labelquarry.session import shared_dir


@dataclass
class Round:
    labels: DataFrame
    training: DataFrame
    model: Model
    batch: DataFrame


def active_learning_step(
    objects: DataFrame, labels: DataFrame, submission: DataFrame, scorer: Scorer, strategy: Strategy,
    k: int = BATCH_SIZE, seed: int = 0, slides: DataFrame | None = None, boundaries: DataFrame | None = None,
    arrival: Sequence[str] = (),
) -> Round:
    """Add a submission, drop ignored rows, fit, score the pool and pick the next objects.

    ``labels`` and ``submission`` carry object_id, label and iteration. What arrived last counts:
    the submission after the labels, and inside each by the ``arrival`` columns. The iteration
    does not decide, since corrections by hand carry it negated; without arrival columns its size
    does. The pool is scored with a narrow projection; only the k picks meet the slide and boundary tables.
    """
    both = append_labels(labels.withColumn("_late", F.lit(0)), submission.withColumn("_late", F.lit(1)))
    order = ["_late", *arrival, "_age", "label"]
    history = latest_labels(both.withColumn("_age", F.abs("iteration")), ["object_id"], order).drop("_late", "_age")
    # The labelled set is small; its features come from the object table.
    chosen = training_rows(history).select("object_id", "label", "iteration")
    model = scorer.fit(chosen.join(objects, "object_id"))
    pool = unlabeled_pool(objects, history)
    batch = strategy.select(model.score(pool), k, seed)
    if slides is not None:
        batch = enrich_samples(batch, slides)
    if boundaries is not None:
        batch = attach_boundaries(batch, boundaries)
    return Round(history, chosen, model, batch)


def current_batch(spark: SparkSession, session: str, iteration: int, select) -> DataFrame:
    """The batch of an iteration: chosen once by ``select()``, stored, and read again when
    asked again before the labels arrive."""
    path = f"{shared_dir(spark).rstrip('/')}/batches/{session}/{iteration}"
    if not _exists(spark, path):
        select().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def stored_scores(spark: SparkSession, objects: DataFrame, model: Model, root: str, version: str) -> DataFrame:
    """Scores of all objects under a model version: computed on first use, then read."""
    path = f"{root.rstrip('/')}/model={version}"
    if not _exists(spark, path):
        scored = model.score(objects).select("object_id", "slide", "x", "y", "score")
        scored.hint("rebalance", "slide").write.mode("overwrite").partitionBy("slide").parquet(path)
    return spark.read.parquet(path)


def labels_version(labels: DataFrame, scorer: Scorer | None = None) -> str:
    """A short text that changes with the labels (order-independent) and, if given, with the scorer's kind and settings."""
    key = F.xxhash64("object_id", "label")
    # Equal rows cancel in the exclusive or, but not in the sum.
    row = labels.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(key).alias("h"), F.sum(F.pmod(key, F.lit(1 << 31))).alias("s")).first()
    version = f"{row['n']}-{(row['h'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}-{row['s'] or 0:x}"
    if scorer is None:
        return version
    settings = f"{type(scorer).__name__} {sorted(vars(scorer).items())}"
    return f"{version}-{hashlib.sha256(settings.encode()).hexdigest()[:16]}"


def _exists(spark: SparkSession, path: str) -> bool:
    """A finished write leaves a success marker."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(hadoop)
