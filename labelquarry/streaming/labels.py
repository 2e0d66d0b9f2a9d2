"""Label submissions, sessions and logs as streams."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from labelquarry.operators.labels import latest_labels
from labelquarry.session import children, complete_versions, remove_tree

# Minutes without a request after which a session ends; the iteration sent with
# hand-picked corrections.
SESSION_GAP = "30 minutes"
FIX_ITERATION = -1

ACCEPTED_SCHEMA = "uid string, submission_id long, iteration int, recorded int, accepted boolean"


def label_sessions(requests: DataFrame, gap: str = SESSION_GAP, watermark: str | None = None) -> DataFrame:
    """Sessions of each uid, split where nothing arrives for longer than the gap.

    On a stream (with a watermark) a session comes out when it is finished, which is when it is
    saved and evicted. On a table, sessions are formed per uid and day first and then joined
    across midnight, so a uid with very many requests is spread over its days.
    """
    timed = requests.withWatermark("ts", watermark) if watermark else requests
    days = [] if requests.isStreaming else [F.to_date("ts").alias("_day")]
    parts = timed.groupBy("uid", *days, F.session_window("ts", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("requests")
    ).select("uid", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "requests")
    if requests.isStreaming:
        return parts
    # A handful of parts per uid and day are left.
    in_order = Window.partitionBy("uid").orderBy("start", "end")
    fresh = F.coalesce(F.col("start") > F.lag("end").over(in_order), F.lit(True)).cast("int")
    return (
        parts.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(in_order))
        .groupBy("uid", "_session")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("requests").alias("requests"))
        .drop("_session")
    )


class SubmissionGate(StatefulProcessor):
    """Keeps the current iteration of each session. A submission for another iteration is
    refused; a hand-picked correction is recorded under the negated current iteration.

    With ``idle`` (microseconds) a session ends that long after its last submission: the next one meets iteration 0,
    and a timer at the end removes the state, so the store holds sessions that go on and no others.
    """

    def __init__(self, idle: int | None = None, rows_out: int = 10_000):
        self.idle, self.rows_out = idle, rows_out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "current int, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        current, last = self.session.get() if self.session.exists() else (0, None)
        last_before = last
        for ids, iterations, times in _in_order(rows, self.rows_out):
            recorded, accepted = [], []
            for iteration, now in zip(iterations.tolist(), times.tolist(), strict=True):
                if self.idle is not None and last is not None and now - last > self.idle:
                    current = 0
                last = now if last is None else max(last, now)
                fix = iteration == FIX_ITERATION
                ok = fix or iteration == current
                recorded.append(-current if fix else iteration)
                accepted.append(ok)
                current += ok and not fix
            yield pd.DataFrame({"uid": key[0], "submission_id": ids, "iteration": iterations, "recorded": recorded, "accepted": accepted})
        self.session.update((int(current), last))
        if self.idle is not None:
            if last_before is not None:
                self.handle.deleteTimer(self._over_at(last_before))
            self.handle.registerTimer(self._over_at(last))

    def _over_at(self, last: int) -> int:
        return (last + self.idle) // 1000 + 1  # timers count in milliseconds

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.session.clear()
        return iter([])

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The submissions of one session in a micro-batch by time and id, in runs of ``size``.

    Only three numbers of a submission are kept while the rest arrive; a source that is read with
    ``maxFilesPerTrigger`` bounds how many there are.
    """
    columns = array("q"), array("q"), array("q")
    for part in rows:
        for column, name in zip(columns, ("submission_id", "iteration", "micros"), strict=True):
            column.frombytes(part[name].to_numpy("int64").tobytes())
    ids, iterations, times = (np.frombuffer(c, "int64") for c in columns)
    order = np.lexsort((ids, times))
    for at in range(0, len(order), size):
        run = order[at : at + size]
        yield ids[run], iterations[run], times[run]


def gate_submissions(submissions: DataFrame, idle_minutes: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Streaming: every submission with the decision on it. Expects uid, submission_id, ts,
    iteration. The state store provider must be RocksDB.

    With ``idle_minutes`` sessions end by event time. The watermark then lies ``late`` behind the latest submission
    seen, and what arrives behind the watermark is dropped by the stream.
    """
    when = F.col("ts").cast("timestamp")
    timed = submissions.withColumns({"ts": when, "micros": F.unix_micros(when)})
    if idle_minutes is not None:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy("uid").transformWithStateInPandas(
        statefulProcessor=SubmissionGate(None if idle_minutes is None else idle_minutes * 60_000_000),
        outputStructType=ACCEPTED_SCHEMA, outputMode="append", timeMode="none" if idle_minutes is None else "eventTime",
    )


def merge_labels(state: DataFrame | None, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    both = batch if state is None else state.unionByName(batch)
    return latest_labels(both, key, order)


class LabelTable:
    """The latest label per object, kept by ``foreachBatch`` in hash buckets of the key.

    A micro-batch rewrites only the buckets that its keys fall into, as ``data/v=<batch>/key_bucket=<b>``, and then
    writes a manifest of which version holds each bucket. A version counts once its manifest is complete: a batch that
    failed before shows nothing, and one that is replayed starts from the manifest before it and writes the same again.
    The last ``keep`` versions can be read; buckets that none of them names are removed.

    The number of buckets is fixed when the table is made; a bucket should fit a few tasks, since a batch reads and writes
    it whole.
    """

    BUCKET = "key_bucket"

    def __init__(self, root: str, key: list[str], order: list[str], buckets: int = 64, keep: int = 2):
        if keep < 2:
            raise ValueError("a replayed batch needs the version before it")
        self.root, self.key, self.order, self.buckets, self.keep = root.rstrip("/"), key, order, buckets, keep

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.root}/data/v={version}/{self.BUCKET}={bucket}"

    def versions(self, spark: SparkSession) -> list[int]:
        return complete_versions(spark, f"{self.root}/manifests")

    def _manifest(self, spark: SparkSession, version: int) -> dict[int, int]:
        rows = spark.read.schema("bucket int, version long, buckets int").parquet(f"{self.root}/manifests/v={version}").collect()
        if any(r["buckets"] != self.buckets for r in rows):
            raise ValueError(f"the table has {rows[0]['buckets']} buckets, not {self.buckets}")
        return {r["bucket"]: r["version"] for r in rows}

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        older = [v for v in self.versions(spark) if v < batch_id]
        held = self._manifest(spark, older[-1]) if older else {}
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(self.BUCKET)
        if not older:
            batch.limit(0).write.mode("overwrite").parquet(f"{self.root}/empty")
        batch.persist()
        try:
            touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most as many numbers as buckets
            paths = [self._folder(b, held[b]) for b in sorted(touched) if b in held]
            state = spark.read.parquet(*paths) if paths else None
            if touched:
                merged = merge_labels(state, batch, self.key, self.order)
                merged.select("*", bucket).hint("rebalance", self.BUCKET).write.mode("overwrite").partitionBy(self.BUCKET).parquet(f"{self.root}/data/v={batch_id}")
        finally:
            batch.unpersist()
        now = held | dict.fromkeys(touched, batch_id)
        manifest = spark.createDataFrame([(b, v, self.buckets) for b, v in sorted(now.items())], "bucket int, version long, buckets int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/v={batch_id}")
        self._compact(spark)

    def _compact(self, spark: SparkSession) -> None:
        """Removes manifests but the last ones, and buckets that those don't name."""
        kept = self.versions(spark)[-self.keep :]
        named = {pair for v in kept for pair in self._manifest(spark, v).items()}
        for name in children(spark, f"{self.root}/manifests"):
            if int(name.removeprefix("v=")) < kept[0]:
                remove_tree(spark, f"{self.root}/manifests/{name}")
        for name in children(spark, f"{self.root}/data"):
            version = int(name.removeprefix("v="))
            folders = [n for n in children(spark, f"{self.root}/data/{name}") if n.startswith(self.BUCKET)]
            gone = [n for n in folders if (int(n.partition("=")[2]), version) not in named]
            if version < kept[0] and len(gone) == len(folders):
                remove_tree(spark, f"{self.root}/data/{name}")
            else:
                for n in gone:
                    remove_tree(spark, f"{self.root}/data/{name}/{n}")

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The labels as of a batch (by default the last)."""
        manifest = self._manifest(spark, self.versions(spark)[-1] if version is None else version)
        return spark.read.parquet(*([self._folder(b, v) for b, v in sorted(manifest.items())] or [f"{self.root}/empty"]))

    def start(self, labels: DataFrame, checkpoint: str):
        return labels.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(
            availableNow=True
        ).start()


def write_log(messages: DataFrame, path: str, checkpoint: str):
    """Append a stream of request and error messages to a table."""
    return messages.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    ).outputMode("append").trigger(availableNow=True).start()
