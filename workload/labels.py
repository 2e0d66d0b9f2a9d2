"""Label histories, submissions, sessions and corrections."""

from pyspark.sql import functions as F

from labelquarry.operators import labels as lb
from labelquarry.operators import spatial as sp
from labelquarry.session import scratch_path
from labelquarry.streaming import labels as stream
from workload import tables as t
from workload.registry import query
from workload.tables import CLICKS, LABELED, OBJ, SUBMISSIONS, with_ctes

LATEST = """
latest AS (SELECT * FROM subs QUALIFY row_number() OVER (PARTITION BY uid, object_id ORDER BY ts DESC, submission_id DESC) = 1)"""


@query("latest_labels", with_ctes("SELECT uid, object_id, label, submission_id FROM latest", SUBMISSIONS, LATEST))
def latest_labels(spark, d):
    last = lb.latest_labels(t.submissions(spark, d), ["uid", "object_id"], ["ts", "submission_id"])
    return last.select("uid", "object_id", "label", "submission_id")


@query("dedup_first", with_ctes("""
SELECT uid, object_id, label, submission_id FROM subs
QUALIFY row_number() OVER (PARTITION BY uid, object_id ORDER BY ts, submission_id) = 1""", SUBMISSIONS))
def dedup_first(spark, d):
    first = lb.dedup_first(t.submissions(spark, d), ["uid", "object_id"], ["ts", "submission_id"])
    return first.select("uid", "object_id", "label", "submission_id")


@query("training_without_ignored", with_ctes("SELECT uid, object_id, label FROM latest WHERE label <> 0", SUBMISSIONS, LATEST))
def training_without_ignored(spark, d):
    last = lb.latest_labels(t.submissions(spark, d), ["uid", "object_id"], ["ts", "submission_id"])
    return lb.training_rows(last).select("uid", "object_id", "label")


@query("review_union", with_ctes("SELECT uid, object_id, label FROM latest", SUBMISSIONS, LATEST))
def review_union(spark, d):
    last = lb.latest_labels(t.submissions(spark, d), ["uid", "object_id"], ["ts", "submission_id"])
    return lb.review_union(lb.training_rows(last), lb.ignored_rows(last)).select("uid", "object_id", "label")


@query("append_labels", with_ctes("""
SELECT object_id, slide, label, iteration FROM labeled
UNION ALL SELECT CAST(object_id AS VARCHAR), uid, label, iteration FROM subs""", OBJ, LABELED, SUBMISSIONS))
def append_labels(spark, d):
    old = t.labeled(spark, d).select("object_id", "slide", "label", "iteration")
    new = t.submissions(spark, d).select(
        F.col("object_id").cast("string").alias("object_id"), F.col("uid").alias("slide"), "label", "iteration"
    )
    return lb.append_labels(old, new)


@query("apply_review", with_ctes("""
SELECT v.vec_id AS object_id, coalesce(c.label, CASE WHEN v.label < 5 THEN 1 ELSE -1 END) AS label, c.label IS NOT NULL AS updated
FROM embeddings v LEFT JOIN (SELECT object_id, label FROM subs
  QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY submission_id DESC) = 1) c ON c.object_id = v.vec_id""", SUBMISSIONS))
def apply_review(spark, d):
    labeled = t.read(spark, d, "embeddings").select(
        F.col("vec_id").alias("object_id"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("label")
    )
    changes = t.submissions(spark, d).select(
        F.col("object_id").cast("long").alias("object_id"), "label", F.col("submission_id").alias("seq")
    )
    return lb.apply_review(labeled, changes)


@query("last_iteration", with_ctes("SELECT max(iteration) AS last_iteration FROM labeled", OBJ, LABELED))
def last_iteration(spark, d):
    return lb.last_iteration(t.labeled(spark, d))


@query("picker_count", with_ctes("SELECT count(*) AS n FROM labeled", OBJ, LABELED))
def picker_count(spark, d):
    return t.labeled(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("restore_session", with_ctes("""
SELECT 'found' AS outcome, count(*) AS n FROM (SELECT DISTINCT slide, x, y, label FROM labeled) l JOIN obj o USING (slide, x, y)
UNION ALL
SELECT 'missing', count(*) FROM clicks c WHERE NOT EXISTS (SELECT 1 FROM obj o WHERE o.slide = c.slide AND o.x = c.x AND o.y = c.y)""",
    OBJ, LABELED, CLICKS))
def restore_session(spark, d):
    """Labelled positions against the dataset, and click positions that have no object."""
    data = t.objects(spark, d).select("object_id", "slide", "x", "y", "score")
    found, _ = lb.restore_session(t.labeled(spark, d).select("slide", "x", "y", "label").distinct(), data)
    _, missing = lb.restore_session(t.clicks(spark, d), data)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("outcome"), "n")
    return count(found, "found").unionByName(count(missing, "missing"))


@query("click_corrections", with_ctes("""
, hits AS (
  SELECT click_id, object_id, score FROM clicks c JOIN obj o ON o.slide = c.slide AND abs(o.x - c.x) <= 256 AND abs(o.y - c.y) <= 256
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY pow(o.x - c.x, 2) + pow(o.y - c.y, 2), object_id) = 1)
SELECT object_id, count(*) AS clicks, CASE WHEN max(score) >= 0 THEN -1 ELSE 1 END AS label
FROM hits GROUP BY object_id HAVING count(*) % 2 = 1""".strip(), OBJ, CLICKS))
def click_corrections(spark, d):
    data = t.objects(spark, d)
    hits = sp.nearest_object(t.clicks(spark, d), data, sp.REGION_RANGE).select("click_id", "object_id")
    predicted = F.when(F.col("score") >= 0, 1).otherwise(-1).alias("predicted")
    return lb.click_corrections(hits.join(data.select("object_id", predicted), "object_id")).select("object_id", "clicks", "label")


@query("priming_status", with_ctes("""
SELECT uid, positives, negatives, repeated, positives = 4 AND negatives = 4 AND repeated = 0 AS ready FROM (
  SELECT uid, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = -1) AS negatives,
         count(*) - count(DISTINCT (object_id, label)) AS repeated FROM subs GROUP BY uid)""", SUBMISSIONS))
def priming_status(spark, d):
    return lb.priming_status(t.submissions(spark, d))


@query("session_status", with_ctes("""
SELECT uid, count(*) AS requests, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts))) AS BIGINT) AS idle_seconds
FROM subs GROUP BY uid""", SUBMISSIONS))
def session_status(spark, d):
    return lb.session_status(t.submissions(spark, d), F.to_timestamp(F.lit("2024-02-01 00:00:00")))


@query("label_sessions", with_ctes("""
SELECT uid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS requests
FROM (SELECT *, sum(fresh) OVER (PARTITION BY uid ORDER BY ts, submission_id) AS session FROM (
        SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY uid ORDER BY ts, submission_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM subs))
GROUP BY uid, session""", SUBMISSIONS))
def label_sessions(spark, d):
    sessions = stream.label_sessions(t.submissions(spark, d))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return sessions.select("uid", shown("start"), shown("end"), "requests")


def _event_stream(spark, d):
    schema = t.read(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(d)
    kind = F.col("event_type")
    return source.select(
        F.col("user_id").cast("string").alias("uid"), F.col("event_id").alias("submission_id"), "ts",
        t.number_in_props().alias("object_id"),
        F.when(kind.isin("click", "purchase"), 1).when(kind.isin("view", "signup"), -1).otherwise(0).alias("label"),
        (t.number_in_props() % 5 - 1).alias("iteration"),
    )


@query("accepted_submissions", """
WITH RECURSIVE""" + with_ctes("""
, walk AS (
  SELECT uid, n, submission_id, iteration, iteration IN (-1, 0) AS accepted,
         CASE WHEN iteration = -1 THEN 0 ELSE iteration END AS recorded, CASE WHEN iteration = 0 THEN 1 ELSE 0 END AS cur
  FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.uid, o.n, o.submission_id, o.iteration, o.iteration = -1 OR o.iteration = w.cur,
         CASE WHEN o.iteration = -1 THEN -w.cur ELSE o.iteration END, CASE WHEN o.iteration = w.cur THEN w.cur + 1 ELSE w.cur END
  FROM walk w JOIN ordered o ON o.uid = w.uid AND o.n = w.n + 1)
SELECT uid, submission_id, iteration, recorded, accepted FROM walk""".strip(), SUBMISSIONS, """
ordered AS (SELECT uid, submission_id, iteration, row_number() OVER (PARTITION BY uid ORDER BY ts, submission_id) AS n FROM subs)""").removeprefix("WITH"))
def accepted_submissions(spark, d):
    """The submission gate over the event stream, run to the end and read back."""
    return _gated(spark, d, None)


@query("session_submissions", """
WITH RECURSIVE""" + with_ctes("""
, walk AS (
  SELECT uid, n, submission_id, iteration, iteration IN (-1, 0) AS accepted,
         CASE WHEN iteration = -1 THEN 0 ELSE iteration END AS recorded, CASE WHEN iteration = 0 THEN 1 ELSE 0 END AS cur
  FROM ordered WHERE n = 1
  UNION ALL
  SELECT uid, n, submission_id, iteration, iteration = -1 OR iteration = here, CASE WHEN iteration = -1 THEN -here ELSE iteration END,
         CASE WHEN iteration = here THEN here + 1 ELSE here END
  FROM (SELECT o.*, CASE WHEN o.fresh THEN 0 ELSE w.cur END AS here FROM walk w JOIN ordered o ON o.uid = w.uid AND o.n = w.n + 1))
SELECT uid, submission_id, iteration, recorded, accepted FROM walk""".strip(), SUBMISSIONS, """
ordered AS (
  SELECT uid, submission_id, iteration, row_number() OVER w AS n, epoch_ms(ts) - lag(epoch_ms(ts)) OVER w > 30 * 60000 AS fresh
  FROM subs WINDOW w AS (PARTITION BY uid ORDER BY ts, submission_id))""").removeprefix("WITH"))
def session_submissions(spark, d):
    """The gate with sessions that end after 30 idle minutes: the next submission meets iteration 0."""
    return _gated(spark, d, 30)


def _gated(spark, d, idle_minutes):
    root, setting = scratch_path(spark, "submissions"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        decided = stream.gate_submissions(_event_stream(spark, d), idle_minutes)
        decided.writeStream.format("parquet").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/checkpoint"
        ).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{root}/out")


@query("streamed_latest_labels", with_ctes("SELECT uid, object_id, label, submission_id FROM latest", SUBMISSIONS, LATEST))
def streamed_latest_labels(spark, d):
    """The label table kept by a stream, read back."""
    root = scratch_path(spark, "labels")
    table = stream.LabelTable(f"{root}/table", ["uid", "object_id"], ["ts", "submission_id"])
    table.start(_event_stream(spark, d), f"{root}/checkpoint").awaitTermination()
    return table.read(spark).select("uid", "object_id", "label", "submission_id")


@query("active_learning_step", with_ctes("""
SELECT object_id, slide, round(score, 6) AS score FROM (
  SELECT vec.object_id, slide, score FROM vec
  WHERE object_id NOT IN (SELECT object_id FROM latest WHERE object_id IS NOT NULL)
  ORDER BY abs(score), object_id LIMIT 8)""", t.VEC, SUBMISSIONS, LATEST))
def active_learning_step(spark, d):
    """Linear scorer; labels come from the submissions, in two halves."""
    result = _round(spark, d)
    return result.batch.select("object_id", "slide", F.round("score", 6).alias("score"))


@query("active_training_labels", with_ctes("""
SELECT CAST(object_id AS BIGINT) AS object_id, label, iteration, label <> 0 AS trains FROM (
  SELECT * FROM subs QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY label = 0 DESC, ts DESC, submission_id DESC) = 1)""", SUBMISSIONS))
def active_training_labels(spark, d):
    """The labels after the round, and which of them train. The submission is the ignored half, so it wins wherever it names an object."""
    result = _round(spark, d)
    trains = result.training.select(F.col("object_id").alias("_id"), F.lit(True).alias("_t"))
    return result.labels.join(trains, F.col("object_id").eqNullSafe(F.col("_id")), "left").select(
        "object_id", "label", "iteration", F.coalesce("_t", F.lit(False)).alias("trains")
    )


def _round(spark, d):
    from labelquarry.operators.sampling import UncertaintyStrategy
    from labelquarry.operators.scoring import LinearScorer
    from labelquarry.plans.active import active_learning_step as step

    sent = t.submissions(spark, d).select(F.col("object_id").cast("long").alias("object_id"), "label", "iteration", "ts", "submission_id")
    return step(
        t.vectors(spark, d).select("object_id", "slide", "x", "y", "features"), sent.where("label <> 0"), sent.where("label = 0"),
        LinearScorer(t.WEIGHTS), UncertaintyStrategy(), arrival=["ts", "submission_id"],
    )


@query("current_batch", with_ctes("""
SELECT object_id, slide, score, label_count FROM (
  SELECT object_id, slide, score FROM obj WHERE label IS NULL ORDER BY abs(score), object_id LIMIT 8),
  (SELECT count(*) AS label_count FROM labeled)""", OBJ, LABELED))
def current_batch(spark, d):
    """The batch of an iteration asked for twice; the second request reads the stored one."""
    import uuid

    from labelquarry.operators.sampling import uncertain, unlabeled_pool
    from labelquarry.plans.active import current_batch as batch

    session = uuid.uuid4().hex
    choose = lambda: uncertain(unlabeled_pool(t.objects(spark, d), t.labeled(spark, d)))
    batch(spark, session, 0, choose)
    again = batch(spark, session, 0, choose).select("object_id", "slide", "score")
    return again.withColumn("label_count", t.labeled(spark, d).agg(F.count(F.lit(1))).scalar())
