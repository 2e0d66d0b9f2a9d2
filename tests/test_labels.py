import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelquarry.operators import labels as lb
from labelquarry.operators.sampling import BinStrategy, RandomStrategy, SubsampleStrategy, UncertaintyStrategy
from labelquarry.operators.scoring import LinearScorer
from labelquarry.plans import active
from labelquarry.sources.tables import decode_label_batch, json_columns_to_rows
from labelquarry.streaming import labels as stream


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 8, 0) + dt.timedelta(minutes=minute, seconds=second)


@pytest.fixture(scope="module")
def requests(spark):
    rows = [("a", 1, at(0), 0), ("a", 2, at(1), 0), ("a", 3, at(2), -1), ("a", 4, at(3), 1), ("a", 5, at(40), 1), ("b", 6, at(5), 1), ("b", 7, at(6), 0)]
    return spark.createDataFrame(rows, "uid string, submission_id long, ts timestamp, iteration int")


def test_latest_label_wins(spark):
    rows = [(1, 1, 1), (1, 0, 2), (1, -1, 3), (2, 0, 1)]
    history = spark.createDataFrame(rows, "object_id int, label int, seq int")
    last = lb.latest_labels(history, ["object_id"], ["seq"])
    assert {r["object_id"]: r["label"] for r in last.collect()} == {1: -1, 2: 0}
    assert [r["object_id"] for r in lb.training_rows(last).collect()] == [1]
    assert [r["object_id"] for r in lb.ignored_rows(last).collect()] == [2]
    first = lb.dedup_first(history, ["object_id"], ["seq"])
    assert {r["object_id"]: r["label"] for r in first.collect()} == {1: 1, 2: 0}


def test_review_changes(spark):
    labeled = spark.createDataFrame([(1, 1), (2, 0), (3, -1)], "object_id int, label int")
    changes = spark.createDataFrame([(2, 1, 1), (2, -1, 2), (9, 1, 1)], "object_id int, label int, seq int")
    got = {r["object_id"]: (r["label"], r["updated"]) for r in lb.apply_review(labeled, changes).collect()}
    assert got == {1: (1, False), 2: (-1, True), 3: (-1, False)}


def test_restore_reports_missing(spark):
    objects = spark.createDataFrame([(7, "A", 1.0, 2.0, [0.5])], "object_id int, slide string, x double, y double, features array<double>")
    labeled = spark.createDataFrame([("A", 1.0, 2.0, 1), ("A", 3.0, 2.0, -1)], "slide string, x double, y double, label int")
    found, missing = lb.restore_session(labeled, objects)
    assert [(r["object_id"], r["label"]) for r in found.collect()] == [(7, 1)]
    assert [r["x"] for r in missing.collect()] == [3.0]


def test_second_click_cancels(spark):
    clicked = spark.createDataFrame([(1, 1), (1, 1), (2, -1), (3, 1), (3, 1), (3, 1)], "object_id int, predicted int")
    assert {r["object_id"]: r["label"] for r in lb.click_corrections(clicked).collect()} == {2: 1, 3: -1}


def test_priming(spark):
    good = [("a", i, 1 if i < 4 else -1) for i in range(8)]
    twice = [("b", i, 1 if i < 4 else -1) for i in range(7)] + [("b", 6, -1)]
    got = {r["uid"]: r["ready"] for r in lb.priming_status(spark.createDataFrame(good + twice, "uid string, object_id int, label int")).collect()}
    assert got == {"a": True, "b": False}


def test_sessions_split_at_the_gap(requests):
    rows = stream.label_sessions(requests).orderBy("uid", "start").collect()
    assert [(r["uid"], r["requests"]) for r in rows] == [("a", 4), ("a", 1), ("b", 2)]


def test_sessions_join_across_midnight(spark):
    rows = [("a", 23, 50), ("a", 24, 10), ("a", 24, 40), ("a", 25, 11), ("b", 23, 59), ("b", 24, 30)]
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(u, day + dt.timedelta(hours=h, minutes=m)) for u, h, m in rows], "uid string, ts timestamp")
    got = [(r["uid"], r["start"].hour, r["start"].minute, r["requests"]) for r in stream.label_sessions(df).orderBy("uid", "start").collect()]
    # Exactly the gap apart still belongs together; 31 minutes do not.
    assert got == [("a", 23, 50, 3), ("a", 1, 11, 1), ("b", 23, 59, 1), ("b", 0, 30, 1)]


def test_streamed_sessions_match_the_table(spark, requests, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    # A late last row moves the watermark past every session.
    closing = spark.createDataFrame([("z", 99, at(500), 0)], requests.schema)
    requests.coalesce(1).write.parquet(src)
    source = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sessions = stream.label_sessions(source, watermark="1 minute")
    run = lambda: sessions.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    closing.coalesce(1).write.mode("append").parquet(src)
    run()
    got = sorted((r["uid"], r["requests"]) for r in spark.read.parquet(out).collect())
    want = sorted((r["uid"], r["requests"]) for r in stream.label_sessions(requests).collect())
    assert got == want


def test_gate_keeps_its_counter_between_batches(spark, requests, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("submission_id <= 3 OR submission_id = 6", "submission_id > 3 AND submission_id <> 6"):
        requests.where(part).coalesce(1).write.mode("append").parquet(src)
        source = spark.readStream.schema(requests.schema).parquet(src)
        stream.gate_submissions(source).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r["submission_id"]: (r["accepted"], r["recorded"]) for r in spark.read.parquet(out).collect()}
    # a: 0 accepted, 0 again refused, a fix recorded as -1, 1 accepted, 1 again refused.
    assert got == {1: (True, 0), 2: (False, 0), 3: (True, -1), 4: (True, 1), 5: (False, 1), 6: (False, 1), 7: (True, 0)}


def test_label_table_over_batches(spark, tmp_path):
    schema = "object_id int, label int, seq int"
    src = str(tmp_path / "in")
    table = stream.LabelTable(str(tmp_path / "table"), ["object_id"], ["seq"])
    for rows in ([(1, 1, 1), (2, 1, 2)], [(1, 0, 3), (3, -1, 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        table.start(spark.readStream.schema(schema).parquet(src), str(tmp_path / "cp")).awaitTermination()
    assert {r["object_id"]: r["label"] for r in table.read(spark, 1).collect()} == {1: 0, 2: 1, 3: -1}


def folders(path):
    return sorted(str(p.relative_to(path)) for p in path.glob("data/v=*/key_bucket=*"))


def test_a_label_rewrites_one_bucket(spark, tmp_path):
    schema = "object_id int, label int, seq int"
    table = stream.LabelTable(str(tmp_path / "t"), ["object_id"], ["seq"], buckets=8)
    first = [(i, 1, i) for i in range(100)]
    table.upsert(spark.createDataFrame(first, schema), 0)
    assert len(folders(tmp_path / "t")) == 8
    table.upsert(spark.createDataFrame([(7, -1, 200), (7, 0, 150)], schema), 1)
    assert [f for f in folders(tmp_path / "t") if "v=1/" in f] == [f for f in folders(tmp_path / "t")][8:] and len(folders(tmp_path / "t")) == 9
    want = {i: 1 for i in range(100)} | {7: -1}
    labels = lambda **k: {r["object_id"]: r["label"] for r in table.read(spark, **k).collect()}
    assert labels() == want and labels(version=0) == dict.fromkeys(range(100), 1)
    # A replay of the last batch changes nothing; an empty batch is a version too.
    table.upsert(spark.createDataFrame([(7, -1, 200), (7, 0, 150)], schema), 1)
    table.upsert(spark.createDataFrame([], schema), 2)
    assert labels() == want and table.versions(spark) == [1, 2]
    # Only what the last two versions name is left: eight buckets.
    assert len(folders(tmp_path / "t")) == 8


def test_a_batch_that_fails_shows_nothing(spark, tmp_path):
    schema = "object_id int, label int, seq int"
    table = stream.LabelTable(str(tmp_path / "t"), ["object_id"], ["seq"], buckets=4)
    table.upsert(spark.createDataFrame([(1, 1, 1)], schema), 0)
    bad = spark.createDataFrame([(1, -1, 2)], schema).withColumn("label", F.when(F.col("seq") == 2, F.raise_error(F.lit("lost"))).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad, 1)
    assert table.versions(spark) == [0] and table.read(spark).first()["label"] == 1
    with pytest.raises(ValueError, match="buckets"):
        stream.LabelTable(str(tmp_path / "t"), ["object_id"], ["seq"], buckets=5).read(spark)


def test_buckets_equal_the_table(spark, tmp_path):
    rng = random.Random(4)
    schema = "object_id int, label int, seq int"
    table, sent = stream.LabelTable(str(tmp_path / "t"), ["object_id"], ["seq"], buckets=5), []
    for batch in range(4):
        rows = [(rng.choice([None, *range(40)]), rng.choice([-1, 0, 1]), 100 * batch + i) for i in range(30)]
        sent += rows
        table.upsert(spark.createDataFrame(rows, schema), batch)
    want = lb.latest_labels(spark.createDataFrame(sent, schema), ["object_id"], ["seq"])
    assert sorted(map(tuple, table.read(spark).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_idle_sessions_start_again(spark, tmp_path):
    rows = [("a", 1, at(0), 0), ("a", 2, at(29), 1), ("a", 3, at(70), 0), ("a", 4, at(71), 2), ("b", 5, at(5), 0)]
    later = [("a", 6, at(80), 1), ("b", 7, at(90), 1), ("b", 8, at(91), 0), ("z", 9, at(1000), 0)]
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "uid string, submission_id long, ts timestamp, iteration int"
    for part in (rows, later, [("z", 10, at(2000), 0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        running = stream.gate_submissions(source, idle_minutes=30).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        running.awaitTermination()
    got = {r["submission_id"]: (r["accepted"], r["recorded"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        1: (True, 0), 2: (True, 1), 3: (True, 0), 4: (False, 2), 6: (True, 1), 5: (True, 0), 7: (False, 1), 8: (True, 0), 9: (True, 0), 10: (True, 0)}
    # Sessions a and b are over, and z's first one: what is left is one session.
    assert running.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_many_submissions_are_folded_in_order():
    parts = [pd.DataFrame({"micros": [3, 1], "submission_id": [7, 8], "iteration": [0, 1]}),
             pd.DataFrame({"micros": [1, 2], "submission_id": [5, 6], "iteration": [2, 3]})]
    runs = list(stream._in_order(iter(parts), 3))
    assert [r[0].tolist() for r in runs] == [[5, 8, 6], [7]] and runs[0][2].tolist() == [1, 1, 2]


def test_log_stream(spark, tmp_path):
    spark.createDataFrame([("INFO", "x")], "type string, message string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("type string, message string").parquet(str(tmp_path / "in"))
    stream.write_log(source, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_decoding_coerces_numbers_and_names(spark):
    text = '[{"id": 3, "slide": 12, "centX": 5, "centY": 6.5, "label": -1}, {"id": 4, "slide": "S", "centX": 1.0, "centY": 2, "label": 0, "clickX": 7}]'
    rows = decode_label_batch(spark.createDataFrame([("u", text)], "uid string, p string"), "p", ["uid"]).orderBy("id").collect()
    assert [(r["slide"], r["centX"], r["centY"], r["label"], r["clickX"]) for r in rows] == [("12", 5.0, 6.5, -1, None), ("S", 1.0, 2.0, 0, 7.0)]


def test_column_payload(spark):
    text = '[{"key": "time", "value": [1, 2]}, {"key": "event", "value": [0, 1]}]'
    rows = json_columns_to_rows(spark.createDataFrame([(1, text)], "id int, p string"), "p", ["time", "event"], ["id"]).orderBy("pos").collect()
    assert [(r["time"], r["event"]) for r in rows] == [(1.0, 0.0), (2.0, 1.0)]


@pytest.fixture(scope="module")
def objects(spark):
    rows = [(i, "A", float(i), 0.0, [(i - 50) / 50.0]) for i in range(101)]
    return spark.createDataFrame(rows, "object_id long, slide string, x double, y double, features array<double>")


@pytest.mark.parametrize("strategy", [UncertaintyStrategy(), UncertaintyStrategy(True), RandomStrategy(), SubsampleStrategy(0.5), BinStrategy()])
def test_a_round_never_picks_labelled_objects(spark, objects, strategy):
    labels = spark.createDataFrame([(50, 1, 0), (51, -1, 0)], "object_id long, label int, iteration int")
    sent = spark.createDataFrame([(49, 0, 1), (50, -1, 1)], "object_id long, label int, iteration int")
    slides = spark.createDataFrame([("A", 100, 90, "p", 1)], "name string, x_size int, y_size int, pyramid_path string, scale int")
    result = active.active_learning_step(objects, labels, sent, LinearScorer([1.0]), strategy, slides=slides)
    batch = result.batch.collect()
    assert len(batch) == 8 and not {49, 50, 51} & {r["object_id"] for r in batch}
    assert {r["object_id"]: r["label"] for r in result.labels.collect()} == {49: 0, 50: -1, 51: -1}
    assert all(r["max_x"] == 100 for r in batch)


def test_the_last_arrival_counts_whatever_its_iteration(spark, objects):
    labels = spark.createDataFrame([(1, -1, 2, 0), (2, -1, 2, 0), (3, 0, 2, 0)], "object_id long, label int, iteration int, seq int")
    sent = spark.createDataFrame(
        [(1, 1, -3, 2), (2, 0, -3, 1), (3, -1, -3, 3), (4, 1, 3, 5), (4, -1, -3, 4)], "object_id long, label int, iteration int, seq int")
    result = active.active_learning_step(objects, labels, sent, LinearScorer([1.0]), UncertaintyStrategy(), arrival=["seq"])
    assert {r["object_id"]: r["label"] for r in result.labels.collect()} == {1: 1, 2: 0, 3: -1, 4: 1}
    assert {r["object_id"] for r in result.training.collect()} == {1, 3, 4}
    without = active.active_learning_step(objects, labels.drop("seq"), sent.drop("seq").where("object_id < 4"), LinearScorer([1.0]), UncertaintyStrategy())
    assert {r["object_id"]: r["label"] for r in without.labels.collect()} == {1: 1, 2: 0, 3: -1}


@pytest.mark.parametrize("k", [4, 8, 12, 500])
def test_bins_give_as_many_as_asked(spark, objects, k):
    scored = LinearScorer([1.0]).score(objects)
    picked = [r["object_id"] for r in BinStrategy().select(scored, k).collect()]
    assert len(picked) == len(set(picked)) == min(k, 101)


def test_linear_rule_refuses_other_sizes(spark, objects):
    with pytest.raises(Exception, match="weights"):
        LinearScorer([1.0, 2.0]).score(objects).collect()


def test_batch_is_sent_again(spark, objects):
    calls = []

    def choose():
        calls.append(1)
        return objects.limit(3)

    first = active.current_batch(spark, "s1", 0, choose).collect()
    assert active.current_batch(spark, "s1", 0, choose).collect() == first and len(calls) == 1


def test_scores_are_kept_per_label_state(spark, objects, tmp_path):
    labels = spark.createDataFrame([(1, 1), (2, -1)], "object_id long, label int")
    version = active.labels_version(labels)
    assert version == active.labels_version(labels.orderBy(F.desc("object_id")))
    assert version != active.labels_version(labels.withColumn("label", -F.col("label")))
    root = str(tmp_path / "scores")
    a = active.stored_scores(spark, objects, LinearScorer([1.0]), root, version)
    b = active.stored_scores(spark, objects, LinearScorer([-1.0]), root, version)
    assert isinstance(a.toPandas(), pd.DataFrame) and a.agg(F.sum("x")).first() == b.agg(F.sum("x")).first()
    assert a.where("object_id = 0").first()["score"] == -1.0 == b.where("object_id = 0").first()["score"]


def test_versions_tell_duplicates_and_scorers_apart(spark):
    labels = lambda rows: spark.createDataFrame(rows, "object_id int, label int")
    one, twice, other = labels([(1, 1), (1, 1), (2, 1)]), labels([(3, 1), (3, 1), (2, 1)]), labels([(2, 1), (1, 1), (1, 1)])
    assert active.labels_version(one) != active.labels_version(twice) and active.labels_version(one) == active.labels_version(other)
    versions = {active.labels_version(one, s) for s in (LinearScorer([1.0]), LinearScorer([2.0]), LinearScorer([1.0], 0.5), None)}
    assert len(versions) == 4 and active.labels_version(one, LinearScorer([1.0])) in versions
    assert active.labels_version(labels([])) == "0-0000000000000000-0"
