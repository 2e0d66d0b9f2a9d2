import pytest
from pyspark.sql import functions as F

from labelquarry.functions import numbers, text
from labelquarry.operators import catalog as c
from labelquarry.operators import features as f
from labelquarry.operators import pixels as px
from labelquarry.operators import report, scoring
from labelquarry.plans.validation import Validation
from labelquarry.sinks import tables as sink
from labelquarry.sinks.catalog import CatalogTables, save_picker_session, save_training_session
from labelquarry.sources.quarantine import REASONS, check_segmentation, quarantine
from labelquarry.sources import segmentation, tables


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body)


def test_segmentation_files(spark, tmp_path):
    head = "Slide\tX\tY\tscan\tanalysis\tf1\tf2\tBoundaries\n"
    write(tmp_path / "S1" / "a.seg.1.txt", head + "S1.svs\t1.5\t2.0\t40.0\t20.0\t0.5\t-1\t1.0,2.0;3.5,4.0;\n")
    write(tmp_path / "S2" / "b.seg.1.txt", head + "S2.svs\t3.0\t4.0\t20.0\t20.0\tnan\t1\t1.0,2.0;\nS2.svs\t5.0\t6.0\t20.0\t20.0\t-nan\t1\t1.0,2.0;\n"
          "S2.svs\t7.0\t8.0\t20.0\t20.0\tinf\t1\t1.0,2.0;\nS2.svs\t9.0\t8.0\t20.0\t20.0\t0.25\t1\t12.0,34.0;5.0,6.0;\n")
    rows = segmentation.read_segmentation(spark, str(tmp_path), slide_from_folder=True)
    assert {r["slide"]: (r["kept"], r["rejected"]) for r in f.ingest_rejects(rows, ["slide"]).collect()} == {"S1": (1, 0), "S2": (1, 3)}
    good = f.scale_coordinates(f.reject_nonfinite(rows))
    got = {r["slide"]: r for r in sink.boundary_lines(good).collect()}
    assert (got["S1"]["centroid_x"], got["S1"]["boundary"]) == ("3.0", "2.0,4.0 7.0,8.0")
    assert (got["S2"]["centroid_x"], got["S2"]["boundary"]) == ("9.0", "12,34 5,6")
    sink.save_boundary_import(sink.boundary_lines(good), str(tmp_path / "import"))
    back = tables.load_boundaries(spark, str(tmp_path / "import"))
    assert sorted(str(r["centroid_x"]) for r in back.collect()) == ["3.0", "9.0"]
    assert back.select(text.polygon_points(F.col("boundary")).alias("p")).where("size(p) = 2").count() == 2


def test_segmentation_without_magnification(spark):
    lines = spark.createDataFrame([("S\t1.0\t2.0\t0.5\t0.6\t0.7\t1.0,1.0;",)], "value string")
    row = f.scale_coordinates(segmentation.parse_segmentation(lines, with_magnification=False), always=True).first()
    assert (row["x"], row["features"], row["boundary"][0]["x"]) == (2.0, [0.5, 0.6, 0.7], 2.0)


def test_small_files(spark, tmp_path):
    write(tmp_path / "roi.csv", "S1,1,2,3,4\nS2,5,6,7,8\n")
    write(tmp_path / "bad.csv", "S1,1,2,3\n")
    write(tmp_path / "slides.csv", "S1,100,200,/p,2\n")
    write(tmp_path / "list.csv", "S1,x\nS2,y\nS1,z\n")
    write(tmp_path / "percent.csv", "S1,42\n")
    write(tmp_path / "clinical.csv", "time,event,age\r\n1,1,50\r\n2,0,n/a\r\n")
    assert tables.load_regions_of_interest(spark, str(tmp_path / "roi.csv")).count() == 2
    with pytest.raises(Exception):
        tables.load_regions_of_interest(spark, str(tmp_path / "bad.csv")).collect()
    assert tables.load_slides(spark, str(tmp_path / "slides.csv")).first()["scale"] == 2
    assert sorted(r["name"] for r in tables.load_slide_list(spark, str(tmp_path / "list.csv")).collect()) == ["S1", "S2"]
    assert tables.load_slide_percentages(spark, str(tmp_path / "percent.csv")).first()["percent"] == 42
    clinical = tables.load_clinical(spark, str(tmp_path / "clinical.csv"))
    assert clinical.columns == ["time", "event", "age"] and [r["age"] for r in clinical.orderBy("time").collect()] == [50.0, None]


@pytest.fixture(scope="module")
def objects(spark):
    rows = [(i, f"S{i % 2}", float(i), float(2 * i), [float(i % 5) - 2, (i % 7) / 7.0], 1 if i % 5 > 2 else -1) for i in range(120)]
    return spark.createDataFrame(rows, "object_id long, slide string, x float, y float, features array<float>, label int")


def test_object_table_round_trip(spark, objects, tmp_path):
    path = str(tmp_path / "objects")
    sink.save_objects(objects.drop("label"), path)
    back = tables.load_objects(spark, path)
    assert back.count() == 120 and back.schema["features"].dataType.elementType.typeName() == "float"
    sink.overwrite_slides(objects.drop("label").where("slide = 'S1'").limit(5), path)
    assert {r["slide"]: r["count"] for r in spark.read.parquet(path).groupBy("slide").count().collect()} == {"S0": 60, "S1": 5}
    with pytest.raises(ValueError):
        sink.save_labeled(objects.drop("x"), str(tmp_path / "short"))
        tables.load_objects(spark, str(tmp_path / "short"))


def test_saving_never_overwrites(spark, objects, tmp_path):
    path = str(tmp_path / "set")
    assert sink.save_without_clobbering(objects, path, "abcdef") == path
    assert sink.save_without_clobbering(objects, path, "abcdef") == path + "_abc"
    labeled = tables.load_labeled(spark, path)
    assert labeled.where("iteration IS NULL AND label IS NOT NULL").count() == 120


def test_run_and_log_tables(spark, tmp_path):
    for _ in range(2):
        sink.record_run(spark, str(tmp_path / "runs"), "1", "apply")
        sink.append_log(spark, str(tmp_path / "log"), "INFO", "started")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    assert spark.read.parquet(str(tmp_path / "log")).columns == ["remote_addr", "type", "message", "log_date"]
    sink.save_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_zscore_and_back(spark, objects):
    params = f.feature_stats(objects)
    scaled = f.zscore_features(objects, params)
    stats = f.feature_stats(scaled).first()
    assert stats["mean"] == pytest.approx([0, 0], abs=1e-9) and stats["std"] == pytest.approx([1, 1])
    back = scaled.withColumns({"m": params.select("mean").scalar(), "s": params.select("std").scalar()}).select(
        "object_id", numbers.unzscore(F.col("features"), F.col("m"), F.col("s")).alias("f"))
    pairs = back.join(objects, "object_id").select("f", "features").collect()
    assert all(a == pytest.approx(b, abs=1e-6) for a, b in pairs)


@pytest.mark.parametrize("scorer,floor", [
    (scoring.RandomForestScorer(seed=1), 0.95), (scoring.NetworkScorer(seed=1, iterations=60), 0.9),
    (scoring.RbfMarginScorer(seed=1, components=64), 0.9),
])
def test_models_learn(objects, scorer, floor):
    model = scorer.fit(objects.where("object_id < 80"))
    scored = scoring.classify(model.score(objects.where("object_id >= 80")))
    right = scored.agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0]
    assert right >= floor
    if not isinstance(scorer, scoring.RbfMarginScorer):
        assert scored.where("score < -1 OR score > 1").count() == 0


def test_validation_plan(spark, objects):
    params = f.feature_stats(objects)
    run = Validation.train(objects, objects, scoring.LinearScorer([1.0, 0.0], bias=-0.5), params, params)
    points, metrics = run.roc()
    m = metrics.first()
    assert points.count() == 120 and m["tp"] + m["fn"] == m["p"] and m["accuracy"] == 1.0
    assert run.counts().agg(F.sum("n")).first()[0] == 120
    assert run.score_map("S1").count() == 60 and run.object_labels(50).count() == 120
    slides = spark.createDataFrame([("S0", 1), ("S1", 1)], "name string, scale int")
    rois = spark.createDataFrame([("S0", 0, 0, 20, 20), ("none", 0, 0, 5, 5)], "slide string, start_x int, start_y int, width int, height int")
    outline = F.format_string("%d,%d %d,%d %d,%d ", *[(F.col(k) + d).cast("int") for k, d in (("x", 0), ("y", 0), ("x", 2), ("y", 0), ("x", 2), ("y", 2))])
    outlines = objects.select("slide", F.col("object_id").alias("id"), F.col("x").cast("decimal(10,1)").alias("centroid_x"),
                              F.col("y").cast("decimal(10,1)").alias("centroid_y"), outline.alias("boundary"))
    pixels = run.mask(rois, slides, outlines).collect()
    assert pixels and all(0 <= r["px"] < 20 and 0 <= r["py"] < 20 for r in pixels)


def test_zero_scores_by_report(spark):
    df = spark.createDataFrame([("A", 0.0), ("A", -0.5), ("A", 0.5)], "slide string, score double")
    assert report.slide_positive_counts(df).first()["positive"] == 1
    assert report.slide_positive_counts(df, tie_positive=True).first()["positive"] == 2
    assert report.slide_class_counts(scoring.classify(df)).first()["positive"] == 2


def test_review_lists_are_paged(spark):
    df = spark.range(250).select(F.col("id").alias("object_id"), F.lit("A").alias("slide"), F.lit(1).alias("label"))
    pages = report.samples_by_slide(df, per_list=50).collect()
    assert [[s["id"] for s in p["samples"]] for p in sorted(pages, key=lambda p: p["page"])] == [list(range(i, i + 50)) for i in range(0, 250, 50)]
    texts = report.samples_by_slide(df.withColumn("object_id", F.format_string("o%04d", "object_id")), per_list=100).collect()
    assert sorted((p["page"], p["samples"][0]["id"], len(p["samples"])) for p in texts) == [(0, "o0000", 100), (1, "o0100", 100), (2, "o0200", 50)]


def test_constant_columns_and_bad_vertices_do_not_stop_a_job(spark):
    from labelquarry.functions.numbers import zscore
    from labelquarry.functions.text import polygon_points
    from labelquarry.operators.survival import standardize_covariates

    row = spark.range(1).select(zscore(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("z")).first()
    assert row["z"] == [None, 1.0]
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "a double, b double")
    assert [r["a"] for r in standardize_covariates(df, ["a", "b"]).collect()] == [None] * 3
    points = spark.range(1).select(polygon_points(F.lit("1,2 x,3 4")).alias("p")).first()["p"]
    assert [(p["x"], p["y"]) for p in points][:2] == [(1.0, 2.0), (None, 3.0)]


def test_catalog_changes(spark):
    existing = spark.createDataFrame([(1, 10, 3, 1), (1, 11, 4, 1)], "training_set_id int, cell_id int, iteration int, class_id int")
    incoming = spark.createDataFrame([(1, 10, 9, 2), (1, 12, 9, 2)], "training_set_id int, cell_id int, iteration int, class_id int")
    got = {r["cell_id"]: (r["iteration"], r["class_id"]) for r in c.upsert_training_objs(existing, incoming).collect()}
    assert got == {10: (3, 2), 11: (4, 1), 12: (9, 2)}
    fresh = c.next_ids(spark.createDataFrame([("b",), ("a",)], "name string"), spark.createDataFrame([(7,)], "id int"), "name")
    assert {r["name"]: r["id"] for r in fresh.collect()} == {"a": 8, "b": 9}
    old = spark.createDataFrame([("A", 1), ("B", 2)], "slide string, v int")
    new = spark.createDataFrame([("A", 5)], "slide string, v int")
    assert sorted(tuple(r) for r in c.replace_by_slide(old, new).collect()) == [("A", 5), ("B", 2)]
    unknown = c.enrich_samples(spark.createDataFrame([("Z",)], "slide string"),
                               spark.createDataFrame([("A", 1, 1, "p", 1)], "name string, x_size int, y_size int, pyramid_path string, scale int"))
    assert unknown.first()["max_x"] is None


def test_names_and_defaults(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, 5.0, None)], "x double, y double, click_x double, click_y double, patch_size int")
    row = c.session_defaults(df).first()
    assert (row["click_x"], row["click_y"], row["patch_size"]) == (1.0, 5.0, 28)
    names = c.label_names(spark.createDataFrame([(1,), (-1,), (0,)], "label int")).orderBy("label").collect()
    assert [r["class_name"] for r in names] == ["Negative", "Ignore", "Positive"]
    row = spark.range(1).select(
        text.slide_from_directory(F.lit("/data/S9/x.txt")).alias("d"), text.name_stem(F.lit("S9.svs")).alias("s"),
        text.compact_polygon(F.lit("12.0,34.0;5.0,6.0;")).alias("p"), text.position_key(F.lit(3.0), F.lit(4.25)).alias("k"),
        numbers.two_digit_scientific(F.lit(0.0012345)).alias("e"), numbers.two_digit_scientific(F.lit(-250.0)).alias("n"),
        numbers.log2_edges(0, 6, 7).alias("edges"), numbers.gray_level(F.lit(0.5), F.lit(0.25)).alias("g"),
    ).first()
    assert (row["d"], row["s"], row["p"], row["k"][:3]) == ("S9", "S9", "12,34 5,6", "3.0")
    assert row["e"] == pytest.approx(0.00123) and row["n"] == -250.0
    assert row["edges"] == [1, 2, 4, 8, 16, 32, 64] and row["g"] == 255


def test_stain_and_colour_round_trips(spark):
    rows = [("S", 1, x, 0, 40 + 20 * x, 90 + 10 * x, 200 - 10 * x) for x in range(8)]
    df = spark.createDataFrame(rows, "slide string, object_id int, px int, py int, r int, g int, b int")
    back = px.lab_to_rgb(px.rgb_to_lab(df).drop("r", "g", "b")).join(df.select("px", *[F.col(v).alias(f"{v}0") for v in "rgb"]), "px")
    for r in back.collect():
        assert [r["r"], r["g"], r["b"]] == pytest.approx([r["r0"] / 255, r["g0"] / 255, r["b0"] / 255], abs=0.02)
    stained = spark.createDataFrame([(200.0, 120.0, 255.0)], "stain1 double, stain2 double, stain3 double")
    again = px.unmix_stains(px.remix_stains(stained)).first()
    assert again[again.__fields__.index("stain1")] == pytest.approx(200, abs=2) and again["stain2"] == pytest.approx(120, abs=2)


def test_gradient_of_an_image_with_two_objects(spark):
    rows = [("S", 1 if x < 2 else 2, x, y, float(x * x)) for x in range(4) for y in range(3)]
    df = spark.createDataFrame(rows, "slide string, object_id int, px int, py int, value double")
    got = {(r["object_id"], r["px"]): r["value"] for r in px.gradient_magnitude(df).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 2.0, (2, 2): 4.0, (2, 3): 5.0}


def test_texture_of_two_levels(spark):
    df = spark.createDataFrame([("S", 1, float(v)) for v in (0, 0, 0, 8)], "slide string, object_id int, value double")
    row = px.object_texture(df).first()
    assert row["entropy"] == pytest.approx(0.8112781) and row["energy"] == pytest.approx(0.625)
    assert row["skewness"] == pytest.approx(1.1547005) and row["kurtosis"] == pytest.approx(2.3333333)


def test_quarantine_gives_a_reason(spark, tmp_path):
    good = "S1\t1.5\t2.0\t20.0\t20.0\t0.1\t0.2\t1.0,1.0;2.0,1.0;"
    cases = {
        good: None, good.replace("0.2", "nan"): "feature", good.replace("0.2", "-nan"): "feature", good.replace("0.2", "inf"): "feature", good.replace("0.2", "x"): "feature",
        good.replace("1.5", "nan"): "coordinate", good.replace("2.0\t", "1,5\t"): "coordinate", good.replace("20.0\t20.0", "\t20.0"): "magnification",
        good.replace("0.2\t", ""): "length", good.replace("1.0,1.0", "1.0"): "vertex", good.replace("1.0,1.0", "nan,1.0"): "vertex",
        good.replace("1.0,1.0;2.0,1.0;", ""): "vertex", "S1\t1.5": "fields", "7": "fields", good.replace("S1", " "): "slide",
        "Slide\tX\tY\tScan\tAnalysis\tf1\tBoundaries": "header", "": "header", None: "header",
    }
    lines = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, value string")
    rows, rejected, counts = quarantine(check_segmentation(lines, dims=2, keep=("id",)), str(tmp_path / "q"))
    want = {i: r for i, r in enumerate(cases.values()) if r != "header"}
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {i: r for i, r in want.items() if r}
    assert [(r["id"], r["slide"], r["x"], r["features"]) for r in rows.collect()] == [(0, "S1", 1.5, [0.1, 0.2])]
    assert {r["line"] for r in rejected.collect()} == {c for c, r in cases.items() if r not in (None, "header")}
    assert counts["rows"] == len(want) and counts["good"] == 1 and counts["feature"] == 4
    assert counts["good"] + sum(counts[r] for r in REASONS) == counts["rows"]
    rows, rejected, counts = quarantine(check_segmentation(lines.limit(0)), str(tmp_path / "none"))
    assert rows.count() == rejected.count() == 0 and set(counts.values()) == {0}


def test_a_session_is_saved_as_a_whole(spark, tmp_path):
    tables = CatalogTables(spark, str(tmp_path / "catalog"))
    assert tables.version() == 0 and tables.read("classes").count() == 0
    samples = spark.createDataFrame([(5, 1, 0), (6, -1, 0), (7, 0, 1), (8, 1, -2)], "id long, label int, iteration int")
    assert save_training_session(tables, "first", 3, 2, " ", "tumour", "stroma", samples) == 1
    assert save_picker_session(tables, "check", 3, "p.h5", "a", "b") == 1
    broken = samples.withColumn("iteration", F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).cast("int"))
    with pytest.raises(Exception, match="lost"):
        save_training_session(tables, "second", 3, 2, "f.h5", "x", "y", broken)
    # Nothing of the failed one is seen, and its ids are free.
    assert tables.version() == 2 and [r["name"] for r in tables.read("training_sets").collect()] == ["first"] and tables.read("classes").count() == 2
    assert save_training_session(tables, "second", 3, 2, "f.h5", "x", "y", samples.where("id < 7")) == 2
    sets = {r["id"]: (r["name"], r["filename"]) for r in tables.read("training_sets").collect()}
    assert sets == {1: ("first", "lost filename"), 2: ("second", "f.h5")}
    classes = {r["id"]: (r["name"], r["training_set_id"], r["color"], r["label"]) for r in tables.read("classes").collect()}
    assert classes == {1: ("tumour", 1, "green", 1), 2: ("stroma", 1, "red", -1), 3: ("x", 2, "green", 1), 4: ("y", 2, "red", -1)}
    objs = {(r["training_set_id"], r["cell_id"]): (r["class_id"], r["iteration"]) for r in tables.read("training_objs").collect()}
    assert objs == {(1, "5"): (1, 0), (1, "6"): (2, 0), (1, "7"): (2, 1), (1, "8"): (1, -2), (2, "5"): (3, 0), (2, "6"): (4, 0)}
    assert tables.read("training_sets", 2).count() == 1 and tables.read("test_sets").first()["filename"] == "p.h5"
