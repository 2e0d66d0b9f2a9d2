import random

import pytest
from pyspark.sql import functions as F

from labelquarry.operators import spatial as sp


@pytest.fixture(scope="module")
def scene(spark):
    rng = random.Random(11)
    # One slide and one spot hold a large share of the rows.
    objects = [(i, "A" if i % 3 else "B", float(rng.randint(0, 200)) / 2, float(rng.randint(0, 200)) / 2) for i in range(500)]
    objects += [(1000 + i, "A", 50.0, 50.0) for i in range(400)]
    clicks = [(i, rng.choice("ABC"), float(rng.randint(-20, 120)), float(rng.randint(-20, 120))) for i in range(300)]
    clicks += [(900 + i, "A", 51.0, 50.0) for i in range(200)]
    o = spark.createDataFrame(objects, "object_id long, slide string, x double, y double")
    c = spark.createDataFrame(clicks, "click_id long, slide string, x double, y double")
    return objects, clicks, o, c


@pytest.mark.parametrize("reach", [3, 10, 256])
def test_nearest_matches_brute_force(scene, reach):
    objects, clicks, o, c = scene
    want = {}
    for cid, slide, cx, cy in clicks:
        near = [((x - cx) ** 2 + (y - cy) ** 2, i) for i, s, x, y in objects
                if s == slide and abs(x - cx) <= reach and abs(y - cy) <= reach]
        if near:
            want[cid] = min(near)
    got = {r["click_id"]: (r["dist"], r["object_id"]) for r in sp.nearest_object(c, o, reach).collect()}
    assert got == want


def test_roi_padding(spark):
    rois = spark.createDataFrame([("A", 10, 100, 50, 60), ("B", 10, 100, 50, 60)], "slide string, start_x int, start_y int, width int, height int")
    slides = spark.createDataFrame([("A", 1), ("B", 2)], "name string, scale int")
    got = {r["slide"]: (r["left"], r["top"], r["right"], r["bottom"]) for r in sp.padded_region(rois, slides).collect()}
    assert got == {"A": (10, 68, 92, 192), "B": (10, 36, 124, 224)}


def test_roi_objects_match_brute_force(spark, scene):
    objects, _, o, _ = scene
    boxes = [("A", 10, 10, 40, 45), ("A", 0, 0, 100, 100), ("B", 20, 5, 20, 90), ("Z", 0, 0, 9, 9)]
    rois = spark.createDataFrame(boxes, "slide string, left int, top int, right int, bottom int")
    got = sorted((r["slide"], r["left"], r["object_id"]) for r in sp.roi_objects(rois, o, cell=16.0).collect())
    want = sorted((s, l, i) for s, l, t, r, b in boxes for i, os, x, y in objects if os == s and l <= x <= r and t <= y <= b)
    assert got == want


def test_tiles(spark):
    o = spark.createDataFrame([(1, 0.0, 5.0), (2, 10.0, 20.0), (3, 9.9, 0.0)], "id int, x double, y double")
    half = {r["id"]: (r["tile_x"], r["tile_y"]) for r in sp.tile_objects(o, 10).collect()}
    assert half == {1: (0, 0), 2: (1, 2), 3: (0, 0)}
    closed = sorted((r["id"], r["tile_x"], r["tile_y"]) for r in sp.tile_objects(o, 10, closed=True).collect())
    assert closed == [(1, 0, 0), (2, 0, 1), (2, 0, 2), (2, 1, 1), (2, 1, 2), (3, 0, 0)]


def test_object_labels_run_over_tiles(scene):
    objects, _, o, _ = scene
    got = {}
    for r in sp.object_labels_by_tile(o, 20).collect():
        got.setdefault(r["slide"], []).append((r["object_label"], r["tile_x"], r["tile_y"], r["object_id"]))
    for rows in got.values():
        rows.sort()
        assert [n for n, *_ in rows] == list(range(1, len(rows) + 1))
        assert [t[1:3] for t in rows] == sorted(t[1:3] for t in rows)


def test_viewport_filter_reaches_the_scan(spark, scene, tmp_path):
    o = scene[2]
    o.write.partitionBy("slide").parquet(str(tmp_path / "objects"))
    stored = spark.read.parquet(str(tmp_path / "objects"))
    view = sp.viewport(stored, "A", 10, 10, 20, 20)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slide" in plan and "GreaterThanOrEqual(x,10" in plan
    assert view.where(~F.col("x").between(10, 20)).count() == 0


def test_box_with_a_zero_edge_is_valid(scene):
    assert sp.viewport(scene[2], "A", 0, 0, 30, 30).count() > 0


def test_boundary_join_rounds_to_one_decimal(spark):
    samples = spark.createDataFrame([(1, "A", 1.04, 2.0), (2, "A", 9.0, 9.0)], "object_id int, slide string, x double, y double")
    outlines = spark.createDataFrame([("A", 7, 1.0, 2.0, "0,0 1,1 ")], "slide string, id int, cx double, cy double, boundary string").select(
        "slide", "id", "boundary", F.col("cx").cast("decimal(10,1)").alias("centroid_x"), F.col("cy").cast("decimal(10,1)").alias("centroid_y"))
    got = {r["object_id"]: r["boundary_id"] for r in sp.attach_boundaries(samples, outlines).collect()}
    assert got == {1: 7, 2: None}


def test_drawn_labels_have_no_gaps(spark):
    rng = random.Random(2)
    objects = [("a", i, float(rng.choice([0, 20, 40, rng.randint(0, 60)])), float(rng.choice([20, rng.randint(0, 60)]))) for i in range(200)]
    objects += [("b", 7, 20.0, 20.0), ("b", 8, 1.0, 1.0), ("b", 8, 1.0, 1.0), (None, 9, 1.0, 1.0), ("a", None, 1.0, 1.0)]
    o = spark.createDataFrame(objects, "slide string, object_id int, x double, y double")
    held = [(s, x, y) for s, i, x, y in objects if s and (s == "b" or i is not None and i % 4)]
    b = spark.createDataFrame(held + held[:5], "slide string, centroid_x double, centroid_y double").selectExpr(
        "slide", "cast(centroid_x as decimal(10,1)) as centroid_x", "cast(centroid_y as decimal(10,1)) as centroid_y")
    got = {}
    for r in sp.drawn_object_labels(o, b, 20).collect():
        got.setdefault(r["slide"], []).append((r["object_label"], r["tile_x"], r["tile_y"], r["object_id"]))
    for slide in "ab":
        positions = set(held)
        tiles = lambda v: [int(v // 20) - 1, int(v // 20)] if v % 20 == 0 and v > 0 else [int(v // 20)]
        want = sorted((tx, ty, i) for s, i, x, y in objects if s == slide and i is not None and (s, x, y) in positions for tx in tiles(x) for ty in tiles(y))
        assert sorted(got[slide]) == [(n, *w) for n, w in enumerate(want, 1)]
