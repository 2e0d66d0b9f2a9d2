import random
from collections import defaultdict
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from labelquarry.operators import runs

POINTS = "array<struct<x:double,y:double>>"


def filled(points):
    """The definition, pixel by pixel."""
    whole = [(int(x), int(y)) for x, y in points]
    sides = list(zip(whole, whole[1:] + whole[:1]))
    out = set()
    for y in range(min(p[1] for p in whole), max(p[1] for p in whole) + 1):
        at = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in sides if (a[1] <= y) != (b[1] <= y))
        for left, right in zip(at[::2], at[1::2]):
            out |= {(x, y) for x in range(ceil(left), floor(right) + 1)}
        for (x0, y0), (x1, y1) in sides:
            if not min(y0, y1) <= y <= max(y0, y1):
                continue
            if y0 == y1:
                ends = sorted((x0, x1))
            else:
                ends = sorted(x0 + (min(max(y + d, min(y0, y1)), max(y0, y1)) - y0) * (x1 - x0) / (y1 - y0) for d in (-0.5, 0.5))
                ends = [floor(e + 0.5) for e in ends]
            out |= {(x, y) for x in range(ends[0], ends[1] + 1)}
    return out


def painted(rows):
    """Pixels by key, the last object over the others."""
    out = defaultdict(dict)
    for key, who, value, points in sorted(rows, key=lambda r: r[1]):
        if points:
            out[key] |= dict.fromkeys(filled(points), value)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    spread = lambda n, s: [(rng.uniform(-s, s) + rng.choice([0, 4090]), rng.uniform(-s, s)) for _ in range(n)]
    out = [(rng.choice("ab"), i, rng.uniform(-1, 1), spread(rng.choice([1, 2, 3, 5, 12]), rng.choice([3, 20, 60]))) for i in range(150)]
    return out + [("a", 1000, 0.5, []), ("a", 1001, 0.5, None), ("c", 5, 0.25, [(1.9, -1.9)])]


def test_pixels_by_definition(spark, rows):
    df = spark.createDataFrame(rows, f"slide string, object_id int, score double, points {POINTS}").repartition(3)
    seen = runs.visible_runs(runs.outline_spans(df, ["slide"]), ["slide"]).cache()
    got = defaultdict(dict)
    for r in runs.run_pixels(seen).collect():
        assert (r["px"], r["py"]) not in got[r["slide"]]
        got[r["slide"]][r["px"], r["py"]] = r["score"]
    assert got == painted(rows)
    # A run is as long as it can be: no two of one object touch but at multiples of 4096.
    ends = {(r["slide"], r["y"], r["x_to"] + 1, r["object_id"]) for r in seen.collect()}
    assert not [r for r in seen.collect() if r["x_from"] % 4096 and (r["slide"], r["y"], r["x_from"], r["object_id"]) in ends]


def test_regions_are_clipped_and_covered(spark, rows):
    boxes = [("a", -10, -8, 40, 17), ("a", 4080, 0, 30, 5), ("b", 0, 0, 1, 1), ("z", 3, 3, 4, 2), ("b", 0, 0, 0, 5)]
    regions = spark.createDataFrame(boxes, "slide string, start_x int, start_y int, width int, height int")
    df = spark.createDataFrame(rows, f"slide string, object_id int, score double, points {POINTS}")
    region = regions.columns
    mask = runs.region_masks(df.join(regions, "slide"), regions, region)
    got = {}
    for r in runs.run_pixels(mask).collect():
        got[tuple(r[c] for c in region), r["px"], r["py"]] = (r["score"], r["object_id"] is None)
    pixels = painted(rows)
    want = {}
    for slide, left, top, width, height in boxes:
        for x in range(width):
            for y in range(height):
                hit = pixels[slide].get((x + left, y + top))
                want[(slide, left, top, width, height), x, y] = (7.0, True) if hit is None else (hit, False)
    assert got == want


def test_tiles(spark, rows):
    df = spark.createDataFrame(rows, f"slide string, object_id int, score double, points {POINTS}")
    mask = runs.run_pixels(runs.tile_masks(df, 32, background=None))
    got = {(r["slide"], r["tile_x"] * 32 + r["px"], r["tile_y"] * 32 + r["py"]): r["score"] for r in mask.collect()}
    assert got == {(k, *p): v for k, pixels in painted(rows).items() for p, v in pixels.items()}
    assert mask.where("px < 0 OR px >= 32 OR py < 0 OR py >= 32").count() == 0


def test_no_pixel_is_shuffled(spark, rows):
    df = spark.createDataFrame(rows, f"slide string, object_id int, score double, points {POINTS}")
    plan = runs.run_pixels(runs.visible_runs(runs.outline_spans(df, ["slide"]), ["slide"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange")


def test_empty_and_unfit_tables(spark):
    df = spark.createDataFrame([], f"slide string, object_id string, score double, points {POINTS}")
    with pytest.raises(TypeError):
        runs.outline_spans(df, ["slide"])
    none = df.withColumn("object_id", F.col("object_id").cast("int"))
    assert runs.visible_runs(runs.outline_spans(none, ["slide"]), ["slide"]).count() == 0
