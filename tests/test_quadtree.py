import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelquarry.operators import quadtree

POINTS, BOXES = "slide string, object_id int, x double, y double", "slide string, box int, left double, top double, right double, bottom double"


@pytest.fixture(scope="module")
def points():
    """A third of all lies in one cell, a tenth at one position."""
    rng = random.Random(6)
    spread = [(rng.choice("ab"), i, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for i in range(2000)]
    hot = [("a", 3000 + i, 700 + rng.expovariate(0.05), 1200 + rng.uniform(0, 300)) for i in range(1200)]
    pile = [("a", 5000 + i, 702.0, 1216.0) for i in range(400)]
    return spread + hot + pile + [("b", 9000, None, 3.0), (None, 9001, 5.0, 5.0), ("b", 9002, 512.0, -512.0), ("b", 9003, -0.0, 0.0)]


@pytest.fixture(scope="module")
def boxes():
    rng = random.Random(7)
    out = []
    for i in range(60):
        left, top = rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)
        out.append((rng.choice("ab"), i, left, top, left + rng.choice([0, 30, 700]), top + rng.choice([0, 30, 900])))
    around = [("a", 100 + i, 690.0 + i, 1200.0 + 20 * i, 720.0 + i, 1260.0 + 20 * i) for i in range(10)]
    return out + around + [("a", 200, -4000.0, -4000.0, 4000.0, 4000.0), ("b", 201, 512.0, -512.0, 512.0, -512.0), ("a", 202, 10.0, 10.0, 5.0, 20.0),
                           ("a", 203, None, 0.0, 5.0, 5.0), ("zz", 204, 0.0, 0.0, 9.0, 9.0), ("a", 100, 690.0, 1200.0, 720.0, 1260.0)]


@pytest.mark.parametrize("levels,leaf_rows", [(5, 20), (5, 20_000), (2, 50), (0, 7)])
def test_equals_comparing_all(spark, points, boxes, levels, leaf_rows):
    p, b = spark.createDataFrame(points, POINTS).repartition(4), spark.createDataFrame(boxes, BOXES)
    found = quadtree.points_in_boxes(b, p, levels=levels, leaf_rows=leaf_rows)
    got = Counter((r["box"], r["object_id"]) for r in found.collect())
    want = Counter(
        (i, o) for s, i, l, t, r, m in boxes for slide, o, x, y in points
        if s == slide and None not in (l, x) and l <= x <= r and t <= y <= m)
    assert got == want and len(want) > 3000


def test_a_crowded_cell_is_spread(spark, points):
    p = spark.createDataFrame(points, POINTS).where("x IS NOT NULL AND slide IS NOT NULL")
    near = p.withColumns({"_fx": F.floor(F.col("x") / 16), "_fy": F.floor(F.col("y") / 16)})
    tree = quadtree.crowded_cells(near, ["slide"], 5, 50)
    placed = quadtree._placed_points(near, tree, ["slide"], 5, p.columns)
    sizes = [r["count"] for r in placed.groupBy("slide", "_bx", "_by", "_leaf", "_part").count().collect()]
    assert max(sizes) <= 80 and sum(sizes) == p.count()
    # Cells of a few points are not cut.
    whole = placed.where("_leaf = 0").groupBy("slide", "_bx", "_by").count().collect()
    assert len(whole) > 50 and max(r["count"] for r in whole) <= 50


def test_empty_sides(spark, points, boxes):
    p, b = spark.createDataFrame(points, POINTS), spark.createDataFrame(boxes, BOXES)
    assert quadtree.points_in_boxes(b.limit(0), p).count() == 0
    assert quadtree.points_in_boxes(b, p.limit(0)).count() == 0
