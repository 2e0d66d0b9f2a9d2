import numpy as np
import pytest

from labelquarry.functions.text import polygon_points, polygon_text
from labelquarry.operators import geometry as g
from pyspark.sql import functions as F

CASES = {
    "repeated point": ([0, 1, 1, 1, 2], [1, 1, 1, 1, 1]),
    "repeated corner": ([0, 1, 1, 1], [1, 1, 1, 0]),
    "colinear spur": ([0, 2, 1], [0, 0, 0]),
    "T spur": ([0, 1, 1, 1, 2], [0, 0, 1, 0, 0]),
    "plus spur": ([1, 0, 1, 1, 1, 2, 1, 1, 1], [1, 1, 1, 0, 1, 1, 1, 2, 1]),
    "vertical turn": ([0, 0, 0, 1], [0, 2, 1, 1]),
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, [(float(a), float(b)) for a, b in zip(x, y)]) for k, (x, y) in CASES.items()]
    return spark.createDataFrame(rows, "name string, points array<struct<x:double,y:double>>")


def points(df):
    return {r["name"]: [(p["x"], p["y"]) for p in r["points"]] for r in df.collect()}


def test_merge_colinear(lines):
    got = points(g.merge_colinear(lines))
    assert got["repeated point"] == [(0, 1), (2, 1)]
    assert got["repeated corner"] == [(0, 1), (1, 1), (1, 0)]
    assert got["colinear spur"] == [(0, 0), (1, 0)]
    # Going back along a vertical line changes the slope from +inf to -inf, so the point stays.
    assert got["T spur"] == [(0, 0), (1, 0), (1, 1), (1, 0), (2, 0)]
    assert got["vertical turn"] == [(0, 0), (0, 2), (0, 1), (1, 1)]


def test_remove_spurs(lines):
    got = points(g.remove_spurs(lines))
    assert got["colinear spur"] == [(0, 0), (1, 0)]
    assert got["T spur"] == [(0, 0), (1, 0), (1, 0), (2, 0)]
    assert got["plus spur"] == [(1, 1), (1, 1), (1, 1), (1, 1), (1, 1)]


def test_duplicate_vertices(lines):
    got = g.duplicate_vertices(lines.where("name = 'plus spur'"), ["name"]).collect()
    assert sorted(r["pos"] for r in got) == [0, 2, 4, 6, 8] and {r["times"] for r in got} == {5}


def test_resample_keeps_ends_and_spacing(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0)])], "id int, points array<struct<x:double,y:double>>")
    got = [(r["x"], r["y"]) for r in g.arc_length_resample(df, 4, ["id"]).orderBy("k").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1)]


def test_square(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "id int, points array<struct<x:double,y:double>>")
    row = g.polygon_morphometry(df, ["id"]).first()
    assert (row["area"], row["perimeter"], row["extent"]) == (16, 16, 1)
    assert row["circularity"] == pytest.approx(np.pi / 4)


def test_band_edges():
    assert g.band_edges() == [1, 2, 4, 8, 16, 32, 64]


def test_descriptor_shares(spark):
    rng = np.random.default_rng(2)
    outline = [(float(a), float(b)) for a, b in rng.normal(size=(30, 2))]
    row = g.fourier_descriptors(spark.createDataFrame([(1, outline)], "id int, points array<struct<x:double,y:double>>"), ["id"]).first()
    assert all(0 <= row[f"fsd{i}"] <= 1 for i in range(1, 7))


def test_raster_last_object_wins(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    df = spark.createDataFrame([("S", 1, 0.5, square(0.0, 4.0)), ("S", 2, -0.5, square(3.0, 5.0))],
                               "slide string, object_id int, score double, points array<struct<x:double,y:double>>")
    got = {(r["px"], r["py"]): r["score"] for r in g.rasterize(df, ["slide"]).collect()}
    assert len(got) == 25 + 9 - 4
    assert got[0, 0] == 0.5 and got[3, 3] == -0.5 and got[5, 5] == -0.5 and (5, 0) not in got
    cut = g.crop(g.rasterize(df, ["slide"]), F.lit(3), F.lit(3), F.lit(2), F.lit(2))
    assert {(r["px"], r["py"]) for r in cut.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_polygon_text_round_trip(spark):
    df = spark.createDataFrame([("1.5,2.0;3.0,4.5;",)], "t string").withColumn("p", polygon_points(F.col("t"), ";"))
    assert df.select(F.size("p")).first()[0] == 2
    assert df.select(polygon_text(F.col("p"))).first()[0] == "1.5,2.0;3.0,4.5;"


def one_resampled(points, steps):
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    lengths = np.hypot(np.diff(x), np.diff(y))
    total = lengths.sum()
    if len(x) < 2 or total == 0:
        return [(x[0], y[0])] * (steps + 1)
    ends = np.concatenate([[0.0], np.cumsum(lengths / total)])
    out = []
    for place in np.arange(steps + 1) / steps:
        i = min(max(np.searchsorted(ends, place, side="right") - 1, 0), len(x) - 2)
        along = (place - ends[i]) / (lengths[i] / total) if lengths[i] else 0.0
        out.append((x[i] + (x[i + 1] - x[i]) * along, y[i] + (y[i + 1] - y[i]) * along))
    return out


def test_outlines_of_all_lengths_in_one_batch(spark):
    rng = np.random.default_rng(9)
    outlines = [[(float(a), float(b)) for a, b in np.round(rng.normal(size=(n, 2)), 1)] for n in [1, 2, 3, 7, 7, 7, 40, 2, 300]]
    outlines += [[(1.0, 2.0)] * 5, [(0.0, 0.0), (0.0, 0.0), (3.0, 4.0), (3.0, 4.0)], [], None]
    schema = "id int, tag string, points array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(i, f"t{i}", p) for i, p in enumerate(outlines)], schema).coalesce(1)
    got = {}
    for r in g.arc_length_resample(df, 16, ["id", "tag"]).collect():
        got.setdefault((r["id"], r["tag"]), {})[r["k"]] = (r["x"], r["y"])
    assert set(got) == {(i, f"t{i}") for i, p in enumerate(outlines) if p}
    for (i, _), rows in got.items():
        assert np.allclose([rows[k] for k in range(17)], one_resampled(outlines[i], 16), atol=1e-12)
    shapes = g.fourier_descriptors(df, ["id"]).collect()
    assert [r["id"] for r in shapes] == [i for i, p in enumerate(outlines) if p]
    angles = [np.arctan2(b[1] - a[1], b[0] - a[0]) for a, b in zip(one_resampled(outlines[8], 128), one_resampled(outlines[8], 128)[1:])]
    energy = np.abs(np.fft.fft(np.array(angles) - angles[0])) ** 2
    assert shapes[8]["fsd1"] == pytest.approx(energy[0:2].sum() / energy.sum())
    assert g.arc_length_resample(df.limit(0), 4, ["id"]).count() == 0
