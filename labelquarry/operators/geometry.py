"""Outline clean-up and shape features. One row holds one outline, so nothing is shuffled."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.functions.numbers import bind
from labelquarry.operators.runs import outline_spans, run_pixels, visible_runs

# Points after resampling and number of frequency bands.
RESAMPLE_POINTS = 128
FREQUENCY_BANDS = 6

_TOGETHER = 1 << 20  # coordinates that are worked on together
_ARROW = {"integer": pa.int32(), "double": pa.float64()}


def drop_repeats(points: Column) -> Column:
    """Of consecutive equal points the last one stays."""
    last = F.size(points) - 1
    return F.filter(points, lambda p, i: (i == last) | (p != F.get(points, i + 1)))


def _bends(points: Column, spur_rule: bool) -> Column:
    """Point filter over an outline without repeats."""
    last = F.size(points) - 1

    def keep(p, i):
        before, after = F.get(points, i - 1), F.get(points, i + 1)
        dx1, dy1 = p["x"] - before["x"], p["y"] - before["y"]
        dx2, dy2 = after["x"] - p["x"], after["y"] - p["y"]
        vertical_turn = (dx1 == 0) & (dx2 == 0) & (F.signum(dy1) == -F.signum(dy2))
        if spur_rule:
            level_turn = (dy1 == 0) & (dy2 == 0) & (F.signum(dx1) == -F.signum(dx2))
            inner = ~(vertical_turn | level_turn)
        else:
            inner = (dx1 * dy2 != dy1 * dx2) | vertical_turn
        return (i == 0) | (i == last) | inner

    return F.filter(points, keep)


def _cleaned(points: Column, spur_rule: bool) -> Column:
    return bind(points, lambda raw: bind(drop_repeats(raw), lambda clean: _bends(clean, spur_rule)))


def merge_colinear(df: DataFrame, points: str = "points") -> DataFrame:
    """Repeats go, and inner points at which the slope does not change. Going back along a
    vertical line counts as a change of slope (from +∞ to −∞)."""
    return df.withColumn(points, _cleaned(F.col(points), spur_rule=False))


def remove_spurs(df: DataFrame, points: str = "points") -> DataFrame:
    """Repeats go, and inner points at which the outline turns back on itself horizontally or
    vertically."""
    return df.withColumn(points, _cleaned(F.col(points), spur_rule=True))


def duplicate_vertices(df: DataFrame, keep: list[str], points: str = "points") -> DataFrame:
    """The vertices whose position occurs more than once in their outline."""
    placed = df.select(*keep, F.posexplode(points)).select(
        *keep, "pos", F.col("col.x").alias("x"), F.col("col.y").alias("y")
    )
    shared = placed.groupBy(*keep, "x", "y").agg(
        F.collect_list("pos").alias("_at"), F.count(F.lit(1)).cast("int").alias("times")
    ).where("times > 1")
    return shared.select(*keep, F.explode("_at").alias("pos"), "x", "y", "times")


def _ragged(df: DataFrame, keep: list[str], points: str, fields: str,
            work: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], rows_each: int) -> DataFrame:
    """Runs numpy over whole batches of outlines.

    A batch is one flat array of coordinates with offsets. Outlines of equal length make a matrix each, so Python loops
    over lengths, not over rows. ``work`` turns the matrices of x and y into matrices with ``rows_each`` columns, which
    become the output rows of each outline, in order. Null and empty outlines give none.
    """
    kinds = T._parse_datatype_string(fields)
    schema = T.StructType([*[df.schema[k] for k in keep], *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outlines = batch.column(0)
            lengths = pc.fill_null(pc.list_value_length(outlines), 0).to_numpy(zero_copy_only=False)
            flat = outlines.flatten()
            x, y = (pc.cast(pc.struct_field(flat, c), pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            starts = np.cumsum(lengths) - lengths
            results = {f.name: np.empty((len(lengths), rows_each)) for f in kinds}
            for n in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == n)
                for some in np.array_split(rows, -(-len(rows) * n // _TOGETHER)):
                    at = starts[some][:, None] + np.arange(n)
                    for name, values in work(x[at], y[at]).items():
                        results[name][some] = values
            full = np.flatnonzero(lengths > 0)
            again = pa.array(np.repeat(full, rows_each))
            made = [pa.array(results[f.name][full].ravel()).cast(_ARROW[f.dataType.typeName()]) for f in kinds]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(again) for i in range(1, batch.num_columns)], *made], names=schema.names)

    return df.select(points, *keep).mapInArrow(run, schema)


def _resample(x: np.ndarray, y: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """steps + 1 points at equal distances along each of the open polylines, one per row."""
    lengths = np.hypot(np.diff(x, axis=1), np.diff(y, axis=1))
    total = lengths.sum(axis=1, keepdims=True)
    moves = total[:, 0] > 0
    if x.shape[1] < 2:
        return np.repeat(x, steps + 1, axis=1), np.repeat(y, steps + 1, axis=1)
    share = np.divide(lengths, total, out=np.zeros_like(lengths), where=total > 0)
    ends = np.concatenate([np.zeros_like(total), np.cumsum(share, axis=1)], axis=1)
    places = np.arange(steps + 1) / steps
    segment = np.empty((len(x), steps + 1), np.intp)
    for k, place in enumerate(places):
        segment[:, k] = np.count_nonzero(ends <= place, axis=1) - 1
    segment = np.clip(segment, 0, x.shape[1] - 2)
    pick = lambda a, i: np.take_along_axis(a, i, axis=1)
    part = pick(share, segment)
    along = np.divide(places - pick(ends, segment), part, out=np.zeros_like(part), where=part > 0)
    between = lambda a: np.where(moves[:, None], pick(a, segment) + (pick(a, segment + 1) - pick(a, segment)) * along, a[:, :1])
    return between(x), between(y)


def arc_length_resample(df: DataFrame, steps: int, keep: list[str], points: str = "points") -> DataFrame:
    """Rows (keep…, k, x, y) with k = 0 … steps. Null and empty outlines have none."""
    def work(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        rx, ry = _resample(x, y, steps)
        return {"k": np.broadcast_to(np.arange(steps + 1), rx.shape), "x": rx, "y": ry}

    return _ragged(df, keep, points, "k int, x double, y double", work, steps + 1)


def band_edges(points: int = RESAMPLE_POINTS, bands: int = FREQUENCY_BANDS) -> list[int]:
    """Band limits from 1 to points / 2, evenly spaced in the exponent and rounded."""
    top = math.log2(points) - 1
    return [math.floor(2 ** (i * top / bands) + 0.5) for i in range(bands + 1)]


def fourier_descriptors(df: DataFrame, keep: list[str], points: str = "points",
                        count: int = RESAMPLE_POINTS, bands: int = FREQUENCY_BANDS) -> DataFrame:
    """Columns fsd1 … : spectral energy of the tangent angle along the outline, in bands that
    share their limits, as a share of the whole. Null and empty outlines have no row."""
    edges = band_edges(count, bands)

    def describe(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        rx, ry = _resample(x, y, count)
        angles = np.arctan2(np.diff(ry, axis=1), np.diff(rx, axis=1))
        angles -= angles[:, :1]
        energy = np.abs(np.fft.fft(angles, axis=1)) ** 2
        whole = energy.sum(axis=1, keepdims=True)
        energy = np.divide(energy, whole, out=np.full_like(energy, np.nan), where=whole > 0)
        return {f"fsd{i + 1}": energy[:, low - 1 : high].sum(axis=1, keepdims=True) for i, (low, high) in enumerate(zip(edges, edges[1:]))}

    return _ragged(df, keep, points, ", ".join(f"fsd{i + 1} double" for i in range(bands)), describe, 1)


def polygon_morphometry(df: DataFrame, keep: list[str], points: str = "points") -> DataFrame:
    """Area, perimeter, circularity 4πA/P², bounding box and extent of closed outlines."""

    def measures(p: Column) -> Column:
        def around(term):
            # Each vertex with its successor; the last one closes the ring.
            terms = F.transform(p, lambda v, i: term(v, F.get(p, (i + 1) % F.size(p))))
            return F.aggregate(terms, F.lit(0.0), lambda total, v: total + v)

        span = lambda c: F.array_max(F.transform(p, lambda v: v[c])) - F.array_min(F.transform(p, lambda v: v[c]))
        return F.struct(
            (F.abs(around(lambda v, w: v["x"] * w["y"] - w["x"] * v["y"])) / 2).alias("area"),
            around(lambda v, w: F.hypot(w["x"] - v["x"], w["y"] - v["y"])).alias("perimeter"),
            span("x").alias("width"), span("y").alias("height"),
        )

    measured = df.select(*keep, F.inline(F.transform(F.array(points), measures)))
    return measured.withColumns({
        "circularity": F.try_divide(4 * math.pi * F.col("area"), F.pow("perimeter", F.lit(2))),
        "extent": F.try_divide(F.col("area"), F.col("width") * F.col("height")),
    })


def rasterize(df: DataFrame, keep: list[str], value: str = "score", order: str = "object_id",
              points: str = "points") -> DataFrame:
    """Sparse pixels (keep…, px, py, value) of filled polygons; where objects overlap the one
    latest in ``order`` wins. Pixels without a row are background."""
    seen = visible_runs(outline_spans(df, keep, value, order, points), keep, value, order)
    return run_pixels(seen).select(*keep, "px", "py", value)


def crop(pixels: DataFrame, left: Column, top: Column, width: Column, height: Column) -> DataFrame:
    """Pixels of a region, in its own coordinates."""
    px, py = F.col("px") - left, F.col("py") - top
    inside = (px >= 0) & (px < width) & (py >= 0) & (py < height)
    return pixels.where(inside).withColumns({"px": px, "py": py})
