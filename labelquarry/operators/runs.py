"""Filled outlines as runs of pixels in a row.

An outline becomes a few spans per scan line, inside its own row and clipped to a region before anything
is shuffled. Spans that lie over each other are painted into visible runs, where the last object wins.
Pixels are unrolled from runs only on demand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelquarry.functions.numbers import bind

# Fixed value: what a mask shows where no object lies.
BACKGROUND = 7.0
STRETCH = 4096  # pixels of a row that are painted together; runs end there
NO_OBJECT = -(2**63)

Box = tuple[Column, Column, Column, Column]


def _edges(points: Column) -> Column:
    """Sides of the outline, its vertices cut to whole numbers (towards zero)."""
    whole = F.transform(points, lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y")))
    return bind(whole, lambda w: F.zip_with(
        w, F.concat(F.slice(w, 2, F.size(w)), F.slice(w, 1, 1)),
        lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))))


def _x_at(e: Column, y: Column) -> Column:
    return e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"]).cast("double")


def _span(low: Column, high: Column) -> Column:
    return F.struct(low.cast("long").alias("x0"), high.cast("long").alias("x1"))


def _inner(edges: Column, y: Column) -> Column:
    """Pixels between odd and even crossings of a scan line."""
    crossed = F.filter(edges, lambda e: (e["y0"] <= y) != (e["y1"] <= y))
    places = F.array_sort(F.transform(crossed, lambda e: _x_at(e, y)))
    pairs = lambda at: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(at)), lambda i: (i % 2 == 0) & (i < F.size(at))),
        lambda i: _span(F.ceil(F.get(at, i)), F.floor(F.get(at, i + 1))))
    return bind(places, pairs)


def _outline(edges: Column, y: Column) -> Column:
    """Pixels of the sides: of each one what lies within half a row of the scan line, its ends rounded."""
    met = F.filter(edges, lambda e: (y >= F.least(e["y0"], e["y1"])) & (y <= F.greatest(e["y0"], e["y1"])))

    def one(e: Column) -> Column:
        end = lambda d: _x_at(e, F.least(F.greatest(y + d, F.least(e["y0"], e["y1"]).cast("double")), F.greatest(e["y0"], e["y1"]).cast("double")))
        ends = lambda a, b: _span(F.floor(F.least(a, b) + 0.5), F.floor(F.greatest(a, b) + 0.5))
        return F.when(e["y0"] == e["y1"], _span(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"]))).otherwise(ends(end(F.lit(-0.5)), end(F.lit(0.5))))

    return F.transform(met, one)


def _joined(spans: Column) -> Column:
    """Ordered spans without those that touch or lie over each other."""
    none = F.lit([]).cast("array<struct<x0: bigint, x1: bigint>>")

    def add(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(_span(last["x0"], F.greatest(last["x1"], s["x1"]))))
        return F.when((F.size(out) > 0) & (s["x0"] <= last["x1"] + 1), longer).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, add)


def outline_spans(df: DataFrame, keep: Sequence[str], value: str = "score", order: str = "object_id", points: str = "points", box: Box | None = None) -> DataFrame:
    """Rows (keep…, value, order, y, x0, x1): the runs of pixels that each outline fills, without a shuffle.

    Vertices are cut to whole numbers; a pixel is filled if it lies inside (even–odd rule) or on a side. ``box`` (left,
    top, width, height) clips to a region, in whose coordinates the runs then are: rows outside are not worked out. Null
    and empty outlines have no runs; one point fills one pixel.
    """
    left, top, width, height = box or (None,) * 4

    def of(edges: Column) -> Column:
        ends = F.flatten(F.transform(edges, lambda e: F.array(e["y0"], e["y1"])))
        low, high = F.array_min(ends), F.array_max(ends)
        if box:
            low, high = F.greatest(low, top.cast("long")), F.least(high, (top + height - 1).cast("long"))
        return F.when(low <= high, F.flatten(F.transform(F.sequence(low, high), lambda y: line(edges, y))))

    def line(edges: Column, y: Column) -> Column:
        spans = F.filter(F.concat(_inner(edges, y), _outline(edges, y)), lambda s: s["x0"] <= s["x1"])
        if box:
            spans = F.transform(spans, lambda s: _span(F.greatest(s["x0"], left), F.least(s["x1"], left + width - 1)))
            spans = F.filter(spans, lambda s: s["x0"] <= s["x1"])
        dx, dy = (left.cast("long"), top.cast("long")) if box else (F.lit(0), F.lit(0))
        return F.transform(_joined(spans), lambda s: F.struct((y - dy).alias("y"), (s["x0"] - dx).alias("x0"), (s["x1"] - dx).alias("x1")))

    if not isinstance(df.schema[order].dataType, T.IntegralType):
        raise TypeError(f"{order} must be a whole number")
    return df.select(*keep, value, F.col(order).cast("long").alias(order), F.inline(bind(_edges(F.col(points)), of)))


class _Painter:
    """The row stretch that is being painted, and the runs of those that are done."""

    def __init__(self) -> None:
        self.object = np.empty(STRETCH, np.int64)
        self.value = np.empty(STRETCH)
        self.low, self.high = STRETCH, -1
        self.out: list[tuple[int, int, int, int, float]] = []

    def paint(self, x0: int, x1: int, who: int, value: float) -> None:
        if self.high < 0:
            self.object[:] = NO_OBJECT
        self.object[x0 : x1 + 1] = who
        self.value[x0 : x1 + 1] = value
        self.low, self.high = min(self.low, x0), max(self.high, x1)

    def close(self, row: int) -> None:
        """``row``: any input row of the stretch, which has its keys."""
        if self.high >= 0:
            held = self.object[self.low : self.high + 1]
            at = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
            for start, end in zip(at.tolist(), [*at[1:].tolist(), len(held)], strict=True):
                if held[start] != NO_OBJECT:
                    self.out.append((row, self.low + start, self.low + end - 1, int(held[start]), float(self.value[self.low + start])))
        self.low, self.high = STRETCH, -1


def visible_runs(spans: DataFrame, keep: Sequence[str], value: str = "score", order: str = "object_id") -> DataFrame:
    """Rows (keep…, y, x_from, x_to, order, value): what is seen of spans that lie over each other.

    The span latest in ``order`` (a whole number) wins, and of equal ones the larger value. A stretch of one row is painted
    at a time, in a buffer of fixed size, from spans in order; so a crowded row needs no more memory, and a region is dealt
    over its rows. A run is as long as one object is seen, but ends at multiples of 4096. Spans without order or value are
    left out.
    """
    keep = list(keep)
    first = F.floor(F.col("x0") / STRETCH).cast("long")
    pieces = spans.where(F.col(order).isNotNull() & F.col(value).isNotNull()).select(
        *keep, F.col("y").cast("long").alias("y"), F.explode(F.sequence(first, F.floor(F.col("x1") / STRETCH).cast("long"))).alias("_at"),
        F.col(order).cast("long").alias("_who"), F.col(value).cast("double").alias("_value"), "x0", "x1")
    inside = pieces.select(
        *keep, "y", "_at", "_who", "_value", F.greatest(F.col("x0") - F.col("_at") * STRETCH, F.lit(0)).cast("int").alias("_x0"),
        F.least(F.col("x1") - F.col("_at") * STRETCH, F.lit(STRETCH - 1)).cast("int").alias("_x1"))
    group = [*keep, "y", "_at"]
    ordered = inside.repartition(*group).sortWithinPartitions(*group, "_who", "_value")
    schema = T.StructType([*[spans.schema[k] for k in keep], *T._parse_datatype_string("y long, x_from long, x_to long, _who long, _value double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        painter, last = _Painter(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last row of the batch before goes first: its stretch may go on, and if not, its keys end it.
            table = pa.Table.from_batches([batch]) if last is None else pa.concat_tables([last, pa.Table.from_batches([batch])])
            begun = 0 if last is None else 1
            new = np.zeros(table.num_rows, bool)
            for name in group:
                column = table.column(name).combine_chunks()
                a, b = column[1:], column[:-1]
                differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
                new[1:] |= differ
            columns = [table.column(c).to_numpy().tolist() for c in ("_x0", "_x1", "_who", "_value")]
            for i, (x0, x1, who, shown) in enumerate(zip(*columns, strict=True)):
                if i < begun:
                    continue
                if new[i]:
                    painter.close(i - 1)
                painter.paint(x0, x1, who, shown)
            yield from finished(painter, table)
            last = table.slice(table.num_rows - 1, 1)
        if last is not None:
            painter.close(0)
            yield from finished(painter, last)

    def finished(painter: _Painter, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if painter.out:
            rows, x0, x1, who, shown = zip(*painter.out, strict=True)
            keys = table.take(pa.array(rows))
            start = np.array(keys.column("_at").to_numpy()) * STRETCH
            arrays = [*[keys.column(k).combine_chunks() for k in keep], keys.column("y").combine_chunks(), pa.array(start + np.array(x0)), pa.array(start + np.array(x1)),
                      pa.array(who, pa.int64()), pa.array(shown, pa.float64())]
            painter.out = []
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return ordered.mapInArrow(run, schema).withColumnsRenamed({"_who": order, "_value": value})


def run_pixels(runs: DataFrame) -> DataFrame:
    """One row per pixel (``px``, ``py``) of the runs, without a shuffle."""
    others = [c for c in runs.columns if c not in ("y", "x_from", "x_to")]
    return runs.select(*others, F.explode(F.sequence(F.col("x_from").cast("int"), F.col("x_to").cast("int"))).alias("px"), F.col("y").cast("int").alias("py"))


def region_masks(drawn: DataFrame, regions: DataFrame, region: Sequence[str], value: str = "score", order: str = "object_id", points: str = "points",
                 background: float | None = BACKGROUND) -> DataFrame:
    """Visible runs of each region, in its coordinates.

    ``drawn`` has a row for each outline and region that may meet, with the columns named in ``region``, of which
    ``start_x``, ``start_y``, ``width`` and ``height`` give the box. With ``background`` the runs of a region cover all its
    pixels, also those of regions without an object; runs of background have a null ``order``.
    """
    box = F.col("start_x"), F.col("start_y"), F.col("width"), F.col("height")
    spans = outline_spans(drawn, region, value, order, points, box)
    if background is not None:
        ground = regions.where("width > 0 AND height > 0").select(*region).distinct().select(
            *region, F.lit(float(background)).cast(drawn.schema[value].dataType).alias(value), F.lit(NO_OBJECT + 1).alias(order),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)).alias("y"), F.lit(0).cast("long").alias("x0"), (F.col("width") - 1).cast("long").alias("x1"))
        spans = spans.unionByName(ground)
    runs = visible_runs(spans, region, value, order)
    return runs.withColumn(order, F.when(F.col(order) != NO_OBJECT + 1, F.col(order)))


def tile_masks(drawn: DataFrame, tile: int, value: str = "score", order: str = "object_id", points: str = "points", background: float | None = BACKGROUND) -> DataFrame:
    """Visible runs of each square tile (``slide``, ``tile_x``, ``tile_y``) that an outline's bounding box meets.

    An outline is drawn in every tile that it reaches.
    """
    def numbers(axis: str) -> Column:
        at = lambda end: F.floor(end(F.transform(points, lambda p: p[axis].cast("long"))) / tile).cast("long")
        return F.explode(F.sequence(at(F.array_min), at(F.array_max)))

    met = drawn.where(F.size(points) > 0).select("slide", value, order, points, numbers("x").alias("tile_x")).select("*", numbers("y").alias("tile_y"))
    boxed = met.withColumns({
        "start_x": F.col("tile_x") * tile, "start_y": F.col("tile_y") * tile, "width": F.lit(tile), "height": F.lit(tile)})
    region = ["slide", "tile_x", "tile_y", "start_x", "start_y", "width", "height"]
    return region_masks(boxed, boxed, region, value, order, points, background).drop("start_x", "start_y", "width", "height")
