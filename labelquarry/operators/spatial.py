"""Viewport, nearest-object, region and tile queries.

Range joins go through cells that are cut where objects crowd: both sides get cells, cells are
joined on equality and the exact box test follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelquarry.functions.numbers import sign_class
from labelquarry.functions.text import position_decimal, position_key
from labelquarry.operators.quadtree import points_in_boxes
from labelquarry.operators.ranks import running_totals

# Search ranges around a click, padding of a region, tile edge (all pixels at 20x).
NUCLEUS_RANGE = 10
REGION_RANGE = 256
REGION_PADDING = 32
TILE_SIZE = 4096
DOUBLE_SCALE = 2


def in_box(x: Column, y: Column, left, top, right, bottom) -> Column:
    return x.between(F.lit(left), F.lit(right)) & y.between(F.lit(top), F.lit(bottom))


def viewport(objects: DataFrame, slide: str, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Objects of a slide with the position in the closed box; both filters reach the scan."""
    return objects.where((F.col("slide") == slide) & in_box(F.col("x"), F.col("y"), left, top, right, bottom))


def inflate_viewport(views: DataFrame) -> DataFrame:
    """Boxes grown by their own size on every side, left and top not below zero."""
    width, height = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    zero = F.lit(0.0)
    return views.select(
        *[c for c in views.columns if c not in ("left", "top", "right", "bottom")],
        F.greatest(F.col("left") - width, zero).alias("left"),
        F.greatest(F.col("top") - height, zero).alias("top"),
        (F.col("right") + width).alias("right"),
        (F.col("bottom") + height).alias("bottom"),
    )


def viewport_classes(objects: DataFrame, slide: str, left: float, top: float, right: float,
                     bottom: float) -> DataFrame:
    """Position key and class 0 / 1 of the scored objects in the box."""
    hit = viewport(objects, slide, left, top, right, bottom)
    return hit.select(
        position_key(F.col("x"), F.col("y")).alias("key"),
        F.when(sign_class(F.col("score")) == -1, F.lit(0)).otherwise(F.lit(1)).alias("class"),
    )


def slide_slice(objects: DataFrame, slide: str) -> DataFrame:
    return objects.where(F.col("slide") == slide)


def find_objects(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Objects at exact (slide, x, y) positions."""
    return objects.join(wanted.select("slide", "x", "y").distinct(), ["slide", "x", "y"], "left_semi")


def nearest_object(clicks: DataFrame, objects: DataFrame, reach: float = NUCLEUS_RANGE,
                   click_id: str = "click_id", object_id: str = "object_id") -> DataFrame:
    """The object nearest to each click, within a box of ± ``reach``; clicks without one are left out.

    Each distinct click position is answered once. Only objects in cells that a click reaches
    take part, and those that share a position are reduced to the smallest id; crowded cells are cut
    (:mod:`labelquarry.operators.quadtree`).
    """
    spots = clicks.select("slide", "x", "y").distinct().select(
        "slide", F.col("x").alias("click_x"), F.col("y").alias("click_y"),
        (F.col("x") - reach).alias("left"), (F.col("y") - reach).alias("top"), (F.col("x") + reach).alias("right"), (F.col("y") + reach).alias("bottom"),
    )

    def one_per_position(near: DataFrame) -> DataFrame:
        return near.groupBy("slide", "x", "y").agg(F.min(object_id).alias("_id"))

    pairs = points_in_boxes(spots, objects.select("slide", "x", "y", object_id), reduced=one_per_position)
    dx, dy = F.col("x") - F.col("click_x"), F.col("y") - F.col("click_y")
    near = (
        pairs.where((F.abs(dx) <= reach) & (F.abs(dy) <= reach))
        .groupBy("slide", "click_x", "click_y")
        .agg(F.min(F.struct((dx * dx + dy * dy).alias("dist"), "_id", "x", "y")).alias("_best"))
        .select(
            "slide", "click_x", "click_y",
            F.col("_best._id").alias(object_id), F.col("_best.x").alias("object_x"),
            F.col("_best.y").alias("object_y"), F.col("_best.dist").alias("dist"),
        )
    )
    keyed = clicks.select(click_id, "slide", F.col("x").alias("click_x"), F.col("y").alias("click_y"))
    return keyed.join(near, ["slide", "click_x", "click_y"])


def padded_region(rois: DataFrame, slides: DataFrame) -> DataFrame:
    """Region boxes with room for the patch size; it doubles on slides at double scale.

    A start moves only where it lies beyond the padding.
    """
    pad = F.when(F.col("scale") == DOUBLE_SCALE, F.lit(2 * REGION_PADDING)).otherwise(F.lit(REGION_PADDING))
    grown = lambda c: F.when(F.col(c) > pad, F.col(c) - pad).otherwise(F.col(c))
    sizes = slides.select(F.col("name").alias("slide"), "scale")
    return rois.join(sizes, "slide").select(
        *rois.columns,
        grown("start_x").alias("left"),
        grown("start_y").alias("top"),
        (F.col("start_x") + F.col("width") + pad).alias("right"),
        (F.col("start_y") + F.col("height") + pad).alias("bottom"),
    )


def known_regions(rois: DataFrame, objects: DataFrame) -> DataFrame:
    """Regions on slides the dataset has."""
    return rois.join(objects.select("slide").distinct(), "slide", "left_semi")


def roi_objects(rois: DataFrame, objects: DataFrame, cell: float = 512.0) -> DataFrame:
    """Every (region, object) pair with the object in the closed box left/top/right/bottom. Objects go by cells of this
    edge, which are cut where they are crowded."""
    return points_in_boxes(rois, objects, base=cell)


def tile_objects(objects: DataFrame, tile: int = TILE_SIZE, closed: bool = False) -> DataFrame:
    """Tile numbers of each object. ``closed`` tiles include both edges, so an object on an
    edge belongs to two tiles; otherwise each object has one. No shuffle."""
    def numbers(c):
        own = F.floor(F.col(c) / tile).cast("int")
        if not closed:
            return F.array(own)
        on_edge = (F.col(c) % tile == 0) & (own > 0)
        return F.when(on_edge, F.array(own - 1, own)).otherwise(F.array(own))

    return objects.withColumn("tile_x", F.explode(numbers("x"))).withColumn("tile_y", F.explode(numbers("y")))


def with_position_keys(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"centroid_x": position_decimal(F.col(x)), "centroid_y": position_decimal(F.col(y))})


def attach_boundaries(samples: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Id and polygon of the boundary at each sample's position; samples without one stay."""
    right = boundaries.select("slide", "centroid_x", "centroid_y", F.col("id").alias("boundary_id"), "boundary")
    return with_position_keys(samples).join(right, ["slide", "centroid_x", "centroid_y"], "left")


def boundary_by_id(wanted: DataFrame, boundaries: DataFrame) -> DataFrame:
    return wanted.join(boundaries.select("slide", "id", "boundary"), ["slide", "id"], "left")


def drawn_object_labels(objects: DataFrame, boundaries: DataFrame, tile: int = TILE_SIZE, key: str = "object_id") -> DataFrame:
    """Objects with a boundary at their position, once for each closed tile that holds them, numbered per slide from 1
    without gaps (``object_label``): by columns of tiles, then tiles, then id. Objects without a boundary have no number.

    Rows are placed by (tile, id) among all rows of their slide with :mod:`labelquarry.operators.ranks`, so a crowded tile
    or slide is spread over buckets. Several boundaries at a position count once; equal ids in a tile are numbered in any
    order. Rows with a null slide, position or id are left out.
    """
    known = boundaries.select("slide", "centroid_x", "centroid_y").distinct()
    drawn = with_position_keys(objects.where(F.col(key).isNotNull())).join(known, ["slide", "centroid_x", "centroid_y"], "left_semi").select(*objects.columns)
    rows = tile_objects(drawn, tile, closed=True).withColumn("_order", F.struct("tile_x", "tile_y", key))
    counts = rows.groupBy("slide", "_order").agg(F.count(F.lit(1)).alias("_n"))
    numbers = running_totals(counts, ["slide"], "_order", {"_upto": "_n"})
    among_equals = F.row_number().over(Window.partitionBy("slide", "_order").orderBy(key))
    return rows.join(numbers, ["slide", "_order"]).withColumn("object_label", F.col("_upto") - F.col("_n") + among_equals).drop("_order", "_upto", "_n")


def object_labels_by_tile(objects: DataFrame, tile: int = TILE_SIZE, key: str = "object_id") -> DataFrame:
    """Objects of each slide numbered from 1 in tile order (columns of tiles, then id).

    Tile counts place each tile; only the objects of one tile region are ordered together.
    """
    placed = tile_objects(objects, tile)
    # A tile may be crowded, so it is split further by the position inside it.
    part = (F.pmod(F.floor("x"), F.lit(tile)) / F.lit(max(1, tile // 64))).cast("int")
    placed = placed.withColumn("_part", part)
    order = ["tile_x", "tile_y", "_part"]
    before = Window.partitionBy("slide").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("slide", *order).agg(F.count(F.lit(1)).alias("_n")).select(
        "slide", *order, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("slide", *order).orderBy(key)
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, ["slide", *order])
        .withColumn("object_label", F.col("_before") + F.col("_rn"))
        .drop("_part", "_rn", "_before")
    )
