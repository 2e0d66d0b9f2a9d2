"""Points in boxes, joined through the leaves of a quadtree that follows the points.

The plane is cut into square cells; a cell with too many points is cut in four, again and again, down to
small ones, and what is still crowded there (points at one position) is dealt by a hash. Points have one
leaf, boxes have all that they reach, and the two meet by an equi-join whose keys hold a bounded number of
points, however unevenly these lie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = 512.0  # edge of an uncut cell
LEVELS = 5  # times that a cell may be cut: edges of 512 to 16
LEAF_ROWS = 20_000
MOST_CROWDED = 4096  # crowded cells of one size in a table of any size
MOST_SENT = 100_000  # cells that boxes reach, as a table sent to every task (some MB); more of them are joined by a shuffle


def _at(fine: Column, level: int, levels: int) -> Column:
    """Cell number on a level from that on the finest one."""
    return F.shiftright(fine, levels - level)


def _code(level: int | Column, cx: Column, cy: Column, edge: Column | int) -> Column:
    """A cell's number within its uncut cell: level and place."""
    return ((F.lit(level) * 64 + F.pmod(cx, F.lit(edge))) * 64 + F.pmod(cy, F.lit(edge))).cast("int")


def _codes(fx: Column, fy: Column, levels: int) -> list[Column]:
    return [_code(k, _at(fx, k, levels), _at(fy, k, levels), 1 << k) for k in range(levels + 1)]


def leaf_bound(points: DataFrame, keys: Sequence[str], leaf_rows: int) -> float | None:
    """How many points a leaf may hold: ``leaf_rows``, or a 4096th of all where that is more. None if no uncut cell
    (``_bx``, ``_by``) holds more, so that nothing needs to be cut. Two numbers reach the driver."""
    cells = points.groupBy(*keys, "_bx", "_by").agg(F.count(F.lit(1)).alias("_n"))
    most, total = cells.agg(F.max("_n"), F.sum("_n")).first()
    bound = max(float(leaf_rows), (total or 0) / MOST_CROWDED)
    return bound if (most or 0) > bound else None


def crowded_cells(points: DataFrame, keys: Sequence[str], levels: int, bound: float) -> DataFrame:
    """Per uncut cell (keys, _bx, _by) with more points than a leaf may hold: the codes of its crowded cells on all levels
    (``_cut``), and into how many parts a crowded cell of the finest level is dealt (``_parts``).

    ``points`` has the finest cells ``_fx`` and ``_fy``. With a bound from :func:`leaf_bound` there are at most 4096
    crowded cells on each level, and the table may be sent to every task.
    """
    keys = list(keys)
    fine = points.groupBy(*keys, "_fx", "_fy").agg(F.count(F.lit(1)).alias("_n"))
    cells = fine.withColumns({"_bx": _at(F.col("_fx"), 0, levels), "_by": _at(F.col("_fy"), 0, levels)})
    hot = cells.groupBy(*keys, "_bx", "_by").agg(F.sum("_n").alias("_all")).where(F.col("_all") > bound).drop("_all")
    inner = cells.join(F.broadcast(hot), [*keys, "_bx", "_by"], "left_semi")  # at most 4096 cells, as above
    codes = F.explode(F.array(*_codes(F.col("_fx"), F.col("_fy"), levels)))
    nodes = inner.select(*keys, "_bx", "_by", codes.alias("_code"), "_n").groupBy(*keys, "_bx", "_by", "_code").agg(F.sum("_n").alias("_n"))
    parts = F.struct(F.col("_code").alias("key"), F.ceil(F.col("_n") / bound).cast("int").alias("value"))
    return nodes.where(F.col("_n") > bound).groupBy(*keys, "_bx", "_by").agg(
        F.collect_list("_code").alias("_cut"), F.map_from_entries(F.collect_list(F.when(F.col("_code") >= levels * 4096, parts))).alias("_parts"))


def _leaf(codes: list[Column]) -> Column:
    """The first cell from above that is not crowded, or the finest."""
    choice = F.when(F.col("_cut").isNull(), codes[0])
    for code in codes[:-1]:
        choice = choice.when(~F.array_contains("_cut", code), code)
    return choice.otherwise(codes[-1])


def _parts(leaf: Column) -> Column:
    return F.coalesce(F.try_element_at("_parts", leaf), F.lit(1))


def _placed_points(points: DataFrame, tree: DataFrame, keys: list[str], levels: int, hashed: list[str]) -> DataFrame:
    codes = _codes(F.col("_fx"), F.col("_fy"), levels)
    based = points.withColumns({"_bx": _at(F.col("_fx"), 0, levels), "_by": _at(F.col("_fy"), 0, levels)})
    met = based.join(F.broadcast(tree), [*keys, "_bx", "_by"], "left").withColumn("_leaf", _leaf(codes))
    return met.withColumn("_part", F.pmod(F.xxhash64(*hashed), _parts(F.col("_leaf"))).cast("int")).drop("_cut", "_parts", "_fx", "_fy")


def _placed_boxes(boxes: DataFrame, tree: DataFrame, keys: list[str], levels: int, finest: float) -> DataFrame:
    """Each box once for every leaf (and part of one) that it reaches."""
    ends = {"_l": F.floor(F.col("left") / finest), "_r": F.floor(F.col("right") / finest), "_t": F.floor(F.col("top") / finest), "_b": F.floor(F.col("bottom") / finest)}
    edged = boxes.withColumns(ends)
    met = _uncut(edged, levels).join(F.broadcast(tree), [*keys, "_bx", "_by"], "left").withColumns({"_level": F.lit(0), "_x": F.col("_bx"), "_y": F.col("_by")})
    node = lambda level, x, y: F.struct(level.alias("_level"), x.cast("long").alias("_x"), y.cast("long").alias("_y"))
    for k in range(levels):
        inside = lambda c: (
            c["_x"].between(_at(F.col("_l"), k + 1, levels), _at(F.col("_r"), k + 1, levels)) & c["_y"].between(_at(F.col("_t"), k + 1, levels), _at(F.col("_b"), k + 1, levels)))  # noqa: B023
        quarters = F.filter(F.array(*[node(F.lit(k + 1), F.col("_x") * 2 + i, F.col("_y") * 2 + j) for i in (0, 1) for j in (0, 1)]), inside)
        cut = (F.col("_level") == k) & F.coalesce(F.array_contains("_cut", _code(k, F.col("_x"), F.col("_y"), 1 << k)), F.lit(False))
        here = F.array(node(F.col("_level"), F.col("_x"), F.col("_y")))
        met = met.select(*[c for c in met.columns if c not in ("_level", "_x", "_y")], F.inline(F.when(cut, quarters).otherwise(here)))
    edge = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))
    leafed = met.withColumn("_leaf", _code(F.col("_level"), F.col("_x"), F.col("_y"), edge))
    dealt = leafed.withColumn("_part", F.explode(F.sequence(F.lit(0), _parts(F.col("_leaf")) - 1)))
    return dealt.select(*boxes.columns, "_bx", "_by", "_leaf", "_part")


def _uncut(edged: DataFrame, levels: int) -> DataFrame:
    """Each box once for every uncut cell that it reaches; boxes without an extent or an edge have none."""
    whole = edged.where("_l <= _r AND _t <= _b")
    cells = lambda low, high: F.explode(F.sequence(_at(F.col(low), 0, levels), _at(F.col(high), 0, levels)))
    return whole.withColumn("_bx", cells("_l", "_r")).withColumn("_by", cells("_t", "_b"))


def points_in_boxes(boxes: DataFrame, points: DataFrame, keys: Sequence[str] = ("slide",), base: float = BASE, levels: int = LEVELS, leaf_rows: int = LEAF_ROWS,
                    reduced: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every (box, point) pair with equal ``keys`` and the point in the closed box ``left``/``top``/``right``/``bottom``.

    ``points`` has ``x`` and ``y``. Only points in uncut cells that a box reaches take part. The columns of both sides stay
    (those in ``keys`` once); the others must differ in name. Pairs with a null key, edge or position don't exist, nor do
    those with a box whose right or bottom lies before its left or top. Rows equal in all columns share a part of a leaf.
    Two numbers are looked up at once: how many cells the boxes reach, so that few of them can be sent to the points, and
    the fullest cell; without a crowded one the join is on uncut cells.
    ``reduced`` may thin out the points that take part (to one per position, say) before they are counted and joined.
    """
    keys = list(keys)
    if not 0 <= levels <= 5:
        raise ValueError("a cell may be cut five times at most")
    finest = base / (1 << levels)
    ends = {"_l": F.floor(F.col("left") / finest), "_r": F.floor(F.col("right") / finest), "_t": F.floor(F.col("top") / finest), "_b": F.floor(F.col("bottom") / finest)}
    reached = _uncut(boxes.withColumns(ends), levels).select(*keys, "_bx", "_by").distinct()
    if reached.limit(MOST_SENT + 1).count() <= MOST_SENT:
        reached = F.broadcast(reached)  # else all points would be shuffled to meet a few cells
    numbers = {"_fx": F.floor(F.col("x") / finest), "_fy": F.floor(F.col("y") / finest)}
    based = points.withColumns({"_bx": _at(numbers["_fx"], 0, levels), "_by": _at(numbers["_fy"], 0, levels)})
    near = based.join(reached, [*keys, "_bx", "_by"], "left_semi")
    inside = F.col("x").between(F.col("left"), F.col("right")) & F.col("y").between(F.col("top"), F.col("bottom"))
    bound = leaf_bound(near, keys, leaf_rows)
    if bound is None:
        left = near.drop("_bx", "_by")
        cells = {"_bx": _at(numbers["_fx"], 0, levels), "_by": _at(numbers["_fy"], 0, levels)}
        whole = (reduced(left) if reduced else left).withColumns(cells)
        found = _uncut(boxes.withColumns(ends), levels).drop(*ends).join(whole, [*keys, "_bx", "_by"])
        return found.where(inside).drop("_bx", "_by")
    near = near.drop("_bx", "_by")
    points = reduced(near) if reduced else near
    near = points.withColumns(numbers)
    tree = crowded_cells(near, keys, levels, bound)
    hashed = [f.name for f in points.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    placed = _placed_points(near, tree, keys, levels, hashed)
    found = _placed_boxes(boxes, tree, keys, levels, finest).join(placed, [*keys, "_bx", "_by", "_leaf", "_part"])
    return found.where(inside).drop("_bx", "_by", "_leaf", "_part")
