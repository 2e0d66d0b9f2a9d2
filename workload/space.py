"""Viewport, nearest-object, region, tile and boundary queries."""

from pyspark.sql import functions as F

from labelquarry.functions.text import polygon_points, position_key
from labelquarry.operators import spatial as sp
from workload import tables as t
from workload.registry import query
from workload.tables import BOUNDARIES, CLICKS, LABELED, OBJ, SLIDES, with_ctes

BOX = (200.0, 300.0, 900.0, 1500.0)
IN_BOX = "x BETWEEN 200 AND 900 AND y BETWEEN 300 AND 1500"


@query("viewport_objects", with_ctes(
    f"SELECT object_id, x, y, score FROM obj WHERE slide = 'S7' AND {IN_BOX}", OBJ))
def viewport_objects(spark, d):
    return sp.viewport(t.objects(spark, d), "S7", *BOX).select("object_id", "x", "y", "score")


@query("viewport_inflated", """
SELECT event_id, greatest(l - (r - l), 0) AS "left", greatest(tp - (b - tp), 0) AS top, r + (r - l) AS "right", b + (b - tp) AS bottom
FROM (SELECT event_id, value AS l, value * 2 AS tp, value + 100 AS r, value * 2 + 80 AS b FROM events)""")
def viewport_inflated(spark, d):
    v = F.col("value")
    views = t.read(spark, d, "events").select(
        "event_id", v.alias("left"), (v * 2).alias("top"), (v + 100).alias("right"), (v * 2 + 80).alias("bottom")
    )
    return sp.inflate_viewport(views)


@query("viewport_classes", with_ctes(f"""
SELECT printf('%.1f_%.1f', x, y) AS key, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS class
FROM obj WHERE slide = 'S7' AND {IN_BOX}""", OBJ))
def viewport_classes(spark, d):
    return sp.viewport_classes(t.objects(spark, d), "S7", *BOX)


@query("slide_slice", with_ctes("SELECT object_id, x, y, score FROM obj WHERE slide = 'S7'", OBJ))
def slide_slice(spark, d):
    return sp.slide_slice(t.objects(spark, d), "S7").select("object_id", "x", "y", "score")


@query("find_object", with_ctes("""
SELECT object_id, slide, x, y FROM obj o WHERE EXISTS (SELECT 1 FROM labeled l WHERE l.slide = o.slide AND l.x = o.x AND l.y = o.y)""",
    OBJ, LABELED))
def find_object(spark, d):
    return sp.find_objects(t.objects(spark, d), t.labeled(spark, d)).select("object_id", "slide", "x", "y")


@query("object_key", with_ctes("SELECT object_id, printf('%.1f_%.1f', x, y) AS key FROM obj", OBJ))
def object_key(spark, d):
    return t.objects(spark, d).select("object_id", position_key(F.col("x"), F.col("y")).alias("key"))


def _nearest_sql(reach):
    return with_ctes(f"""
SELECT click_id, slide, object_id, dist, x_size, y_size, scale FROM (
  SELECT click_id, c.slide, object_id, pow(o.x - c.x, 2) + pow(o.y - c.y, 2) AS dist,
         row_number() OVER (PARTITION BY click_id ORDER BY pow(o.x - c.x, 2) + pow(o.y - c.y, 2), object_id) AS rn
  FROM clicks c JOIN obj o ON o.slide = c.slide AND abs(o.x - c.x) <= {reach} AND abs(o.y - c.y) <= {reach})
LEFT JOIN slides ON slides.name = slide
WHERE rn = 1""", OBJ, CLICKS, SLIDES)


def _nearest(spark, d, reach):
    hits = sp.nearest_object(t.clicks(spark, d), t.objects(spark, d), reach)
    sizes = t.slides(spark, d).select(F.col("name").alias("slide"), "x_size", "y_size", "scale")
    return hits.join(sizes, "slide", "left").select("click_id", "slide", "object_id", "dist", "x_size", "y_size", "scale")


@query("nearest_object", _nearest_sql(10))
def nearest_object(spark, d):
    return _nearest(spark, d, sp.NUCLEUS_RANGE)


@query("nearest_region", _nearest_sql(256))
def nearest_region(spark, d):
    return _nearest(spark, d, sp.REGION_RANGE)


# Regions of interest: one per training-set row (nation), on the slide of that number.
ROIS = """
rois AS (SELECT 'S' || s_suppkey AS slide, s_nationkey * 40 AS start_x, s_nationkey * 20 AS start_y, 400 AS width, 300 AS height FROM supplier),
boxes AS (
  SELECT r.*, CASE WHEN start_x > pad THEN start_x - pad ELSE start_x END AS l, CASE WHEN start_y > pad THEN start_y - pad ELSE start_y END AS tp,
         start_x + width + pad AS r, start_y + height + pad AS b
  FROM (SELECT rois.*, CASE WHEN scale = 2 THEN 64 ELSE 32 END AS pad FROM rois JOIN slides ON slides.name = rois.slide) r)"""


def _rois(spark, d):
    return t.read(spark, d, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("slide"),
        (F.col("s_nationkey") * 40).alias("start_x"), (F.col("s_nationkey") * 20).alias("start_y"),
        F.lit(400).alias("width"), F.lit(300).alias("height"),
    )


@query("roi_objects", with_ctes("""
SELECT b.slide, start_x, start_y, object_id, x, y, score, bd.id AS boundary_id, bd.boundary
FROM boxes b JOIN obj o ON o.slide = b.slide AND x BETWEEN b.l AND b.r AND y BETWEEN b.tp AND b.b
LEFT JOIN boundaries bd ON bd.slide = o.slide AND bd.cx = o.x AND bd.cy = o.y""", OBJ, SLIDES, ROIS, BOUNDARIES))
def roi_objects(spark, d):
    boxes = sp.padded_region(_rois(spark, d), t.slides(spark, d))
    inside = sp.roi_objects(boxes, t.objects(spark, d)).select("slide", "start_x", "start_y", "object_id", "x", "y", "score")
    return sp.attach_boundaries(inside, t.boundaries(spark, d)).drop("centroid_x", "centroid_y")


@query("roi_known_slides", with_ctes(
    "SELECT slide, start_x, start_y FROM rois WHERE slide IN (SELECT slide FROM obj)", OBJ, SLIDES, ROIS))
def roi_known_slides(spark, d):
    return sp.known_regions(_rois(spark, d), t.objects(spark, d)).select("slide", "start_x", "start_y")


@query("tile_objects", with_ctes("""
SELECT object_id, CAST(floor(x / 400) AS INTEGER) AS tile_x, CAST(floor(y / 400) AS INTEGER) AS tile_y FROM obj""", OBJ))
def tile_objects(spark, d):
    return sp.tile_objects(t.objects(spark, d), 400).select("object_id", "tile_x", "tile_y")


@query("tile_objects_closed", with_ctes("""
SELECT object_id, CAST(tx AS INTEGER) AS tile_x, CAST(ty AS INTEGER) AS tile_y
FROM obj, LATERAL (SELECT unnest(range(0, CAST(floor(x / 400) AS BIGINT) + 1)) AS tx) a,
     LATERAL (SELECT unnest(range(0, CAST(floor(y / 400) AS BIGINT) + 1)) AS ty) b
WHERE x BETWEEN tx * 400 AND tx * 400 + 400 AND y BETWEEN ty * 400 AND ty * 400 + 400""", OBJ))
def tile_objects_closed(spark, d):
    return sp.tile_objects(t.objects(spark, d), 400, closed=True).select("object_id", "tile_x", "tile_y")


@query("label_export", with_ctes("""
SELECT slide, object_id, x, y, score, row_number() OVER (
  PARTITION BY slide ORDER BY floor(x / 400), floor(y / 400), floor((x % 400) / 6), object_id) AS object_label
FROM obj""", OBJ))
def label_export(spark, d):
    return sp.object_labels_by_tile(t.objects(spark, d), 400).select("slide", "object_id", "x", "y", "score", "object_label")


@query("drawn_labels", with_ctes("""
SELECT slide, object_id, x, y, score, tile_x, tile_y, row_number() OVER (PARTITION BY slide ORDER BY tile_x, tile_y, object_id) AS object_label
FROM (SELECT *, CAST(unnest(CASE WHEN y % 400 = 0 AND y > 0 THEN [floor(y / 400) - 1, floor(y / 400)] ELSE [floor(y / 400)] END) AS INTEGER) AS tile_y
      FROM (SELECT *, CAST(unnest(CASE WHEN x % 400 = 0 AND x > 0 THEN [floor(x / 400) - 1, floor(x / 400)] ELSE [floor(x / 400)] END) AS INTEGER) AS tile_x
            FROM obj o WHERE EXISTS (SELECT 1 FROM boundaries bd WHERE bd.slide = o.slide AND bd.cx = o.x AND bd.cy = o.y AND (bd.cx + bd.cy) % 3 > 0)))""", OBJ, BOUNDARIES))
def drawn_labels(spark, d):
    """Numbers of the objects that have a boundary, over closed tiles."""
    return sp.drawn_object_labels(t.objects(spark, d), t.boundaries(spark, d).where("(centroid_x + centroid_y) % 3 > 0"), 400).select(
        "slide", "object_id", "x", "y", "score", "tile_x", "tile_y", "object_label")


@query("samples_with_boundary", with_ctes("""
SELECT object_id, l.slide, label, bd.id AS boundary_id, bd.boundary
FROM labeled l LEFT JOIN boundaries bd ON bd.slide = l.slide AND bd.cx = l.x AND bd.cy = l.y""", OBJ, LABELED, BOUNDARIES))
def samples_with_boundary(spark, d):
    joined = sp.attach_boundaries(t.labeled(spark, d), t.boundaries(spark, d))
    return joined.select("object_id", "slide", "label", "boundary_id", "boundary")


@query("boundary_by_id", with_ctes("""
SELECT l.slide, l.object_id AS id, bd.boundary FROM labeled l LEFT JOIN boundaries bd ON bd.slide = l.slide AND bd.id = l.object_id""",
    OBJ, LABELED, BOUNDARIES))
def boundary_by_id(spark, d):
    wanted = t.labeled(spark, d).select("slide", F.col("object_id").alias("id"))
    return sp.boundary_by_id(wanted, t.boundaries(spark, d))


@query("scan_boundaries", with_ctes(
    "SELECT slide, id, CAST(cx AS DOUBLE) AS centroid_x, CAST(cy AS DOUBLE) AS centroid_y, boundary FROM boundaries", OBJ, BOUNDARIES))
def scan_boundaries(spark, d):
    return t.boundaries(spark, d).withColumns(
        {c: F.col(c).cast("double") for c in ("centroid_x", "centroid_y")}
    )


@query("polygon_points", with_ctes("""
SELECT id, CAST(i AS INTEGER) AS pos, CAST(split_part(split_part(boundary, ' ', CAST(i + 1 AS INTEGER)), ',', 1) AS DOUBLE) AS x,
       CAST(split_part(split_part(boundary, ' ', CAST(i + 1 AS INTEGER)), ',', 2) AS DOUBLE) AS y
FROM boundaries, range(0, 4) r(i)""", OBJ, BOUNDARIES))
def polygon_points_query(spark, d):
    parsed = t.boundaries(spark, d).select("id", F.posexplode(polygon_points(F.col("boundary"))))
    return parsed.select("id", "pos", F.col("col.x").alias("x"), F.col("col.y").alias("y"))
