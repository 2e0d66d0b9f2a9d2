"""Outlines and pixels."""

from pyspark.sql import functions as F

from labelquarry.operators import geometry as g
from labelquarry.operators import pixels as px
from labelquarry.operators import runs
from workload import tables as t
from workload.registry import query
from workload.tables import PIXELS, VEC, outline_cte, with_ctes

NO_REPEATS = """
clean AS (
  SELECT object_id, x, y, row_number() OVER (PARTITION BY object_id ORDER BY pos) AS pos FROM (
    SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY object_id ORDER BY pos))
  WHERE nx IS NULL OR nx <> x OR ny <> y),
legs AS (
  SELECT *, x - lag(x) OVER w AS dx1, y - lag(y) OVER w AS dy1, lead(x) OVER w - x AS dx2, lead(y) OVER w - y AS dy2
  FROM clean WINDOW w AS (PARTITION BY object_id ORDER BY pos))"""
RENUMBERED = "SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY pos) - 1 AS INTEGER) AS pos, x, y FROM legs WHERE "


def _points(df):
    return df.select("object_id", F.posexplode("points")).select(
        "object_id", "pos", F.col("col.x").alias("x"), F.col("col.y").alias("y")
    )


@query("merge_colinear", with_ctes(RENUMBERED + """
dx1 IS NULL OR dx2 IS NULL OR dx1 * dy2 <> dy1 * dx2 OR (dx1 = 0 AND dx2 = 0 AND sign(dy1) = -sign(dy2))""", VEC, outline_cte(True), NO_REPEATS))
def merge_colinear(spark, d):
    return _points(g.merge_colinear(t.outlines(spark, d, whole=True)))


@query("remove_spurs", with_ctes(RENUMBERED + """
dx1 IS NULL OR dx2 IS NULL OR NOT ((dx1 = 0 AND dx2 = 0 AND sign(dy1) = -sign(dy2)) OR (dy1 = 0 AND dy2 = 0 AND sign(dx1) = -sign(dx2)))""",
    VEC, outline_cte(True), NO_REPEATS))
def remove_spurs(spark, d):
    return _points(g.remove_spurs(t.outlines(spark, d, whole=True)))


@query("duplicate_vertices", with_ctes("""
SELECT object_id, CAST(pos AS INTEGER) AS pos, x, y, CAST(n AS INTEGER) AS times FROM (
  SELECT *, count(*) OVER (PARTITION BY object_id, x, y) AS n FROM pts) WHERE n > 1""", VEC, outline_cte(True)))
def duplicate_vertices(spark, d):
    return g.duplicate_vertices(t.outlines(spark, d, whole=True), ["object_id"])


RESAMPLED = """
parts AS (
  SELECT object_id, pos, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY object_id ORDER BY pos)),
lengths AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM parts WHERE nx IS NOT NULL),
placed AS (
  SELECT *, coalesce(sum(share) OVER (PARTITION BY object_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT *, len / sum(len) OVER (PARTITION BY object_id) AS share FROM lengths)),
resampled AS (
  SELECT object_id, k, x + (nx - x) * ((k / CAST({steps} AS DOUBLE)) - start) / share AS x, y + (ny - y) * ((k / CAST({steps} AS DOUBLE)) - start) / share AS y
  FROM placed, range(0, {steps} + 1) r(k) WHERE start <= k / CAST({steps} AS DOUBLE)
  QUALIFY row_number() OVER (PARTITION BY object_id, k ORDER BY pos DESC) = 1)"""


@query("arc_length_resample", with_ctes("""
SELECT object_id, CAST(k AS INTEGER) AS k, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM resampled""",
    VEC, outline_cte(False), RESAMPLED.format(steps=64)))
def arc_length_resample(spark, d):
    rows = g.arc_length_resample(t.outlines(spark, d), 64, ["object_id"])
    return rows.withColumns({c: F.round(c, 6) + 0.0 for c in ("x", "y")})


@query("fourier_descriptors", with_ctes("""
SELECT object_id, """ + ", ".join(
    f"round(sum(e) FILTER (f BETWEEN {lo - 1} AND {hi - 1}) / sum(e), 6) AS fsd{i + 1}"
    for i, (lo, hi) in enumerate([(1, 2), (2, 4), (4, 8), (8, 16), (16, 32), (32, 64)])) + """
FROM spectrum GROUP BY object_id""", VEC, outline_cte(False), RESAMPLED.format(steps=128), """
angles AS (
  SELECT object_id, k, a - first_value(a) OVER (PARTITION BY object_id ORDER BY k) AS a FROM (
    SELECT object_id, k, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS a FROM resampled WINDOW w AS (PARTITION BY object_id ORDER BY k))
  WHERE k < 128),
spectrum AS (
  SELECT object_id, f, pow(sum(a * cos(2 * pi() * f * k / 128)), 2) + pow(sum(a * sin(2 * pi() * f * k / 128)), 2) AS e
  FROM angles, range(0, 128) r(f) GROUP BY object_id, f)"""))
def fourier_descriptors(spark, d):
    found = g.fourier_descriptors(t.outlines(spark, d), ["object_id"])
    return found.select("object_id", *[F.round(f"fsd{i}", 6).alias(f"fsd{i}") for i in range(1, 7)])


@query("polygon_morphometry", with_ctes("""
SELECT object_id, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(width, 6) AS width, round(height, 6) AS height,
       round(4 * pi() * area / pow(perimeter, 2), 6) AS circularity, round(area / (width * height), 6) AS extent
FROM (SELECT object_id, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))) AS perimeter,
             max(x) - min(x) AS width, max(y) - min(y) AS height
      FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
            FROM pts WINDOW w AS (PARTITION BY object_id ORDER BY pos)) GROUP BY object_id)""", VEC, outline_cte(False)))
def polygon_morphometry(spark, d):
    found = g.polygon_morphometry(t.outlines(spark, d), ["object_id"])
    return found.select("object_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "object_id"])


# Spans of the outlines around each object's position by scan line, and their pixels, where the last object wins.
FILLED = """
sides AS (
  SELECT *, coalesce(lead(x0) OVER w, first_value(x0) OVER w) AS x1, coalesce(lead(y0) OVER w, first_value(y0) OVER w) AS y1
  FROM (SELECT pts.slide, object_id, pos, CAST(trunc(pts.x * 4 + vec.x) AS BIGINT) AS x0, CAST(trunc(pts.y * 4 + vec.y) AS BIGINT) AS y0, vec.x / 1000 AS score
        FROM pts JOIN vec USING (object_id))
  WINDOW w AS (PARTITION BY object_id ORDER BY pos)),
scan AS (SELECT object_id, unnest(range(min(y0), max(y0) + 1)) AS y FROM sides GROUP BY object_id),
met AS (SELECT * FROM scan JOIN sides USING (object_id) WHERE y BETWEEN least(y0, y1) AND greatest(y0, y1)),
crossings AS (
  SELECT slide, object_id, score, y, place, lead(place) OVER w AS next, row_number() OVER w AS n
  FROM (SELECT *, x0 + (y - y0) * (x1 - x0) / CAST(y1 - y0 AS DOUBLE) AS place FROM met WHERE (y0 <= y) <> (y1 <= y))
  WINDOW w AS (PARTITION BY object_id, y ORDER BY place)),
half AS (
  SELECT slide, object_id, score, y,
         x0 + (least(greatest(y - 0.5::DOUBLE, least(y0, y1)), greatest(y0, y1)) - y0) * (x1 - x0) / CAST(y1 - y0 AS DOUBLE) AS a,
         x0 + (least(greatest(y + 0.5::DOUBLE, least(y0, y1)), greatest(y0, y1)) - y0) * (x1 - x0) / CAST(y1 - y0 AS DOUBLE) AS b
  FROM met WHERE y0 <> y1),
spans AS (
  SELECT slide, object_id, score, y, CAST(ceil(place) AS BIGINT) AS x0, CAST(floor(next) AS BIGINT) AS x1 FROM crossings WHERE n % 2 = 1
  UNION ALL SELECT slide, object_id, score, y, least(x0, x1), greatest(x0, x1) FROM met WHERE y0 = y1
  UNION ALL SELECT slide, object_id, score, y, CAST(floor(least(a, b) + 0.5) AS BIGINT), CAST(floor(greatest(a, b) + 0.5) AS BIGINT) FROM half),
seen AS (
  SELECT slide, y, x, max(object_id) AS object_id, arg_max(score, object_id) AS score
  FROM (SELECT slide, object_id, score, y, unnest(range(x0, x1 + 1)) AS x FROM spans WHERE x0 <= x1) GROUP BY ALL)"""
AREAS = """
areas AS (SELECT DISTINCT slide, start_x, 100 AS start_y, 200 AS width, 300 AS height FROM vec, (SELECT unnest([0, 300, 850, 1500]) AS start_x))"""


def _runs_sql(source, keys):
    return f"""
SELECT {keys}, y, min(x) AS x_from, max(x) AS x_to, object_id, score FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY {keys}, y ORDER BY x) AS run FROM (
    SELECT *, CASE WHEN object_id IS DISTINCT FROM lag(object_id) OVER w OR x <> lag(x) OVER w + 1 OR lag(x) OVER w IS NULL OR x % 4096 = 0 THEN 1 ELSE 0 END AS fresh
    FROM {source} WINDOW w AS (PARTITION BY {keys}, y ORDER BY x)))
GROUP BY {keys}, y, run, object_id, score"""


def _drawn(spark, d):
    return t.outlines(spark, d, whole=True).withColumn(
        "points",
        F.transform("points", lambda p: F.struct((p["x"] * 4 + F.col("x")).alias("x"), (p["y"] * 4 + F.col("y")).alias("y"))),
    ).withColumn("score", F.col("x") / 1000)


@query("raster_pixels", with_ctes(
    "SELECT slide, CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py, score FROM seen", VEC, outline_cte(True), FILLED))
def raster_pixels(spark, d):
    """Pixels of the whole-number outlines around each object's position."""
    return g.rasterize(_drawn(spark, d), ["slide"])


@query("outline_runs", with_ctes(_runs_sql("seen", "slide"), VEC, outline_cte(True), FILLED))
def outline_runs(spark, d):
    """The same pixels as runs."""
    return runs.visible_runs(runs.outline_spans(_drawn(spark, d), ["slide"]), ["slide"])


@query("region_mask_runs", with_ctes(_runs_sql("masked", "slide, start_x"), VEC, outline_cte(True), FILLED, AREAS, """
masked AS (
  SELECT g.slide, start_x, g.x, g.y, object_id, coalesce(score, 7.0) AS score
  FROM (SELECT *, unnest(range(width)) AS x FROM (SELECT *, unnest(range(height)) AS y FROM areas)) g
  LEFT JOIN seen s ON s.slide = g.slide AND s.x = g.x + g.start_x AND s.y = g.y + g.start_y)"""))
def region_mask_runs(spark, d):
    """Masks of regions with their background, in region coordinates."""
    drawn = _drawn(spark, d)
    start = F.explode(F.array(*[F.lit(x) for x in (0, 300, 850, 1500)]))
    areas = drawn.select("slide").distinct().select("slide", start.alias("start_x"), F.lit(100).alias("start_y"), F.lit(200).alias("width"), F.lit(300).alias("height"))
    met = drawn.select("slide", "object_id", "score", "points").join(areas, "slide")
    return runs.region_masks(met, areas, areas.columns).drop("start_y", "width", "height")


@query("area_filter", with_ctes("""
SELECT slide, object_id, count(*) AS area FROM pix WHERE value > 127 GROUP BY slide, object_id HAVING count(*) > 20 AND count(*) < 1000""", VEC, PIXELS))
def area_filter(spark, d):
    """Objects by the number of bright pixels."""
    return px.area_filter(t.pixels(spark, d).where("value > 127"), px.AREA_LIMITS_SECOND)


@query("object_intensity", with_ctes("""
SELECT slide, object_id, round(avg(value), 6) AS mean, round(avg(value) - median(value), 6) AS mean_median_difference, max(value) AS max, min(value) AS min,
       round(stddev_samp(value), 6) AS std FROM pix GROUP BY slide, object_id""", VEC, PIXELS))
def object_intensity(spark, d):
    found = px.object_intensity(t.pixels(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "mean_median_difference", "std")})


TEXTURE = """
texture AS (
  SELECT slide, object_id, -sum(p * log2(p)) AS entropy, sum(p * p) AS energy FROM (
    SELECT slide, object_id, n / CAST(sum(n) OVER (PARTITION BY slide, object_id) AS DOUBLE) AS p FROM (
      SELECT slide, object_id, least(greatest(round(value), 0), 255) AS level, count(*) AS n FROM {source} GROUP BY 1, 2, 3))
  GROUP BY slide, object_id),
moments AS (
  SELECT slide, object_id, avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4
  FROM (SELECT *, avg(value) OVER (PARTITION BY slide, object_id) AS m FROM {source}) GROUP BY slide, object_id)"""
TEXTURE_COLUMNS = """round(entropy, 6) AS entropy, round(energy, 6) AS energy, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / pow(m2, 2), 6) AS kurtosis"""


@query("object_texture", with_ctes(f"""
SELECT slide, object_id, {TEXTURE_COLUMNS} FROM texture JOIN moments USING (slide, object_id)""", VEC, PIXELS, TEXTURE.format(source="pix")))
def object_texture(spark, d):
    found = px.object_texture(t.pixels(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("entropy", "energy", "skewness", "kurtosis")})


@query("object_gradient", with_ctes(f"""
SELECT slide, object_id, round(mean, 6) AS mean, round(std, 6) AS std, {TEXTURE_COLUMNS}
FROM texture JOIN moments USING (slide, object_id)
JOIN (SELECT slide, object_id, avg(value) AS mean, stddev_samp(value) AS std FROM grad GROUP BY slide, object_id) USING (slide, object_id)""",
    VEC, PIXELS, """
grad AS (
  SELECT slide, object_id, sqrt(gx * gx + gy * gy) AS value FROM (
    SELECT slide, object_id, coalesce((rt - lt) / 2.0, rt - value, value - lt) AS gx, coalesce((dn - up) / 2.0, dn - value, value - up) AS gy FROM (
      SELECT *, lag(value) OVER h AS lt, lead(value) OVER h AS rt, lag(value) OVER v AS up, lead(value) OVER v AS dn FROM pix
      WINDOW h AS (PARTITION BY slide, object_id, py ORDER BY px), v AS (PARTITION BY slide, object_id, px ORDER BY py))))""",
    TEXTURE.format(source="grad")))
def object_gradient(spark, d):
    """Each object is an image of its own here."""
    found = px.object_gradient(t.pixels(spark, d), image=("slide", "object_id"))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std", "entropy", "energy", "skewness", "kurtosis")})


LAB = """
lab AS (
  SELECT slide, object_id, px, py, r, g, b, (l + m + s) / sqrt(3) AS lab_l, (l + m - 2 * s) / sqrt(6) AS lab_a, (l - m) / sqrt(2) AS lab_b,
         -0.154 * r + 0.035 * g + 0.549 * b - 45.718 < -0.057 * r - 0.817 * g + 1.170 * b - 49.887 AS front
  FROM (SELECT *, log10((0.3811 * r + 0.5783 * g + 0.0402 * b) / 255) AS l, log10((0.1967 * r + 0.7244 * g + 0.0782 * b) / 255) AS m,
               log10((0.0241 * r + 0.1288 * g + 0.8444 * b) / 255) AS s FROM pix)),
fronts AS (
  SELECT slide, avg(lab_l) AS mean_lab_l, avg(lab_a) AS mean_lab_a, avg(lab_b) AS mean_lab_b,
         stddev_samp(lab_l) AS std_lab_l, stddev_samp(lab_a) AS std_lab_a, stddev_samp(lab_b) AS std_lab_b
  FROM lab WHERE front GROUP BY slide)"""
LAB_NAMES = ("lab_l", "lab_a", "lab_b")


def _round_all(names):
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)


@query("rgb_to_lab", with_ctes(f"SELECT object_id, px, py, {_round_all(LAB_NAMES)} FROM lab", VEC, PIXELS, LAB))
def rgb_to_lab(spark, d):
    lab = px.rgb_to_lab(t.pixels(spark, d))
    return lab.select("object_id", "px", "py", *[(F.round(c, 6) + 0.0).alias(c) for c in LAB_NAMES])


@query("lab_round_trip", with_ctes("""
SELECT object_id, px, py, round(4.4687 * l - 3.5887 * m + 0.1196 * s, 9) + 0.0 AS r, round(-1.2197 * l + 2.3831 * m - 0.1626 * s, 9) + 0.0 AS g,
       round(0.0585 * l - 0.2611 * m + 1.2057 * s, 9) + 0.0 AS b
FROM (SELECT object_id, px, py, pow(10, lab_l / sqrt(3) + lab_a / sqrt(6) + lab_b / sqrt(2)) AS l, pow(10, lab_l / sqrt(3) + lab_a / sqrt(6) - lab_b / sqrt(2)) AS m,
             pow(10, lab_l / sqrt(3) - 2 * lab_a / sqrt(6)) AS s FROM lab)""", VEC, PIXELS, LAB))
def lab_round_trip(spark, d):
    back = px.lab_to_rgb(px.rgb_to_lab(t.pixels(spark, d)))
    return back.select("object_id", "px", "py", *[(F.round(c, 9) + 0.0).alias(c) for c in "rgb"])


@query("foreground_pixels", with_ctes("SELECT object_id, px, py FROM lab WHERE front", VEC, PIXELS, LAB))
def foreground_pixels(spark, d):
    return px.foreground(t.pixels(spark, d)).select("object_id", "px", "py")


STATS = [f"{k}_{c}" for k in ("mean", "std") for c in LAB_NAMES]


@query("color_stats", with_ctes(f"SELECT slide, {_round_all(STATS)} FROM fronts", VEC, PIXELS, LAB))
def color_stats(spark, d):
    return px.color_stats(t.pixels(spark, d)).select("slide", *[(F.round(c, 6) + 0.0).alias(c) for c in STATS])


@query("color_transfer", with_ctes("SELECT object_id, px, py, " + ", ".join(
    f"round(({c} - f.mean_{c}) * ((SELECT std_{c} FROM fronts WHERE slide = 'S0') / f.std_{c}) + (SELECT mean_{c} FROM fronts WHERE slide = 'S0'), 6) + 0.0 AS {c}"
    for c in LAB_NAMES) + " FROM lab JOIN fronts f USING (slide)", VEC, PIXELS, LAB))
def color_transfer(spark, d):
    """Every slide takes the colours of slide S0."""
    pixels = t.pixels(spark, d)
    own = px.color_stats(pixels)
    moved = px.transfer_colors(px.rgb_to_lab(pixels), own, own.where("slide = 'S0'"))
    return moved.select("object_id", "px", "py", *[(F.round(c, 6) + 0.0).alias(c) for c in LAB_NAMES])


def _unmix_sql():
    import numpy as np

    inverse = np.linalg.inv(px.stain_matrix())
    density = lambda c: f"(-(255.0 * ln(({c} + CAST({px.SINGLE_EPSILON!r} AS DOUBLE)) / 255.0)) / ln(255.0))"
    columns = []
    for i in range(2):
        mixed = " + ".join(f"CAST({float(inverse[i][j])!r} AS DOUBLE) * {density(c)}" for j, c in enumerate("rgb"))
        columns.append(f"round(exp(-(({mixed}) - 255.0) * ln(255.0) / 255.0), 4) AS stain{i + 1}")
    return f"SELECT object_id, px, py, {', '.join(columns)} FROM pix"


@query("stain_unmix", with_ctes(_unmix_sql(), VEC, PIXELS))
def stain_unmix(spark, d):
    mixed = px.unmix_stains(t.pixels(spark, d))
    return mixed.select("object_id", "px", "py", F.round("stain1", 4).alias("stain1"), F.round("stain2", 4).alias("stain2"))
