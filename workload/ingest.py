"""Reading, parsing, validating and normalising object rows."""

from pyspark.sql import functions as F

from labelquarry.functions.numbers import unzscore
from labelquarry.functions.text import compact_polygon, polygon_points, polygon_text
from labelquarry.operators import features as f
from labelquarry.operators.ranks import single_row
from labelquarry.session import scratch_path
from labelquarry.sinks.tables import boundary_lines, segmentation_lines
from labelquarry.sources.quarantine import check_segmentation, quarantine
from labelquarry.sources.segmentation import parse_segmentation
from labelquarry.sources.tables import decode_label_batch, json_columns_to_rows, with_schema
from labelquarry.schemas import LABELED as LABELED_SCHEMA
from labelquarry.schemas import OBJECTS as OBJECTS_SCHEMA
from workload import tables as t
from workload.registry import query
from workload.tables import LABELED, OBJ, SUBMISSIONS, VEC, VEC_LONG, outline_cte, with_ctes


@query("scan_objects", with_ctes("""
SELECT object_id, slide, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(len(features) AS INTEGER) AS dims, features[64] AS last_feature FROM vec""", VEC))
def scan_objects(spark, d):
    loaded = with_schema(t.vectors(spark, d), OBJECTS_SCHEMA)
    return loaded.select(
        "object_id", "slide", "x", "y", F.size("features").alias("dims"), F.element_at("features", -1).alias("last_feature")
    )


@query("scan_labeled", with_ctes("""
SELECT object_id, slide, CAST(x AS FLOAT) AS x, label, CAST(NULL AS INTEGER) AS iteration, CAST(NULL AS FLOAT) AS click_x FROM vec""", VEC))
def scan_labeled(spark, d):
    loaded = with_schema(t.vectors(spark, d), LABELED_SCHEMA)
    return loaded.select("object_id", "slide", "x", "label", "iteration", "click_x")


def _raw_lines(spark, d):
    """Segmentation text of the vectors: even ids scanned at 40x, label 9 with a broken feature."""
    v = t.outlines(spark, d, whole=True).select("object_id", "points").join(t.vectors(spark, d), "object_id")
    numbers = F.transform("features", lambda e: e.cast("double").cast("string"))
    broken = F.when(F.col("slide") == "S9", F.lit("-nan")).when(F.col("slide") == "S8", F.lit("inf")).otherwise(F.lit("0.5"))
    return v.select(
        "object_id",
        F.concat_ws(
            "\t", F.concat("slide", F.lit(".svs")), F.col("x").cast("string"), F.col("y").cast("string"),
            F.when(F.col("object_id") % 2 == 0, "40.0").otherwise("20.0"), F.lit("20.0"),
            F.array_join(numbers, "\t"), broken, polygon_text(F.col("points")),
        ).alias("value"),
    )


@query("parse_segmentation", with_ctes("""
SELECT object_id, slide || '.svs' AS slide, x, y, CASE WHEN object_id % 2 = 0 THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS scan_mag,
       65 AS dims, CAST(features[1] AS DOUBLE) AS first_feature, 32 AS vertices, (SELECT sum(p.x) FROM pts p WHERE p.object_id = vec.object_id) AS vertex_x_sum
FROM vec""", VEC, outline_cte(True)))
def parse_segmentation_query(spark, d):
    rows = parse_segmentation(_raw_lines(spark, d), keep=("object_id",))
    return rows.select(
        "object_id", "slide", "x", "y", "scan_mag", F.size("features").alias("dims"),
        F.get("features", 0).alias("first_feature"), F.size("boundary").alias("vertices"),
        F.aggregate("boundary", F.lit(0.0), lambda a, p: a + p["x"]).alias("vertex_x_sum"),
    )


@query("reject_nonfinite", with_ctes("SELECT object_id FROM vec WHERE slide NOT IN ('S8', 'S9')", VEC))
def reject_nonfinite(spark, d):
    rows = parse_segmentation(_raw_lines(spark, d), keep=("object_id",))
    return f.reject_nonfinite(rows).select("object_id")


@query("ingest_rejects", with_ctes("""
SELECT slide || '.svs' AS slide, CASE WHEN slide IN ('S8', 'S9') THEN 0 ELSE count(*) END AS kept,
       CASE WHEN slide IN ('S8', 'S9') THEN count(*) ELSE 0 END AS rejected FROM vec GROUP BY slide""", VEC))
def ingest_rejects(spark, d):
    return f.ingest_rejects(parse_segmentation(_raw_lines(spark, d)), ["slide"])


# Every eleventh line is spoilt in one of six ways, or is a header.
SPOILT = """
spoilt AS (
  SELECT *, object_id % 11 AS way FROM vec)"""


def _spoilt_lines(spark, d):
    field = lambda n, text: F.concat_ws("\t", F.transform("_f", lambda f, i: F.when(i == n, F.lit(text)).otherwise(f)))
    way = F.col("object_id") % 11
    lines = _raw_lines(spark, d).withColumn("_f", F.split("value", "\t"))
    last = F.size("_f") - 1
    value = (
        F.when(way == 0, field(1, "12,5")).when(way == 1, field(2, "-nan")).when(way == 2, F.concat_ws("\t", F.slice("_f", 1, 4)))
        .when(way == 3, field(3, "")).when(way == 4, F.concat_ws("\t", F.filter("_f", lambda f, i: i != 7))).when(way == 5, field(last, "1.0,2.0;3.0;"))
        .when(way == 6, F.lit("Slide\tX\tY\tScan\tAnalysis\tf1\tBoundaries")).otherwise(F.col("value"))
    )
    return lines.select("object_id", value.alias("value"))


@query("quarantined_rows", with_ctes("""
SELECT object_id, CASE way WHEN 0 THEN 'coordinate' WHEN 1 THEN 'coordinate' WHEN 2 THEN 'fields' WHEN 3 THEN 'magnification' WHEN 4 THEN 'length'
       ELSE CASE WHEN slide IN ('S8', 'S9') THEN 'feature' WHEN way = 5 THEN 'vertex' END END AS reason
FROM spoilt WHERE way < 6 AND way <> 6 OR way > 6 AND slide IN ('S8', 'S9')""", VEC, SPOILT))
def quarantined_rows(spark, d):
    """Rejected lines and why, read back from the quarantine."""
    checked = check_segmentation(_spoilt_lines(spark, d), dims=65, keep=("object_id",))
    _, rejected, _ = quarantine(checked, scratch_path(spark, "quarantine"))
    return rejected.select("object_id", "reason")


@query("quarantine_counts", with_ctes("""
SELECT what, CAST(n AS BIGINT) AS n FROM (
  SELECT count(*) FILTER (way <> 6) AS rows, count(*) FILTER (way > 6 AND slide NOT IN ('S8', 'S9')) AS good, count(*) FILTER (way IN (0, 1)) AS coordinate,
         count(*) FILTER (way = 2) AS fields, count(*) FILTER (way = 3) AS magnification, count(*) FILTER (way = 4) AS length,
         count(*) FILTER (way IN (5, 7, 8, 9, 10) AND slide IN ('S8', 'S9')) AS feature, count(*) FILTER (way = 5 AND slide NOT IN ('S8', 'S9')) AS vertex,
         count(*) FILTER (false) AS slide
  FROM spoilt) UNPIVOT (n FOR what IN (rows, good, coordinate, fields, magnification, length, feature, vertex, slide))""", VEC, SPOILT))
def quarantine_counts(spark, d):
    """What was counted while the rows were split."""
    checked = check_segmentation(_spoilt_lines(spark, d), dims=65, keep=("object_id",))
    _, _, counts = quarantine(checked, scratch_path(spark, "quarantine"))
    return spark.createDataFrame(sorted(counts.items()), "what string, n long")


@query("scale_coordinates", with_ctes("""
SELECT object_id, x * m AS x, y * m AS y, (SELECT sum(p.y) FROM pts p WHERE p.object_id = v.object_id) * m AS vertex_y_sum
FROM (SELECT *, CASE WHEN object_id % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS m FROM vec) v""", VEC, outline_cte(True)))
def scale_coordinates(spark, d):
    rows = f.scale_coordinates(parse_segmentation(_raw_lines(spark, d), keep=("object_id",)))
    return rows.select("object_id", "x", "y", F.aggregate("boundary", F.lit(0.0), lambda a, p: a + p["y"]).alias("vertex_y_sum"))


@query("segmentation_to_boundary", with_ctes("""
SELECT slide, printf('%.1f', x * m) AS centroid_x, printf('%.1f', y * m) AS centroid_y, boundary FROM (
  SELECT v.object_id, v.slide, v.x, v.y, CASE WHEN object_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS m, b.boundary FROM vec v
  JOIN (SELECT object_id, string_agg(CASE WHEN object_id % 2 = 0 THEN printf('%.1f,%.1f', x * 2, y * 2)
                                          ELSE CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT) END, ' ' ORDER BY pos) AS boundary
        FROM pts GROUP BY object_id) b USING (object_id))
WHERE slide NOT IN ('S8', 'S9')""", VEC, outline_cte(True)))
def segmentation_to_boundary(spark, d):
    rows = f.reject_nonfinite(parse_segmentation(_raw_lines(spark, d)))
    return boundary_lines(f.scale_coordinates(rows))


@query("format_segmentation", with_ctes("""
SELECT concat_ws(chr(9), v.slide, printf('%.1f', v.x), printf('%.1f', v.y), feats, outline) AS value
FROM vec v JOIN (SELECT object_id, string_agg(printf('%.6f', f), chr(9) ORDER BY dim) AS feats FROM vec_long GROUP BY object_id) USING (object_id)
JOIN (SELECT object_id, string_agg(printf('%.1f,%.1f;', x, y), '' ORDER BY pos) AS outline FROM pts GROUP BY object_id) USING (object_id)""",
    VEC, VEC_LONG, outline_cte(True)))
def format_segmentation(spark, d):
    outline = t.outlines(spark, d, whole=True).select("object_id", F.col("points").alias("boundary"))
    return segmentation_lines(t.vectors(spark, d).join(outline, "object_id"))


@query("polygon_compact", with_ctes("""
SELECT object_id, string_agg(CASE WHEN x = 0 AND signbit(x) THEN '-0' ELSE CAST(CAST(x AS BIGINT) AS VARCHAR) END || ',' ||
                             CAST(CAST(y AS BIGINT) AS VARCHAR), ' ' ORDER BY pos) AS compact
FROM pts GROUP BY object_id""", VEC, outline_cte(True)))
def polygon_compact(spark, d):
    text = polygon_text(F.col("points"))
    return t.outlines(spark, d, whole=True).select("object_id", compact_polygon(text).alias("compact"))


@query("feature_stats", with_ctes("""
SELECT CAST(dim AS INTEGER) AS dim, round(avg(f), 9) AS mean, round(stddev_samp(f), 9) AS std FROM vec_long GROUP BY dim""", VEC, VEC_LONG))
def feature_stats(spark, d):
    stats = f.feature_stats(t.vectors(spark, d)).select(F.posexplode(F.arrays_zip("mean", "std")))
    return stats.select(F.col("pos").alias("dim"), F.round("col.mean", 9).alias("mean"), F.round("col.std", 9).alias("std"))


STATS = "stats AS (SELECT dim, avg(f) AS m, stddev_samp(f) AS s FROM vec_long GROUP BY dim)"


@query("zscore_features", with_ctes("""
SELECT object_id, CAST(dim AS INTEGER) AS dim, round((f - m) / s, 6) + 0.0 AS z FROM vec_long JOIN stats USING (dim)""", VEC, VEC_LONG, STATS))
def zscore_features(spark, d):
    vectors = t.vectors(spark, d)
    scaled = f.zscore_features(vectors, f.feature_stats(vectors)).select("object_id", F.posexplode("features"))
    return scaled.select("object_id", F.col("pos").alias("dim"), (F.round("col", 6) + 0.0).alias("z"))


@query("unzscore_features", with_ctes("""
SELECT object_id, CAST(dim AS INTEGER) AS dim, round(f * s + m, 6) + 0.0 AS raw FROM vec_long JOIN stats USING (dim)""", VEC, VEC_LONG, STATS))
def unzscore_features(spark, d):
    vectors = t.vectors(spark, d)
    stats = f.feature_stats(vectors)
    raw = vectors.withColumn("_p", single_row(stats))
    long = raw.select("object_id", F.posexplode(unzscore(F.col("features"), F.col("_p.mean"), F.col("_p.std"))))
    return long.select("object_id", F.col("pos").alias("dim"), (F.round("col", 6) + 0.0).alias("raw"))


@query("renormalize", with_ctes("""
SELECT object_id, CAST(dim AS INTEGER) AS dim, round((f * own.s + own.m - tgt.m) / tgt.s, 6) + 0.0 AS z
FROM vec_long JOIN stats own USING (dim)
JOIN (SELECT dim, avg(f) AS m, stddev_samp(f) AS s FROM vec_long WHERE label = 1 GROUP BY dim) tgt USING (dim)""", VEC, VEC_LONG, STATS))
def renormalize(spark, d):
    """From the statistics of all vectors to those of the positive ones."""
    vectors = t.vectors(spark, d)
    own, target = f.feature_stats(vectors), f.feature_stats(vectors.where("label = 1"))
    scaled = f.renormalize(vectors, own, target).select("object_id", F.posexplode("features"))
    return scaled.select("object_id", F.col("pos").alias("dim"), (F.round("col", 6) + 0.0).alias("z"))


@query("slide_offsets", with_ctes("""
SELECT slide, n, CAST(coalesce(sum(n) OVER (ORDER BY slide ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row
FROM (SELECT slide, count(*) AS n FROM obj GROUP BY slide)""", OBJ))
def slide_offsets(spark, d):
    return f.slide_offsets(t.objects(spark, d))


@query("compact_slide_index", with_ctes("""
SELECT slide, CAST(row_number() OVER (ORDER BY slide) - 1 AS INTEGER) AS slide_idx FROM (SELECT DISTINCT slide FROM labeled)""", OBJ, LABELED))
def compact_slide_index(spark, d):
    return f.compact_slide_index(t.labeled(spark, d))


@query("json_columns_to_rows", with_ctes("""
SELECT object_id, CAST(i AS INTEGER) AS pos, CAST(features[i + 1] AS DOUBLE) AS time, CAST(features[i + 17] AS DOUBLE) AS event, CAST(features[i + 33] AS DOUBLE) AS age,
       CAST(features[i + 49] AS DOUBLE) AS dose
FROM vec, range(0, 16) r(i)""", VEC))
def json_columns_rows(spark, d):
    part = lambda first: F.slice(F.col("features").cast("array<double>"), first, 16)
    payload = F.to_json(F.array(*[
        F.struct(F.lit(k).alias("key"), part(i).alias("value")) for k, i in (("time", 1), ("event", 17), ("age", 33), ("dose", 49))
    ]))
    texts = t.vectors(spark, d).select("object_id", payload.alias("payload"))
    return json_columns_to_rows(texts, "payload", ["time", "event", "age", "dose"], ["object_id"])


@query("decode_label_batch", with_ctes("""
SELECT submission_id, CAST(object_id AS BIGINT) AS id, uid AS slide, CAST(floor(value) AS DOUBLE) AS cent_x, value AS cent_y, label, CAST(NULL AS DOUBLE) AS click_x
FROM subs""", SUBMISSIONS))
def decode_label_batch_query(spark, d):
    """Payloads with a numeric slide name and whole-number coordinates."""
    s = t.submissions(spark, d)
    text = lambda c: F.col(c).cast("string")
    payload = F.concat(
        F.lit('[{"id":'), text("object_id"), F.lit(',"slide":'), F.col("uid"), F.lit(',"centX":'),
        F.floor("value").cast("string"), F.lit(',"centY":'), text("value"), F.lit(',"label":'), text("label"), F.lit("}]"),
    )
    rows = decode_label_batch(s.select("submission_id", payload.alias("payload")), "payload", ["submission_id"])
    return rows.select(
        "submission_id", "id", "slide", F.col("centX").alias("cent_x"), F.col("centY").alias("cent_y"), "label",
        F.col("clickX").alias("click_x"),
    )


@query("pending_work", with_ctes("""
SELECT DISTINCT object_id FROM obj WHERE object_id NOT IN (SELECT object_id FROM labeled)""", OBJ, LABELED))
def pending_work(spark, d):
    from labelquarry.operators.labels import pending_work as pending

    return pending(t.objects(spark, d), t.labeled(spark, d), "object_id")


@query("array_functions", with_ctes("""
SELECT object_id, CAST(features[1] AS DOUBLE) AS first, CAST(features[64] AS DOUBLE) AS last,
       (SELECT count(*) FROM vec_long l WHERE l.object_id = vec.object_id AND l.f > 0) AS positives
FROM vec""", VEC, VEC_LONG))
def array_functions(spark, d):
    from labelquarry.functions.numbers import elements_where, pick_elements

    values = F.col("features").cast("array<double>")
    picked = pick_elements(values, F.array(F.lit(0), F.lit(63)))
    flags = F.transform("features", lambda v: v > 0)
    return t.vectors(spark, d).select(
        "object_id", F.get(picked, 0).alias("first"), F.get(picked, 1).alias("last"),
        F.size(elements_where(values, flags)).cast("long").alias("positives"),
    )
