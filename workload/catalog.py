"""Catalog joins, lookups and changes."""

from pyspark.sql import functions as F

from labelquarry.operators import catalog as c
from labelquarry.session import scratch_path
from labelquarry.sinks.catalog import CatalogTables, save_picker_session, save_training_session
from labelquarry.sources.tables import lookup
from workload import tables as t
from workload.registry import query
from workload.tables import (
    CLASSES, DATASETS, LABELED, LINKS, OBJ, SLIDES, TRAINING_OBJS, TRAINING_SETS, with_ctes,
)


@query("scan_slides", with_ctes("SELECT name, x_size, y_size, pyramid_path, scale FROM slides", SLIDES))
def scan_slides(spark, d):
    return t.slides(spark, d).select("name", "x_size", "y_size", "pyramid_path", "scale")


@query("catalog_lookup", with_ctes("""
SELECT name, id, x_size, y_size, pyramid_path, scale FROM slides WHERE name IN (SELECT slide FROM labeled)""", OBJ, LABELED, SLIDES))
def catalog_lookup(spark, d):
    wanted = t.labeled(spark, d).select(F.col("slide").alias("name"))
    return lookup(t.slides(spark, d), wanted).select("name", "id", "x_size", "y_size", "pyramid_path", "scale")


FILES = """
files AS (SELECT p_partkey AS id, p_name || CASE p_type WHEN 'SMALL' THEN '.spfeatures' WHEN 'LARGE' THEN '.pofeatures' ELSE '' END || '.h5' AS features_file
          FROM part)"""


@query("datasets_by_kind", with_ctes("""
SELECT id, features_file, CASE WHEN features_file LIKE '%spfeatures%' THEN 'region' WHEN features_file LIKE '%pofeatures%' THEN 'patch' ELSE 'nuclei' END AS kind
FROM files""", FILES))
def datasets_by_kind(spark, d):
    kind = F.col("p_type")
    mark = F.when(kind == "SMALL", ".spfeatures").when(kind == "LARGE", ".pofeatures").otherwise("")
    files = t.read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_name", mark, F.lit(".h5")).alias("features_file")
    )
    return c.datasets_by_kind(files)


@query("dataset_slides", with_ctes("""
SELECT s.name, s.x_size, s.y_size, dt.name AS dataset FROM slides s JOIN links ON s.id = slide_id JOIN datasets dt ON dt.id = dataset_id""",
    SLIDES, LINKS, DATASETS))
def dataset_slides(spark, d):
    return c.dataset_slides(t.slides(spark, d), t.dataset_links(spark, d), t.datasets(spark, d)).select(
        "name", "x_size", "y_size", "dataset"
    )


@query("trainsets_for_dataset", with_ctes("""
SELECT ts.id, ts.name, dt.name AS dataset FROM training_sets ts JOIN datasets dt ON dt.id = ts.dataset_id""", TRAINING_SETS, DATASETS))
def trainsets_for_dataset(spark, d):
    return c.sets_for_dataset(t.training_sets(spark, d), t.datasets(spark, d)).select("id", "name", "dataset")


@query("trainset_classes", with_ctes("""
SELECT ts.name AS training_set, cl.name, cl.label FROM classes cl JOIN training_sets ts ON ts.id = cl.training_set_id""",
    TRAINING_OBJS, TRAINING_SETS, CLASSES))
def trainset_classes(spark, d):
    return c.trainset_classes(t.classes(spark, d), t.training_sets(spark, d)).select("training_set", "name", "label")


@query("trainset_class_counts", with_ctes("""
SELECT ts.name AS training_set, segment AS class, count(*) AS n
FROM training_objs o JOIN training_sets ts ON ts.id = o.training_set_id GROUP BY 1, 2""", TRAINING_OBJS, TRAINING_SETS))
def trainset_class_counts(spark, d):
    return c.trainset_class_counts(t.training_objs(spark, d), t.training_sets(spark, d), t.classes(spark, d))


@query("saved_sessions", with_ctes("""
SELECT training_set, CASE WHEN label = sign THEN 'tumour' ELSE 'stroma' END AS class, count(*) AS n, CAST(3 AS BIGINT) AS version
FROM labeled, (VALUES ('first', 1), ('second', -1)) v(training_set, sign) GROUP BY 1, 2
UNION ALL SELECT 'check', 'tumour/stroma', 1, 3""", OBJ, LABELED))
def saved_sessions(spark, d):
    """Two training sessions and a picker session saved in the catalog; objects by set and class, read back."""
    tables = CatalogTables(spark, scratch_path(spark, "catalog"))
    for name, sign in (("first", 1), ("second", -1)):
        samples = t.labeled(spark, d).select(F.col("object_id").alias("id"), (F.col("label") * sign).alias("label"), F.lit(0).alias("iteration"))
        save_training_session(tables, name, 1, 1, "f.h5", "tumour", "stroma", samples)
    save_picker_session(tables, "check", 1, "p.h5", "tumour", "stroma")
    counts = c.trainset_class_counts(tables.read("training_objs"), tables.read("training_sets"), tables.read("classes"))
    tests = tables.read("test_sets").groupBy(F.col("name").alias("training_set"), F.concat("pos_name", F.lit("/"), "neg_name").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(tests).withColumn("version", F.lit(tables.version()).cast("long"))


@query("training_set_list", with_ctes("SELECT id, name FROM training_sets ORDER BY name", TRAINING_SETS))
def training_set_list(spark, d):
    return c.order_table(t.training_sets(spark, d), "name").select("id", "name")


@query("review_order", """
SELECT s_name AS slide, row_number() OVER (ORDER BY upper(s_name), s_name) AS place FROM supplier""")
def review_order(spark, d):
    """The place comes from the sorted list itself; suppliers are one row per slide."""
    names = c.review_order(t.read(spark, d, "supplier").select(F.col("s_name").alias("slide")))
    from pyspark.sql import Window

    return names.withColumn("place", F.row_number().over(Window.orderBy(F.upper("slide"), "slide")).cast("long"))


@query("samples_enriched", with_ctes("""
SELECT object_id, slide, x_size AS max_x, y_size AS max_y, pyramid_path AS path, scale
FROM labeled LEFT JOIN slides ON slides.name = slide""", OBJ, LABELED, SLIDES))
def samples_enriched(spark, d):
    return c.enrich_samples(t.labeled(spark, d), t.slides(spark, d)).select("object_id", "slide", "max_x", "max_y", "path", "scale")


@query("thumbnail_window", with_ctes("""
SELECT object_id, round((x - 25 * scale) / x_size, 9) AS "left", round((y - 25 * scale) / y_size, 9) AS top,
       round(50.0 * scale / x_size, 9) AS width, round(50.0 * scale / y_size, 9) AS height
FROM labeled JOIN slides ON slides.name = slide""", OBJ, LABELED, SLIDES))
def thumbnail_window(spark, d):
    rich = c.enrich_samples(t.labeled(spark, d), t.slides(spark, d))
    return c.thumbnail_window(rich).select("object_id", *[F.round(v, 9).alias(v) for v in ("left", "top", "width", "height")])


@query("thumbnail_window_region", with_ctes("""
SELECT object_id, round((x - off * scale) / x_size, 9) AS "left", round((y - off * scale) / y_size, 9) AS top,
       round(ext * scale / x_size, 9) AS width, round(ext * scale / y_size, 9) AS height
FROM (SELECT *, CASE iteration WHEN 8 THEN 18 ELSE 64 END AS off, CASE iteration WHEN 8 THEN 32.0 ELSE 128.0 END AS ext FROM labeled)
JOIN slides ON slides.name = slide""", OBJ, LABELED, SLIDES))
def thumbnail_window_region(spark, d):
    rich = c.enrich_samples(t.labeled(spark, d).withColumn("superpixel_size", F.col("iteration")), t.slides(spark, d))
    return c.thumbnail_window(rich, region=True).select(
        "object_id", *[F.round(v, 9).alias(v) for v in ("left", "top", "width", "height")]
    )


@query("session_defaults", """
SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN value END, CAST(user_id AS DOUBLE)) AS click_x,
       coalesce(CASE WHEN event_type = 'click' THEN value * 2 END, CAST(event_id AS DOUBLE)) AS click_y,
       coalesce(CASE WHEN event_type = 'view' THEN 64 END, 28) AS patch_size
FROM events""")
def session_defaults(spark, d):
    clicked, viewed = F.col("event_type") == "click", F.col("event_type") == "view"
    rows = t.read(spark, d, "events").select(
        "event_id", F.when(clicked, F.col("value")).alias("click_x"), F.when(clicked, F.col("value") * 2).alias("click_y"),
        F.col("user_id").cast("double").alias("x"), F.col("event_id").cast("double").alias("y"),
        F.when(viewed, 64).alias("patch_size"),
    )
    return c.session_defaults(rows).select("event_id", "click_x", "click_y", "patch_size")


@query("label_names", with_ctes("""
SELECT object_id, CASE label WHEN 1 THEN 'Positive' WHEN -1 THEN 'Negative' ELSE 'Ignore' END AS class_name FROM obj""", OBJ))
def label_names(spark, d):
    return c.label_names(t.objects(spark, d)).select("object_id", "class_name")


@query("new_slides", """
SELECT c_name AS name FROM customer WHERE 'Supplier#' || split_part(c_name, '#', 2) NOT IN (SELECT s_name FROM supplier)""")
def new_slides(spark, d):
    """Customers offered as slides under supplier names."""
    offered = t.read(spark, d, "customer").select(F.regexp_replace("c_name", "^Customer", "Supplier").alias("name"))
    known = t.read(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return c.new_slides(offered, known).select(F.regexp_replace("name", "^Supplier", "Customer").alias("name"))


@query("name_conflicts", """
SELECT c_name AS name FROM customer WHERE 'Supplier#' || split_part(c_name, '#', 2) IN (SELECT s_name FROM supplier)""")
def name_conflicts(spark, d):
    offered = t.read(spark, d, "customer").select(F.regexp_replace("c_name", "^Customer", "Supplier").alias("name"))
    known = t.read(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return c.name_conflicts(offered, known).select(F.regexp_replace("name", "^Supplier", "Customer").alias("name"))


@query("link_dataset_slides", with_ctes("""
SELECT id AS slide_id, 7 AS dataset_id FROM slides WHERE name IN (SELECT slide FROM obj)""", OBJ, SLIDES))
def link_dataset_slides(spark, d):
    return c.link_dataset_slides(t.objects(spark, d).select(F.col("slide").alias("name")), t.slides(spark, d), 7)


@query("cascade_delete", with_ctes("""
SELECT 'datasets' AS tbl, count(*) AS n FROM datasets WHERE name <> 'ASIA'
UNION ALL SELECT 'dataset_slides', count(*) FROM links WHERE dataset_id IN (SELECT id FROM datasets WHERE name <> 'ASIA')
UNION ALL SELECT 'training_sets', count(*) FROM training_sets WHERE dataset_id IN (SELECT id FROM datasets WHERE name <> 'ASIA')
UNION ALL SELECT 'classes', count(*) FROM classes WHERE training_set_id IN (
  SELECT id FROM training_sets WHERE dataset_id IN (SELECT id FROM datasets WHERE name <> 'ASIA'))
UNION ALL SELECT 'training_objs', count(*) FROM training_objs WHERE training_set_id IN (
  SELECT id FROM training_sets WHERE dataset_id IN (SELECT id FROM datasets WHERE name <> 'ASIA'))""",
    DATASETS, LINKS, TRAINING_SETS, TRAINING_OBJS, CLASSES))
def cascade_delete(spark, d):
    """Rows left in each table after one dataset is deleted."""
    data = t.datasets(spark, d)
    left = c.cascade_delete(data.where("name = 'ASIA'"), {
        "datasets": data, "dataset_slides": t.dataset_links(spark, d), "training_sets": t.training_sets(spark, d),
        "classes": t.classes(spark, d), "training_objs": t.training_objs(spark, d),
    })
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in left.items()]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


@query("replace_by_slide", with_ctes("""
SELECT object_id, slide, score FROM obj WHERE slide NOT IN (SELECT slide FROM fresh)
UNION ALL SELECT object_id, slide, score FROM fresh""", OBJ, """
fresh AS (SELECT 'new-' || s_suppkey AS object_id, 'S' || s_suppkey AS slide, 0.5 AS score FROM supplier WHERE s_acctbal < 0)"""))
def replace_by_slide(spark, d):
    fresh = t.read(spark, d, "supplier").where("s_acctbal < 0").select(
        F.concat(F.lit("new-"), F.col("s_suppkey").cast("string")).alias("object_id"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("slide"), F.lit(0.5).alias("score"),
    )
    return c.replace_by_slide(t.objects(spark, d).select("object_id", "slide", "score"), fresh)


@query("upsert_training_objs", with_ctes("""
SELECT coalesce(o.training_set_id, n.training_set_id) AS training_set_id, coalesce(o.cell_id, n.cell_id) AS cell_id,
       coalesce(o.iteration, n.iteration) AS iteration, coalesce(n.class_id, o.class_id) AS class_id
FROM training_objs o FULL OUTER JOIN incoming n ON o.training_set_id = n.training_set_id AND o.cell_id = n.cell_id""", TRAINING_OBJS, """
incoming AS (SELECT CAST(o_custkey % 25 AS INTEGER) AS training_set_id, o_custkey AS cell_id, 99 AS iteration, max(o_orderpriority) AS class_id
             FROM orders GROUP BY o_custkey)"""))
def upsert_training_objs(spark, d):
    incoming = t.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell_id")).agg(
        F.max("o_orderpriority").alias("class_id")
    ).select((F.col("cell_id") % 25).cast("int").alias("training_set_id"), "cell_id", F.lit(99).alias("iteration"), "class_id")
    existing = t.training_objs(spark, d).drop("segment")
    return c.upsert_training_objs(existing, incoming)


@query("slide_base_name", """
SELECT url, split_part(url, '.', 1) AS stem, regexp_extract(url, '([^/]*)$', 1) AS last_part FROM pages""")
def slide_base_name(spark, d):
    from labelquarry.functions.text import last_path_part, name_stem

    url = F.col("url")
    return t.read(spark, d, "pages").select("url", name_stem(url).alias("stem"), last_path_part(url).alias("last_part"))
