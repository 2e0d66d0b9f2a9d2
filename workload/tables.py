"""The provided tables in the roles of object, label, catalog, boundary and study tables.

Every table exists twice: as a DataFrame and as the body of a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- line items as scored objects -------------------------------------------------------------
# Key: order, part and price in cents (unique). Position: part number and quantity. Score: cents
# folded into [-1, 1). Label: the return flag (A positive, R negative, N not labelled).

def cents() -> Column:
    return F.floor(F.col("l_extendedprice") * 100 + 0.5)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), cents().cast("string")).alias("object_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("slide"),
        F.col("l_partkey").cast("double").alias("x"),
        (F.col("l_quantity") * 40).alias("y"),
        ((cents() % 200000).cast("double") / 100000 - 1).alias("score"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).alias("label"),
        F.col("l_linenumber").alias("iteration"),
        F.round(F.col("l_discount") * 20 - 1, 3).alias("coarse_score"),
    )


OBJ = """
obj AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, cents) AS object_id, 'S' || l_suppkey AS slide,
         CAST(l_partkey AS DOUBLE) AS x, l_quantity * 40 AS y,
         CAST(cents % 200000 AS DOUBLE) / 100000 - 1 AS score,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 END AS label,
         l_linenumber AS iteration, round(l_discount * 20 - 1, 3) AS coarse_score
  FROM (SELECT *, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents FROM lineitem)
)"""


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).where("label IS NOT NULL")


LABELED = "labeled AS (SELECT * FROM obj WHERE label IS NOT NULL)"


def object_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slide sizes that hold every object of the slide."""
    return objects(spark, sf_dir).groupBy(F.col("slide").alias("name")).agg(
        F.ceil(F.max("x") + 1).cast("int").alias("x_size"), F.ceil(F.max("y") + 1).cast("int").alias("y_size")
    )


SLIDE_SIZES = """
sizes AS (SELECT slide AS name, CAST(ceil(max(x) + 1) AS INTEGER) AS x_size,
                 CAST(ceil(max(y) + 1) AS INTEGER) AS y_size FROM obj GROUP BY slide)"""


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square outline per position; its id is the smallest object id there."""
    places = objects(spark, sf_dir).groupBy(
        "slide", F.col("x").cast("decimal(10,1)").alias("centroid_x"),
        F.col("y").cast("decimal(10,1)").alias("centroid_y"),
    ).agg(F.min("object_id").alias("id"))
    left, right = (F.col("centroid_x") - 2).cast("int").cast("string"), (F.col("centroid_x") + 2).cast("int").cast("string")
    top, bottom = (F.col("centroid_y") - 2).cast("int").cast("string"), (F.col("centroid_y") + 2).cast("int").cast("string")
    corner = lambda a, b: F.concat(a, F.lit(","), b, F.lit(" "))
    return places.withColumn(
        "boundary", F.concat(corner(left, top), corner(right, top), corner(right, bottom), corner(left, bottom))
    )


BOUNDARIES = """
boundaries AS (
  SELECT slide, cx, cy, id,
         concat(cx - 2, ',', cy - 2, ' ', cx + 2, ',', cy - 2, ' ', cx + 2, ',', cy + 2, ' ', cx - 2, ',', cy + 2, ' ') AS boundary
  FROM (SELECT slide, CAST(x AS INTEGER) AS cx, CAST(y AS INTEGER) AS cy, min(object_id) AS id
        FROM obj GROUP BY 1, 2, 3)
)"""


# --- embeddings as objects with feature vectors -----------------------------------------------

WEIGHTS = [(i % 7 - 3) / 4 for i in range(1, 65)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("object_id"),
        F.concat(F.lit("S"), F.col("label").cast("string")).alias("slide"),
        ((F.col("vec_id") * 37) % 1000).cast("double").alias("x"),
        ((F.col("vec_id") * 91) % 1000).cast("double").alias("y"),
        F.col("embedding").alias("features"),
        F.when(F.col("label") < 4, 1).when(F.col("label") < 8, -1).otherwise(0).alias("label"),
    )


VEC = """
vec AS (
  SELECT vec_id AS object_id, 'S' || label AS slide, CAST((vec_id * 37) % 1000 AS DOUBLE) AS x,
         CAST((vec_id * 91) % 1000 AS DOUBLE) AS y, embedding AS features,
         CASE WHEN label < 4 THEN 1 WHEN label < 8 THEN -1 ELSE 0 END AS label,
         greatest(-1.0, least(1.0, list_sum([CAST(embedding[i] AS DOUBLE) * ((i % 7 - 3) / 4) FOR i IN range(1, 65)]))) AS score
  FROM embeddings
)"""

# Features one row each, positions from zero.
VEC_LONG = """
vec_long AS (
  SELECT object_id, slide, label, unnest(features)::DOUBLE AS f, generate_subscripts(features, 1) - 1 AS dim FROM vec
)"""


def outlines(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """An outline of 32 points per vector: pairs of features, scaled and, with ``whole``,
    rounded down to a coarse grid so that repeats, straight runs and reversals occur."""
    f = lambda i: F.get("features", i).cast("double")
    scale = (lambda c: F.floor(c * 8).cast("double")) if whole else (lambda c: c * 100)
    points = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.struct(scale(f(i * 2)).alias("x"), scale(f(i * 2 + 1)).alias("y")),
    )
    return vectors(spark, sf_dir).select("object_id", "slide", "x", "y", points.alias("points"))


def outline_cte(whole: bool) -> str:
    scale = (lambda c: f"floor(CAST({c} AS DOUBLE) * 8)") if whole else (lambda c: f"CAST({c} AS DOUBLE) * 100")
    return f"""
pts AS (
  SELECT object_id, slide, i AS pos, {scale('features[2 * i + 1]')} AS x, {scale('features[2 * i + 2]')} AS y
  FROM vec, range(0, 32) t(i)
)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 × 8 image per vector; colours come from three positions of the vector."""
    value = lambda i: F.floor((F.get("features", i).cast("double") + 1) * 127.5).cast("int")
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.struct(
            (i % 8).alias("px"), F.floor(i / 8).cast("int").alias("py"), value(i).alias("value"),
            value(i).alias("r"), value((i + 21) % 64).alias("g"), value((i + 42) % 64).alias("b"),
        ),
    )
    return vectors(spark, sf_dir).select("slide", "object_id", F.inline(rows))


PIXELS = """
pix AS (
  SELECT slide, object_id, CAST(i % 8 AS INTEGER) AS px, CAST(i // 8 AS INTEGER) AS py,
         CAST(floor((CAST(features[i + 1] AS DOUBLE) + 1) * 127.5) AS INTEGER) AS value,
         CAST(floor((CAST(features[i + 1] AS DOUBLE) + 1) * 127.5) AS INTEGER) AS r,
         CAST(floor((CAST(features[(i + 21) % 64 + 1] AS DOUBLE) + 1) * 127.5) AS INTEGER) AS g,
         CAST(floor((CAST(features[(i + 42) % 64 + 1] AS DOUBLE) + 1) * 127.5) AS INTEGER) AS b
  FROM vec, range(0, 64) t(i)
)"""


# --- events as clicks and submissions ---------------------------------------------------------

def number_in_props() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("uid"), F.col("event_id").alias("submission_id"), "ts",
        number_in_props().alias("object_id"),
        F.when(kind.isin("click", "purchase"), 1).when(kind.isin("view", "signup"), -1).otherwise(0).alias("label"),
        (number_in_props() % 5 - 1).alias("iteration"), "value",
    )


SUBMISSIONS = """
subs AS (
  SELECT CAST(user_id AS VARCHAR) AS uid, event_id AS submission_id, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS object_id,
         CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type IN ('view', 'signup') THEN -1 ELSE 0 END AS label,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 - 1 AS iteration, value
  FROM events
)"""


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-pixel clicks on the slides of the line-item objects."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("click_id"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("slide"),
        F.floor(F.col("value") * 8).cast("double").alias("x"),
        (number_in_props() * 20).cast("double").alias("y"),
    )


CLICKS = """
clicks AS (
  SELECT event_id AS click_id, 'S' || user_id AS slide, floor(value * 8) AS x,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) * 20 AS DOUBLE) AS y
  FROM events
)"""


# --- catalog ----------------------------------------------------------------------------------

def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("id"),
        (F.col("s_nationkey") * 100 + 2000).cast("int").alias("x_size"), F.lit(2000).alias("y_size"),
        F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("/slides/"), F.col("s_name"), F.lit(".tif"))).alias("pyramid_path"),
        (F.col("s_nationkey") % 2 + 1).cast("int").alias("scale"), F.col("s_nationkey").alias("nation"),
    )


SLIDES = """
slides AS (
  SELECT 'S' || s_suppkey AS name, s_suppkey AS id, CAST(s_nationkey * 100 + 2000 AS INTEGER) AS x_size, 2000 AS y_size,
         CASE WHEN s_acctbal >= 0 THEN '/slides/' || s_name || '.tif' END AS pyramid_path,
         CAST(s_nationkey % 2 + 1 AS INTEGER) AS scale, s_nationkey AS nation
  FROM supplier
)"""


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


DATASETS = "datasets AS (SELECT r_regionkey AS id, r_name AS name FROM region)"


def dataset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("dataset_id"))
    return slides(spark, sf_dir).select(F.col("id").alias("slide_id"), "nation").join(nation, "nation").select("slide_id", "dataset_id")


LINKS = """
links AS (SELECT s_suppkey AS slide_id, n_regionkey AS dataset_id FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("dataset_id")
    )


TRAINING_SETS = "training_sets AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS dataset_id FROM nation)"


def training_objs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as training objects: set by nation, class by (set, market segment)."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("training_set_id"), F.col("c_custkey").alias("cell_id"),
        F.floor(F.abs("c_acctbal") / 1000).cast("int").alias("iteration"),
        F.concat_ws("/", F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("class_id"),
        F.col("c_mktsegment").alias("segment"),
    )


TRAINING_OBJS = """
training_objs AS (
  SELECT c_nationkey AS training_set_id, c_custkey AS cell_id, CAST(floor(abs(c_acctbal) / 1000) AS INTEGER) AS iteration,
         c_nationkey || '/' || c_mktsegment AS class_id, c_mktsegment AS segment
  FROM customer
)"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_objs(spark, sf_dir).select(
        F.col("class_id").alias("id"), "training_set_id", F.col("segment").alias("name"),
        F.when(F.col("segment") < "F", -1).otherwise(1).alias("label"),
    ).distinct()


CLASSES = """
classes AS (SELECT DISTINCT class_id AS id, training_set_id, segment AS name, CASE WHEN segment < 'F' THEN -1 ELSE 1 END AS label
            FROM training_objs)"""


# --- orders and line items as a survival study ------------------------------------------------

def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days from order to shipping (not negative); the line status is the event flag."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_returnflag"
    )
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where(days >= 0).select(
        days.cast("double").alias("time"), (F.col("l_linestatus") == "F").cast("int").alias("event"),
        F.col("o_orderpriority").alias("group"), F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
    )


STUDY = """
study AS (
  SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS time,
         CAST(l_linestatus = 'F' AS INTEGER) AS event, o_orderpriority AS grp, l_quantity AS quantity,
         l_discount AS discount, l_tax AS tax, CAST(l_returnflag = 'R' AS INTEGER) AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE)
)"""
