"""Table schemas."""

from pyspark.sql import types as T

POINTS = T.ArrayType(
    T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
)

OBJECTS = T.StructType([
    T.StructField("object_id", T.LongType()),
    T.StructField("slide", T.StringType()),
    T.StructField("x", T.FloatType()),
    T.StructField("y", T.FloatType()),
    T.StructField("features", T.ArrayType(T.FloatType())),
])

LABELED = T.StructType([
    *OBJECTS.fields,
    T.StructField("db_id", T.IntegerType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("iteration", T.IntegerType()),
    T.StructField("click_x", T.FloatType()),
    T.StructField("click_y", T.FloatType()),
])

NORM_PARAMS = T.StructType([
    T.StructField("mean", T.ArrayType(T.DoubleType())),
    T.StructField("std", T.ArrayType(T.DoubleType())),
])

BOUNDARIES = T.StructType([
    T.StructField("slide", T.StringType()),
    T.StructField("centroid_x", T.DecimalType(10, 1)),
    T.StructField("centroid_y", T.DecimalType(10, 1)),
    T.StructField("boundary", T.StringType()),
])

SLIDES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("x_size", T.IntegerType()),
    T.StructField("y_size", T.IntegerType()),
    T.StructField("pyramid_path", T.StringType()),
    T.StructField("scale", T.IntegerType()),
])

ROI = T.StructType([
    T.StructField("slide", T.StringType(), False),
    T.StructField("start_x", T.IntegerType(), False),
    T.StructField("start_y", T.IntegerType(), False),
    T.StructField("width", T.IntegerType(), False),
    T.StructField("height", T.IntegerType(), False),
])

SLIDE_PERCENT = T.StructType([
    T.StructField("slide", T.StringType()),
    T.StructField("percent", T.DoubleType()),
])

# Whole numbers and numeric slide names arrive with either JSON type; from_json coerces both.
LABEL_SAMPLES = T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("slide", T.StringType()),
    T.StructField("centX", T.DoubleType()),
    T.StructField("centY", T.DoubleType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("clickX", T.DoubleType()),
    T.StructField("clickY", T.DoubleType()),
]))

COLUMN_PAYLOAD = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.ArrayType(T.DoubleType())),
]))
