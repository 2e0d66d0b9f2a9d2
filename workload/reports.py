"""Per-slide counts, confusion, ROC and review reports."""

from pyspark.sql import functions as F

from labelquarry.functions.numbers import two_digit_scientific
from labelquarry.operators import report, scoring
from workload import tables as t
from workload.registry import query
from workload.tables import LABELED, OBJ, with_ctes


@query("slide_positive_counts", with_ctes("""
SELECT slide, CAST(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, count(*) AS total
FROM obj GROUP BY slide""", OBJ))
def slide_positive_counts(spark, d):
    return report.slide_positive_counts(t.objects(spark, d))


@query("slide_class_counts", with_ctes("""
SELECT slide, CAST(sum(CASE WHEN score >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive,
       CAST(sum(CASE WHEN score >= 0 THEN 0 ELSE 1 END) AS BIGINT) AS negative
FROM obj GROUP BY slide""", OBJ))
def slide_class_counts(spark, d):
    return report.slide_class_counts(scoring.classify(t.objects(spark, d)))


@query("slide_percent_positive", with_ctes("""
SELECT slide, CAST(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, count(*) AS total,
       round(100.0 * sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) / count(*)) AS percent
FROM obj GROUP BY slide""", OBJ))
def slide_percent_positive(spark, d):
    return report.slide_percent_positive(report.slide_positive_counts(t.objects(spark, d)))


@query("count_report_pivot", with_ctes("""
SELECT class, CAST(sum(CASE WHEN flag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS "A",
       CAST(sum(CASE WHEN flag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS "N",
       CAST(sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS "R"
FROM (SELECT CASE WHEN score >= 0 THEN 'positive' ELSE 'negative' END AS class,
             CASE label WHEN 1 THEN 'A' WHEN -1 THEN 'R' ELSE 'N' END AS flag FROM obj)
GROUP BY class""", OBJ))
def count_report_pivot(spark, d):
    """The return flag takes the place of the slide, so the report has three columns."""
    flag = F.when(F.col("label") == 1, "A").when(F.col("label") == -1, "R").otherwise("N")
    classified = scoring.classify(t.objects(spark, d)).withColumn("slide", flag)
    return report.count_report_pivot(classified, ["A", "N", "R"])


@query("count_report", with_ctes("""
SELECT slide, class, count(n) AS n
FROM (SELECT DISTINCT slide FROM obj) CROSS JOIN (VALUES ('positive'), ('negative')) v(class)
LEFT JOIN (SELECT slide, CASE WHEN score >= 0 THEN 'positive' ELSE 'negative' END AS class, 1 AS n FROM obj)
USING (slide, class)
GROUP BY slide, class""", OBJ))
def count_report(spark, d):
    return report.count_report(scoring.classify(t.objects(spark, d)))


@query("roc_points", with_ctes(
    "SELECT object_id, label, (score + 1) / 2 AS probability FROM labeled", OBJ, LABELED))
def roc_points(spark, d):
    return report.roc_points(t.labeled(spark, d))


_CONFUSION = """
SELECT tp, fp, tn, fn, tp + fn AS p, fp + tn AS n,
       round(CAST(fp AS DOUBLE) / (fp + tn), 6) AS fpr, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS tpr,
       round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
       round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 6) AS accuracy
FROM (SELECT count(*) FILTER (label = 1 AND score >= 0) AS tp, count(*) FILTER (label <> 1 AND score >= 0) AS fp,
             count(*) FILTER (label <> 1 AND score < 0) AS tn, count(*) FILTER (label = 1 AND score < 0) AS fn
      FROM {source})"""


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("confusion_matrix", with_ctes(_CONFUSION.format(source="labeled"), OBJ, LABELED))
def confusion_matrix(spark, d):
    return _rounded(report.confusion_matrix(t.labeled(spark, d)), "fpr", "tpr", "precision", "accuracy")


@query("confusion_by_length", with_ctes(_CONFUSION.format(source="judged"), """
judged AS (SELECT CASE WHEN quality = 1 THEN 1 ELSE -1 END AS label, CASE WHEN n_chars >= 1000 THEN 1 ELSE -1 END AS score
           FROM labels JOIN documents USING (doc_id))"""))
def confusion_by_length(spark, d):
    """Quality labels against a rule on document length."""
    judged = t.read(spark, d, "labels").join(t.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.when(F.col("quality") == 1, 1).otherwise(-1).alias("label"),
        F.when(F.col("n_chars") >= 1000, 1).otherwise(-1).alias("score"),
    )
    return _rounded(report.confusion_matrix(judged), "fpr", "tpr", "precision", "accuracy")


@query("slide_score_map", with_ctes("SELECT score, x, y FROM obj WHERE slide = 'S7'", OBJ))
def slide_score_map(spark, d):
    return report.slide_score_map(t.objects(spark, d), "S7")


@query("classify_threshold", with_ctes(
    "SELECT object_id, CASE WHEN score >= 0 THEN 1 ELSE -1 END AS predicted FROM obj", OBJ))
def classify_threshold(spark, d):
    return scoring.classify(t.objects(spark, d)).select("object_id", "predicted")


@query("review_totals", with_ctes("""
SELECT count(DISTINCT slide) AS slides, count(*) AS samples, count(*) FILTER (label = 1) AS positives,
       count(*) FILTER (label = -1) AS negatives FROM labeled""", OBJ, LABELED))
def review_totals(spark, d):
    return report.review_totals(t.labeled(spark, d))


@query("samples_by_slide", with_ctes("""
SELECT slide, page, CAST(count(*) AS INTEGER) AS samples, list(object_id ORDER BY object_id, label)[1] AS first_id,
       sha256(string_agg(object_id || ':' || label, ',' ORDER BY object_id, label)) AS content
FROM (SELECT *, CAST(floor((rank() OVER (PARTITION BY slide ORDER BY object_id) - 1) / 20) AS INTEGER) AS page FROM labeled)
GROUP BY slide, page""", OBJ, LABELED))
def samples_by_slide(spark, d):
    """The review lists in pages of 20: size, first id and a digest of the content of each."""
    lists = report.samples_by_slide(t.labeled(spark, d), per_list=20)
    text = F.array_join(F.transform("samples", lambda s: F.concat(s["id"].cast("string"), F.lit(":"), s["label"].cast("string"))), ",")
    return lists.select(
        "slide", "page", F.size("samples").alias("samples"), F.get("samples", F.lit(0))["id"].alias("first_id"), F.sha2(text, 256).alias("content")
    )


@query("samples_json", with_ctes("""
SELECT '{"id":"' || object_id || '","slide":"' || slide || '","label":' || label || ',"iteration":' || iteration || '}' AS json
FROM labeled""", OBJ, LABELED))
def samples_json(spark, d):
    return report.samples_json(t.labeled(spark, d).withColumnRenamed("object_id", "id"), ["id", "slide", "label", "iteration"])


@query("distinct_slides", with_ctes("SELECT DISTINCT slide FROM obj", OBJ))
def distinct_slides(spark, d):
    return t.objects(spark, d).select("slide").distinct()


@query("round_significant", """
SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 0.0 ELSE
  round(round(c_acctbal / pow(10, floor(log10(abs(c_acctbal)))), 2) * pow(10, floor(log10(abs(c_acctbal)))), 6) END AS shown
FROM customer""")
def round_significant(spark, d):
    return t.read(spark, d, "customer").select(
        "c_custkey", F.round(two_digit_scientific(F.col("c_acctbal")), 6).alias("shown")
    )
