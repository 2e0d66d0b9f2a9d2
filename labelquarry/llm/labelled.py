"""Which rows of ``labels`` a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3


def held_out(doc_id: str) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def training_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label, fold) of the rows to learn from: one per id; with several labels the largest; null ids and labels are left out."""
    rows = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    rows = rows.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.withColumn("fold", fold("doc_id").cast("int")).filter("fold != 1")
