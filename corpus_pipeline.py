"""A corpus pipeline of five stages over ``documents``.

Each stage takes the documents that its predecessor kept, written as Parquet and read again, and
returns documents with the same columns; the last one returns tokens instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelquarry.llm import bottom_k, bpe_automaton, conv_toxicity, suffix_search, superkmers
from labelquarry.llm.common import store
from labelquarry.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score at or above the threshold of their language).

    The model learns from the labelled rows among ``docs`` that are not held out. Null and empty texts stay.
    """
    model = conv_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = conv_toxicity.score_toxicity(docs.select(COLUMNS), model)
    return scored.filter(~F.coalesce(F.col("rejected"), F.lit(False)) | F.col("text").isNull() | (F.col("text") == "")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id; documents without words stay."""
    return bottom_k.drop_near_duplicates(docs.select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts; no document goes. ``n_chars`` follows the text where it changes."""
    out = superkmers.drop_repeats(docs.select(COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten consecutive words of a benchmark item (or a whole shorter item)."""
    return suffix_search.drop_contaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with the digests of ids and decoded text."""
    out = bpe_automaton.encode_texts(docs.select("doc_id", "text", "lang", "source"), vocabulary(), ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; between two, documents are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Trained scores and exact token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
