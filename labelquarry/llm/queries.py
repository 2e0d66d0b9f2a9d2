"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelquarry.llm import bottom_k, bpe_automaton, conv_toxicity, disclosure, filter_audit, flow_reshard, kernel_quality, license_digests, nn_descent, oracles, seekable_fim, suffix_search, superkmers, warc_segments
from labelquarry.session import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_bpe_automaton")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_automaton.encode_texts(docs, vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op8_superkmer_substrings", oracles.SUPERKMER_SUBSTRINGS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return superkmers.drop_repeats(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op5_suffix_decontamination", oracles.SUFFIX_DECONTAMINATION)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_search.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op7_bottom_k_near_dedup", oracles.BOTTOM_K_NEAR_DEDUP)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bottom_k.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_kernel_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_conv_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = conv_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return conv_toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted", "threshold", "rejected")


@query("op3_flow_reshard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = flow_reshard.reshard(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    slim = rows.select("doc_id", F.col("_size").alias("size"), crc.alias("text_crc32"), F.col("_shard").alias("shard"))
    numbered = flow_reshard.number_slots(slim, "shard", ("doc_id", "text_crc32"))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op4_warc_segments", """
with p as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages
), lead as (select payload, max(page_id) as lead_id from p where payload_bytes >= 1000 group by payload)
select page_id, payload_bytes, payload_digest,
  case when lead_id is null or lead_id = page_id then 'response' else 'revisit' end as record_type,
  case when lead_id <> page_id then lead_id end as refers_to
from p left join lead using (payload)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    warc_segments.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc_segments.read_pages(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_license_digests", license_digests.duckdb_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_digests.find_licenses(docs, license_digests.known_licenses(spark))
    return found.select("doc_id", "canonical_sha256", "license_id", "is_license")


@query("op1_nn_descent")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_filter_orders", oracles.FILTER_ORDERS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = filter_audit.mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit_orders(cells).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@query("op13_seekable_fim", oracles.SEEKABLE_FIM)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = seekable_fim.frame_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return seekable_fim.fill_in_middle(framed).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query("op11_disclosure", oracles.DISCLOSURE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return disclosure.summary(found).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
