"""One query for each operator, over the whole of its table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clusters, collocations, lm, media, packing, pieces, pii, quality, secret_scan, simhash, urls
from .sql import CHAT_SQL, CLUSTERS_SQL, COLLOCATIONS_SQL, PII_SQL, QUALITY_SQL, SECRETS_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.filtered(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op6_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"))


def op7_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of recordings: each vector of ``embeddings`` is one, played as a tune."""
    prints = media.fingerprints(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", media.read_tune)
    return media.search(prints, "vec_id", F.col("vec_id") % 50 == 0)


#: The conversation whose texts are nothing but control strings.
_ODD = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_ODD).alias("text"),
    )
    return chat.digest(chat.formatted(turns.unionByName(odd)))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(_table(spark, sf_dir, "documents")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.secrets(_table(spark, sf_dir, "documents"))
    return secret_scan.digest(found)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"))


def op12_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.digest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.ranked(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_bpe_trie": op5_bpe_trie,
    "op6_log_bilinear_lm": op6_log_bilinear_lm,
    "op7_chroma_fingerprints": op7_chroma_fingerprints,
    "op8_chat_format": op8_chat_format,
    "op9_personal_data": op9_personal_data,
    "op10_secret_scan": op10_secret_scan,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_heap_kmeans": op12_heap_kmeans,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op3_quality_rules": QUALITY_SQL,
    "op8_chat_format": CHAT_SQL,
    "op9_personal_data": PII_SQL,
    "op10_secret_scan": SECRETS_SQL,
    "op12_heap_kmeans": CLUSTERS_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
}
