"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dedup, fingerprint, langid, licenses, oracles, packing, quality, sharding, tokenfiles, wordpiece
from .scratch import Scratch, table

END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _turn(n: int):
    """crc32 of the id's text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("groups")
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return tokenfiles.read_token_index(spark, path)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_turn(4) == 2, F.lit(False)))
    model = langid.learn(docs.where("not held_out and doc_id is not null").select("doc_id", "text", "lang"))
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(_turn(4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def op6_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.learn(docs, table(spark, sf_dir, "labels").where(_turn(5) != 0))
    return quality.score(docs, trees).withColumn("held_out", F.coalesce(_turn(5) == 0, F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"), 16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_minhash_dedup, op2_token_files, op3_best_fit_packing, op4_iblt_fingerprints, op5_language_id, op6_wordpiece_counts, op7_quality, op8_kd_shards, op9_winnowing, op10_license_scan)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others have tests against plain Python."""
    return {"op1_minhash_dedup": oracles.near_duplicates(4, 80), "op9_winnowing": oracles.contamination(decontam.WINDOW), "op10_license_scan": oracles.licenses()}
