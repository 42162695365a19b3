"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, neighbours, pieces, pii, quality, secrets, sharding, sql, tokenshards
from .common import crc_mod, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = langid.fit(langid.training_rows(docs.where(~held)))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_pieces", "piece_ids", "round_trip")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where("vec_id % 100 = 0"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenshards.write_token_shards(table(spark, sf_dir, "documents"))[0]


#: A document whose score is below this is of low quality.
QUALITY_CUT = 0.3


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.QualityModel:
    return quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels"), usable=crc_mod("doc_id", 5) != 0))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_sharding, op3_decontamination, op4_pii, op5_secrets, op6_near_duplicates, op7_pieces, op8_nearest, op9_token_shards, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sql.OP2, "op3_decontamination": sql.OP3, "op4_pii": sql.OP4, "op5_secrets": sql.OP5, "op6_near_duplicates": sql.OP6, "op8_nearest": sql.OP8}
