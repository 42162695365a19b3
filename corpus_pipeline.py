"""The corpus pipeline: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import decontaminate, jaccard, pieces, pii, quality
from driftloom.llm.common import broadcast_if_small, free_name, materialise, number_rows, table
from driftloom.llm.queries import QUALITY_CUT, quality_model
from driftloom.scratch import discard, passing

#: Near copies share four fifths of their five-word shingles; the 4 words and 85 of 100 of op6_near_duplicates hold for that query alone.
DEDUP_RULE = jaccard.Rule(words=5, num=80, den=100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote does not reject."""
    name = free_name(docs, "_quality")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), score_col=name)
    return scored.where(F.col(name) >= QUALITY_CUT).drop(name)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, and of equal rows one.

    Rows that share an id but not their texts are documents of their own: each stays or
    goes by its own text, and of linked ones the first by id and digest stays. Documents
    without words, and rows without an id, all stay.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    key = free_name(docs, "_key")
    rows, key = (docs, "doc_id") if repeated.isEmpty() else (_with_keys(docs, key), key)
    groups = materialise(jaccard.near_duplicates(rows, DEDUP_RULE, id_col=key), "groups")
    gone = broadcast_if_small(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), jaccard.BROADCAST_IDS)
    return rows.join(gone, key, "left_anti").select(docs.columns)


def _with_keys(docs: DataFrame, key: str) -> DataFrame:
    """The rows with a number, key, in the order of doc_id and digest, equal rows once; rows without an id have none and all stay."""
    name, columns = free_name(docs, "_digest"), [F.col(f"`{c}`") for c in docs.columns]
    named = materialise(docs.where("doc_id is not null").withColumn(name, F.sha2(F.to_json(F.struct(*columns)), 256)).dropDuplicates(["doc_id", name]), "dedup-rows")
    numbers, _ = number_rows(named.select("doc_id", name), ["doc_id", name], "dedup-numbers")
    keyed = named.join(numbers.select("doc_id", name, F.col("row_no").alias(key)), ["doc_id", name])
    return materialise(keyed.select(*columns, key).unionByName(docs.where("doc_id is null").withColumn(key, F.lit(None).cast("long"))), "dedup-keyed")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly passage go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), chars_col="n_chars")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs, chars_col="n_chars")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids."""
    return pieces.encode_pieces(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", encode_stage),
]

#: SQL expresses neither the classifier nor the shortest path; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if old is not None:
            discard(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
