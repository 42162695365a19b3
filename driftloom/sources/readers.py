"""Sources: every reader yields rows with explicit schemas, so no pass over the data infers them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.text import strip_blank, tokens
from driftloom.operators.sampling import hash_order

#: Bytes below which a table is not worth dealing out, and bytes a core from which its files do.
SMALL_FILE, SMALL_TASK = 1 << 19, 4 << 20
PAGE_SCHEMA = "id bigint, ns int, title string, revision struct<text:string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table; one too small to be split by its files is dealt out to all cores, as a single row group is a single task."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if SMALL_FILE < size < SMALL_TASK * cores else df


def xml_articles(spark: SparkSession, path: str) -> DataFrame:
    """Main-namespace pages of a wiki export (.xml, .xml.bz2 splits natively): page_id, title, text; blank ones go."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("id bigint, ns int, title string, revision struct<text:struct<_VALUE:string>>").load(path)
    out = pages.where("ns = 0").select(F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("text"))
    return out.where((F.length("title") > 0) & (F.length("text") > 0))


def jsonl(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    """JSON lines with a text field; rows whose text is missing or blank go."""
    return spark.read.schema(schema).json(path).where(F.length(strip_blank(F.col("text"))) > 0)


def corpus_sample(docs: DataFrame, n: int | None, min_tokens: int = 30, max_chars: int | None = 2000, seed: int = 42, id_col: str = "doc_id", keep=None) -> DataFrame:
    """Loader of a benchmark corpus: texts of at least min_tokens, cut to max_chars and stripped, n of them in hash order.

    keep: a condition on the source's own fields (say, a nested set name). max_chars None keeps whole texts.
    """
    out = docs if keep is None else docs.where(keep)
    out = out.where(F.size(tokens(F.col("text"))) >= min_tokens)
    cut = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    out = out.withColumn("text", strip_blank(cut))
    return out if n is None else hash_order(out, seed, id_col).limit(n)


def verified(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """A written corpus whose content digest must equal the manifest's; raises otherwise."""
    from driftloom.operators.validation import content_digest

    docs = spark.read.parquet(path)
    found = content_digest(docs, ["doc_id", "text"]).first()["digest"]
    if found != manifest["digest"]:
        raise ValueError(f"digest {found} is not the manifest's {manifest['digest']}")
    return docs


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
