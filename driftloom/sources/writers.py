"""Sinks. Tables are Parquet; small records (manifests, index entries) are one JSON line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One record as one JSON line in the store that Spark writes to."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
