"""An extension beyond the reference: lexical statistics of a stream of texts, per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.text import tokens


def windowed_lexical(stream: DataFrame, window: str = "10 minutes", late: str = "5 minutes", ts: str = "ts", text: str = "text") -> DataFrame:
    """(window, n_docs, n_tokens, mean_ttr): the mean of the documents' TTR, so that no state grows with the vocabulary."""
    rows = stream.withWatermark(ts, late).select(F.col(ts).alias("ts"), tokens(F.col(text)).alias("t"))
    return rows.groupBy(F.window("ts", window)).agg(F.count("*").alias("n_docs"), F.sum(F.size("t")).alias("n_tokens"), F.avg(F.when(F.size("t") > 0, F.size(F.array_distinct("t")) / F.size("t"))).alias("mean_ttr"))


def windowed_counts(stream: DataFrame, window: str = "10 minutes", late: str = "5 minutes", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(window, key, n, mean): counts and means of an event stream, for append mode."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
