"""Digests, rule tables and accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.text import reject_reason, tokens

#: Fixed values of the reference's gates.
CORPUS_RULES = {"n_documents >= 4500": ("n_docs", 4500.0, None), "total_tokens >= 400000": ("n_tokens", 400_000.0, None), "vocab_size >= 10000": ("n_types", 10_000.0, None), "type_token_ratio > 0.10": ("ttr", 0.10, "open")}
BASELINE_RULES = {"zipf_alpha": (0.8, 1.2), "corpus_ttr": (0.10, None), "intrinsic_dimensionality": (10.0, None), "mean_ppl": (15.0, 60.0)}


def content_digest(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row (n_rows, digest): independent of order, files and partitions.

    Row digests are cut into 60-bit numbers whose sums, modulo 2**60, make the digest: a
    sum is combined in parallel and, unlike xor, counts repeated rows.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]).cast("binary"), 256)
    part = lambda k: F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")
    sums = df.agg(F.count("*").alias("n_rows"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)])
    return sums.select("n_rows", F.concat_ws("-", *[(F.col(f"s{k}") % F.lit(1 << 60)).cast("string") for k in range(4)]).alias("digest"))


def is_current(df: DataFrame, cols: Sequence[str], manifest: dict) -> bool:
    """Whether a written corpus still is what its manifest says; then a build may be skipped."""
    return content_digest(df, cols).first()["digest"] == manifest.get("digest")


def reject_accounting(docs: DataFrame, text: Column | None = None, by: Sequence[str] = (), cap: int = 135) -> DataFrame:
    """(by, reason, n, n_long): documents by the first filter that rejects them, and how many have more than `cap` tokens and are cut."""
    t = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    words = tokens(t)
    return docs.select(*by, reject_reason(t, words).alias("reason"), F.size(words).alias("size")).groupBy(*by, "reason").agg(F.count("*").alias("n"), F.count_if(F.col("size") > cap).alias("n_long"))


def apply_rules(stats: DataFrame, rules: dict = CORPUS_RULES) -> DataFrame:
    """(rule, value, passed) from one row of statistics."""
    cells = [F.struct(F.lit(name).alias("rule"), F.col(c).cast("double").alias("value"), ((F.col(c) > low) if kind == "open" else (F.col(c) >= low)).alias("passed")) for name, (c, low, kind) in rules.items()]
    return stats.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def sanity(stats: DataFrame, rules: dict = BASELINE_RULES) -> DataFrame:
    """(rule, value, passed): a missing value fails."""
    cells = []
    for name, (low, high) in rules.items():
        v = F.col(name).cast("double")
        ok = v.between(low, high) if high is not None else v > low
        cells.append(F.struct(F.lit(name).alias("rule"), v.alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return stats.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def length_cap(docs: DataFrame, counter, budget: int = 236, percentile: float = 0.95) -> DataFrame:
    """One row: p95 of subwords per token and the cap in tokens that keeps that share within budget. counter: text column to subword count; required."""
    n = F.greatest(F.size(tokens(F.col("text"))), F.lit(1))
    c = counter(F.col("text"))
    stats = docs.select((c / n).alias("r"), c.alias("c")).agg(F.percentile("r", F.lit(percentile)).alias("ratio_p95"), F.percentile("c", F.lit(0.95)).alias("subwords_p95"), F.percentile("c", F.lit(0.99)).alias("subwords_p99"))
    return stats.withColumn("token_cap", F.floor(F.lit(budget) / F.col("ratio_p95")).cast("int"))


def endings(docs: DataFrame, k: int = 10, chars: int = 200) -> DataFrame:
    """(cohort, doc_id, n_tokens, ending): the first k documents at the cap (130 tokens and more) and the first k of 50 to 70."""
    n = F.size(tokens(F.col("text")))
    rows = docs.select("doc_id", "text", n.alias("n_tokens"))
    out = None
    for name, cond in (("at_cap", F.col("n_tokens") >= 130), ("short", F.col("n_tokens").between(50, 70))):
        part = rows.where(cond).orderBy("doc_id").limit(k).select(F.lit(name).alias("cohort"), "doc_id", "n_tokens", F.right("text", F.lit(chars)).alias("ending"))
        out = part if out is None else out.unionByName(part)
    return out
