"""The reference pack: a baseline fitted once and kept as Parquet tables and one manifest."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.text import clean_wiki, tokens, truncate
from driftloom.operators import density, lexical, validation, vectors
from driftloom.operators.dedup import greedy_dedup
from driftloom.operators.sampling import buckets, sample
from driftloom.sources.readers import read_manifest
from driftloom.sources.writers import write_record, write_table


@dataclass(frozen=True)
class Config:
    """Locked constants of a build. Fixed values of the reference's committed run."""

    min_tokens: int = 50
    first_cap: int = 500
    cap: int = 135
    target_docs: int = 5_000
    seed: int = 42
    dedup_threshold: float = 0.85


def build_corpus(raw: DataFrame, config: Config = Config(), clean=clean_wiki) -> tuple[DataFrame, DataFrame]:
    """(corpus, accounting): clean, filter, cap, deduplicate and sample, in this order; accounting has the reasons of rejects.

    Raises where fewer than target_docs are left before or after deduplication.
    """
    cleaned = raw.select("doc_id", clean(F.col("text")).alias("text"))
    accounting = validation.reject_accounting(cleaned)
    t = tokens(F.col("text"))
    kept = cleaned.where(validation.reject_reason(F.col("text"), t, config.min_tokens) == "kept")
    capped = kept.withColumn("text", truncate(F.col("text"), t, config.first_cap)).withColumn("text", truncate(F.col("text"), t, config.cap))
    if (have := capped.count()) < config.target_docs:
        raise ValueError(f"{have} documents before deduplication, {config.target_docs} are needed")
    unique = capped.join(greedy_dedup(capped, config.dedup_threshold).where("kept").select("doc_id"), "doc_id", "left_semi")
    if (have := unique.count()) < config.target_docs:
        raise ValueError(f"{have} documents after deduplication, {config.target_docs} are needed")
    return sample(unique, config.target_docs, config.seed).withColumn("n_tokens", F.size(tokens(F.col("text")))), accounting


@dataclass
class Baseline:
    """Tables unigram and trigram, scalars, and the models of the vectors."""

    unigram: DataFrame
    trigram: DataFrame
    meta: dict = field(default_factory=dict)
    pca: dict | None = None
    kde: density.Kde | None = None

    @classmethod
    def fit(cls, corpus: DataFrame, embeddings: DataFrame | None = None, components: int = 20, seed: int = 42, bandwidth: float | str = "scott") -> Baseline:
        """embeddings: (id, vec) of the corpus or a bounded sample of it."""
        uni, tri = lexical.token_counts(corpus), lexical.token_counts(corpus, n=3)
        shape, zipf = lexical.shape(uni).first(), lexical.zipf(uni).first()
        stats = lexical.corpus_stats(corpus).first()
        digest = validation.content_digest(corpus, ["doc_id", "text"]).first()
        meta = {"digest": digest["digest"], "n_docs": digest["n_rows"], "n_tokens": shape["total"], "n_types": shape["types"], "corpus_ttr": stats["ttr"], "entropy_1gram": shape["entropy"], "zipf_alpha": zipf["alpha"], "zipf_r2": zipf["r2"]}
        out = cls(lexical.smoothed_baseline(uni, lexical.TOP_UNIGRAMS), lexical.smoothed_baseline(tri, lexical.TOP_TRIGRAMS), meta)
        if embeddings is not None:
            out.pca = vectors.fit_pca(embeddings, components)
            low = buckets(vectors.project(embeddings, out.pca).select("id", "vec"), 5, seed, "id")
            out.kde = density.Kde.fit(low.where("bucket < 3"), bandwidth)
            held = density.log_likelihood(low.where("bucket >= 3"), out.kde)
            out.meta |= {"tail_threshold": density.tail_threshold(held).first()[0], "bandwidth": out.kde.bandwidth, "avg_cos_dist": vectors.cosine_diversity(embeddings).first()["avg_cos_dist"], "intrinsic_dimensionality": int(np.searchsorted(np.cumsum(out.pca["ratios"]), 0.95) + 1)}
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        write_table(self.unigram, f"{path}/unigram")
        write_table(self.trigram, f"{path}/trigram")
        if self.pca:
            rows = [(i, [float(x) for x in c], float(r)) for i, (c, r) in enumerate(zip(self.pca["components"], self.pca["ratios"], strict=True))] + [(-1, [float(x) for x in self.pca["mean"]], 0.0)]
            write_table(spark.createDataFrame(rows, "k int, w array<double>, ratio double"), f"{path}/pca")
        if self.kde:
            write_table(self.kde.base.frame.select("id", "vec"), f"{path}/kde")
        write_record(spark, self.meta, f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str, digest: str | None = None) -> Baseline:
        """digest: that of the corpus in hand; another one than the manifest's warns, as scores then mix two corpora."""
        meta = read_manifest(spark, f"{path}/manifest")
        if digest is not None and digest != meta["digest"]:
            import warnings

            warnings.warn("the baseline was fitted on another corpus", stacklevel=2)
        out = cls(spark.read.parquet(f"{path}/unigram"), spark.read.parquet(f"{path}/trigram"), meta)
        if "bandwidth" in meta:
            rows = {r.k: r for r in spark.read.parquet(f"{path}/pca").collect()}
            ks = sorted(k for k in rows if k >= 0)
            out.pca = {"mean": np.array(rows[-1].w), "components": np.array([rows[k].w for k in ks]), "ratios": np.array([rows[k].ratio for k in ks])}
            out.kde = density.Kde.fit(spark.read.parquet(f"{path}/kde"), meta["bandwidth"])
        return out
