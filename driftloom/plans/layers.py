"""The measuring layers by name; each takes (cohort, baseline, options) and gives metric columns in one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators import density, lexical, nll, score, vectors
from driftloom.plans.baseline import Baseline


def lexical_layer(docs: DataFrame, base: Baseline, **_) -> DataFrame:
    return lexical.layer(docs, base.unigram, baseline_entropy=base.meta["entropy_1gram"])


def semantic_layer(vecs: DataFrame, base: Baseline, base_vecs: DataFrame | None = None, **_) -> DataFrame:
    """vecs and base_vecs: (id, vec). Coverage is measured on the projection."""
    out = vectors.cosine_diversity(vecs)
    if base_vecs is not None:
        low = lambda d: vectors.project(d, base.pca).select("id", "vec")
        out = out.crossJoin(F.broadcast(vectors.nn_coverage(low(vecs), low(base_vecs)).select("coverage", "threshold")))  # one row each
    return out


def tail_layer(vecs: DataFrame, base: Baseline, base_vecs: DataFrame | None = None, **_) -> DataFrame:
    ll = lambda d: density.log_likelihood(vectors.project(d, base.pca).select("id", "vec"), base.kde)
    return density.tail_mass(ll(vecs), ll(vecs if base_vecs is None else base_vecs), base.meta["tail_threshold"])


def inversion_layer(docs: DataFrame, base: Baseline, g0: nll.TokenScorer | None = None, gk: nll.TokenScorer | None = None, max_length: int = 128, **_) -> DataFrame:
    return nll.inversion(nll.doc_ppl(g0.score(docs), max_length=max_length), nll.doc_ppl(gk.score(docs), max_length=max_length))


LAYERS: dict[str, Callable[..., DataFrame]] = {"lexical": lexical_layer, "semantic": semantic_layer, "tail_mass": tail_layer, "perplexity_inversion": inversion_layer}


def score_dataset(docs: DataFrame, base: Baseline, scorer: nll.TokenScorer, vecs: DataFrame, base_vecs: DataFrame, name: str = "dataset") -> DataFrame:
    """The composite index of a dataset as one nested record."""
    lex = lexical_layer(docs, base).select("ttr", F.col("kl_div_1gram").alias("kl"))
    ppl = nll.ppl_ratio(nll.doc_ppl(scorer.score(docs), max_length=128)).select(F.col("ppl_ratio_vs_baseline").alias("ppl_ratio"))
    cov = semantic_layer(vecs, base, base_vecs).select("coverage")
    row = lex.crossJoin(F.broadcast(ppl)).crossJoin(F.broadcast(cov))  # one row each
    return score.index_entry(score.gates(score.estimate(score.composite(row))), name, docs.count())
