"""Component scores and the composite index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.numeric import clamp01
from driftloom.operators.ranktests import spearman

#: Signal weights; not derivable from the tests they are named after.
WEIGHTS = {"lexical_ttr": 0.865, "lexical_kl": 0.865, "ppl_predictability": 0.865, "semantic_coverage": 0.300}


@dataclass(frozen=True)
class Anchors:
    """Where a component is 0 (clean) and 1 (collapsed)."""

    ttr_clean: float = 0.11227
    ttr_collapsed: float = 0.05847
    kl_clean: float = 5.05662
    kl_collapsed: float = 5.38296
    ratio_collapsed: float = 2.73


#: Fixed values of the variant for story corpora.
STORY_ANCHORS = Anchors(ttr_clean=0.112, ttr_collapsed=0.058)


def components(ttr: Column, kl: Column, ppl_ratio: Column, coverage: Column, a: Anchors = Anchors()) -> dict[str, Column]:
    """Scores from 0 to 1, rounded to 4 places (half to even); a ratio of null or 0 counts as 1, a missing coverage as 1."""
    ratio = F.when(ppl_ratio.isNull() | (ppl_ratio == 0), 1.0).otherwise(ppl_ratio)
    raw = {
        "lexical_ttr": (a.ttr_clean - F.coalesce(ttr, F.lit(0.112))) / (a.ttr_clean - a.ttr_collapsed),
        "lexical_kl": (F.coalesce(kl, F.lit(a.kl_clean)) - a.kl_clean) / (a.kl_collapsed - a.kl_clean),
        "ppl_predictability": (ratio - 1) / (a.ratio_collapsed - 1),
        "semantic_coverage": 1 - F.coalesce(coverage, F.lit(1.0)),
    }
    return {k: F.bround(clamp01(v), 4) for k, v in raw.items()}


def composite(df: DataFrame, a: Anchors = Anchors()) -> DataFrame:
    """df (ttr, kl, ppl_ratio, coverage) with the four component columns and composite_index."""
    parts = components(F.col("ttr"), F.col("kl"), F.col("ppl_ratio"), F.col("coverage"), a)
    out = df.withColumns(parts)
    total = sum(F.col(k) * w for k, w in WEIGHTS.items())
    return out.withColumn("composite_index", F.bround(total / sum(WEIGHTS.values()), 4))


def estimate(df: DataFrame, width: float = 0.20) -> DataFrame:
    """df with the point score and its band: not a probability of anything."""
    p = F.bround(clamp01(F.col("composite_index")), 3)
    return df.withColumns({"point_estimate": p, "ci_lower_95": F.bround(F.greatest(F.lit(0.0), p - width), 3), "ci_upper_95": F.bround(F.least(F.lit(1.0), p + width), 3)})


def gates(df: DataFrame, control: float = 0.25, validation: float = 0.5) -> DataFrame:
    return df.withColumns({"control_passed": F.col("composite_index") < control, "validation_passed": F.col("composite_index") > validation})


def index_entry(df: DataFrame, name: str, n_docs: int) -> DataFrame:
    """One nested record per row of a scored table."""
    return df.select(
        F.struct(F.lit(name).alias("dataset"), F.lit(n_docs).alias("n_documents")).alias("metadata"),
        F.struct("composite_index", "point_estimate", "ci_lower_95", "ci_upper_95").alias("scores"),
        F.struct(*WEIGHTS).alias("component_scores"),
        F.struct(*[F.lit(w).alias(k) for k, w in WEIGHTS.items()]).alias("weights"),
        F.array(F.lit("tail mass is left out"), F.lit("the score is no probability")).alias("caveats"),
    )


def calibration_verdict(curve: DataFrame, least_rho: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """One row from (true_synthetic_fraction, composite_index): Spearman's rho with p, and whether the index follows the share of synthetic text."""
    out = spearman(curve, "true_synthetic_fraction", "composite_index")
    return out.withColumn("supported", F.coalesce((F.col("rho") > least_rho) & (F.col("p") < alpha), F.lit(False)))
