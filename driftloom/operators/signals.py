"""Early detection: series of signals over generations, in the long form (signal, direction, k, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Layer, metric and expected direction of the seven signals.
SIGNALS = {
    "ttr": ("lexical", "ttr", "decreasing"),
    "entropy_1gram": ("lexical", "entropy_1gram", "decreasing"),
    "kl_div_1gram": ("lexical", "kl_div_1gram", "increasing"),
    "zipf_alpha": ("lexical", "zipf_alpha", "increasing"),
    "avg_pairwise_cos_dist": ("semantic", "avg_pairwise_cosine_dist", "decreasing"),
    "tail_mass_fraction": ("tail_mass", "tail_mass_fraction", "decreasing"),
    "ppl_inversion_ratio": ("perplexity_inversion", "perplexity_inversion_ratio", "increasing"),
}
THRESHOLD_PCT, NEVER = 2.0, 999


def extract(records: DataFrame, signals: dict = SIGNALS) -> DataFrame:
    """Nested records (generation_k, layer structs) to the long form; a signal that a record lacks raises."""
    cells = [F.struct(F.lit(s).alias("signal"), F.lit(d).alias("direction"), F.col(f"{layer}.{metric}").cast("double").alias("value")) for s, (layer, metric, d) in signals.items()]
    return records.select(F.col("generation_k").alias("k"), F.explode(F.array(*cells)).alias("c")).select("c.signal", "c.direction", "k", "c.value")


def analyse(series: DataFrame, threshold: float = THRESHOLD_PCT) -> DataFrame:
    """Per signal: first generation beyond the threshold in its direction, monotone or not, effect, total change, rank."""
    w = Window.partitionBy("signal").orderBy("k")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g0 = F.first("value").over(all_)
    step = F.col("value") - F.lag("value").over(w)
    up = F.col("direction") == "increasing"
    change = F.when(g0 != 0, (F.col("value") - g0) / F.abs(g0) * 100).otherwise(0.0)
    rows = series.select("signal", "direction", "k", "value", change.alias("change"), F.when(up, step >= 0).otherwise(step <= 0).alias("ok"), F.last("value").over(all_).alias("last"), g0.alias("g0"))
    hit = (F.col("k") > 0) & F.when(up, F.col("change") > threshold).otherwise(F.col("change") < -threshold)
    n = F.count("*")
    total = F.max_by("change", "k")
    out = rows.groupBy("signal", "direction").agg(
        F.min(F.when(hit, F.col("k"))).alias("first_detection"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("is_monotonic"), (F.abs(F.first("last") - F.first("g0")) / (F.stddev_pop("value") + 1e-9)).alias("effect"),
        F.bround(total, 2).alias("total_effect_pct"), F.bround(total / F.when(n > 1, n - 1), 2).alias("rate_pct"), F.first("g0").alias("g0_value"), F.first("last").alias("g_final_value"),
    )
    out = out.withColumn("effect", F.bround("effect", 3))
    order = Window.orderBy(F.coalesce("first_detection", F.lit(NEVER)), F.col("effect").desc(), "signal")  # a row per signal
    return out.withColumn("rank", F.row_number().over(order))


def hypotheses(analysis: DataFrame) -> DataFrame:
    """One row: which signals fire before which."""
    at = lambda s: F.coalesce(F.max(F.when(F.col("signal") == s, F.coalesce("first_detection", F.lit(NEVER)))), F.lit(NEVER))
    wide = analysis.agg(at("tail_mass_fraction").alias("tail"), at("avg_pairwise_cos_dist").alias("semantic"), at("ppl_inversion_ratio").alias("ppl"), at("entropy_1gram").alias("lexical"))
    return wide.select("*", (F.col("tail") < F.col("semantic")).alias("h1"), (F.col("semantic") < F.col("lexical")).alias("h2"), (F.col("ppl") < F.col("tail")).alias("h3"))


def normalised(series: DataFrame) -> DataFrame:
    """Values over the first generation's, and the drop in percent."""
    g0 = F.first("value").over(Window.partitionBy("signal").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.select("signal", "k", "value", (F.col("value") / F.when(g0 != 0, g0)).alias("relative"), ((1 - F.col("value") / F.when(g0 != 0, g0)) * 100).alias("drop_pct"))


def upsert(records: DataFrame, fresh: DataFrame, key: str = "k") -> DataFrame:
    """records without the keys of fresh, and fresh."""
    return records.join(fresh.select(key).distinct(), key, "left_anti").select(records.columns).unionByName(fresh.select(records.columns))


def compare_conditions(a: DataFrame, b: DataFrame, value: str, key: str = "k", how: str = "inner") -> DataFrame:
    """Two conditions side by side; `left` keeps a's keys and takes 0 where b has none."""
    right = b.select(key, F.col(value).alias("other"))
    out = a.select(key, F.col(value).alias("value")).join(right, key, how)
    out = out.withColumn("other", F.coalesce("other", F.lit(0.0)))
    return out.withColumns({"difference": F.col("value") - F.col("other"), "verdict": F.when(F.col("value") > F.col("other"), "higher").when(F.col("value") < F.col("other"), "lower").otherwise("equal")})


def completeness(records: DataFrame, fields: list[str]) -> DataFrame:
    """(k, missing): how many of the fields each record lacks, nested names included."""
    return records.select(F.col("generation_k").alias("k"), sum(F.col(f).isNull().cast("int") for f in fields).alias("missing"))
