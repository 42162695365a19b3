"""Perplexity from a table of token losses (doc_id, pos, nll); pos starts at 1."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators import bigrams
from driftloom.operators.ranktests import spearman

#: Fixed values of the reference semantics.
COLD_START, TAIL, AT_CAP, SHORT = 16, 5, 130, (50, 70)
LENGTH_CUTS = (0, 75, 95, 115, 136)
BASELINE_PPL, MAX_PPL, BINS, MIDPOINT = 44.44, 10_000.0, 50, 22.5


class TokenScorer(Protocol):
    """Gives a loss for every token; a language model can be plugged in through mapInPandas."""

    def score(self, docs: DataFrame) -> DataFrame: ...


class BigramScorer:
    """Built-in stand-in for a neural scorer: unigrams and bigrams of a fitting cohort, interpolated.

    p(w | v) = lam c(v, w) / c(v) + (1 - lam) (c(w) + alpha) / (N + alpha (V + 1)); the first token of a
    document, and one after an unseen word, take the second part alone. Perplexities
    are its own and not comparable with any published model's.
    """

    def __init__(self, cohort: DataFrame, lam: float = 0.5, alpha: float = 1.0):
        self.cohort, self.lam, self.alpha = cohort, lam, alpha

    def score(self, docs: DataFrame, *keep: str, max_length: int | None = None) -> DataFrame:
        """(doc_id, keep.., pos, nll) of every token, or of the first max_length of each document."""
        return score_together([self], docs, *keep, max_length=max_length).withColumnRenamed("nll_0", "nll")


def score_together(scorers: Sequence[BigramScorer], docs: DataFrame, *keep: str, max_length: int | None = None) -> DataFrame:
    """(doc_id, keep.., pos, nll_0, nll_1, ..): the tokens are dealt out once for all scorers."""
    frame = docs.select("doc_id", *keep, "text", F.lit(1).alias("_fit"))
    empty = [F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in ("doc_id", *keep)]
    for k, s in enumerate(scorers):
        frame = frame.unionByName(s.cohort.select(*empty, "text", F.lit(2 << k).alias("_fit")))
    return _losses(frame, keep, [(s.lam, s.alpha) for s in scorers], max_length).drop("n_tokens")


def score_within(docs: DataFrame, fits: Sequence[Column | str], *keep: str, max_length: int | None = None, lam: float = 0.5, alpha: float = 1.0) -> DataFrame:
    """(doc_id, keep.., pos, n_tokens, nll_0, ..) of scorers whose cohorts are conditions on docs: texts are read once. n_tokens counts the scored ones of a document."""
    return _losses(bigrams.marked(docs, fits), keep, [(lam, alpha)] * len(fits), max_length)


def _losses(frame: DataFrame, keep: Sequence[str], models: Sequence[tuple[float, float]], max_length: int | None) -> DataFrame:
    p = bigrams.probabilities(frame, keep, models, max_length)
    return p.select("doc_id", *keep, "pos", "n_tokens", *[(-F.log(f"p_{k}")).alias(f"nll_{k}") for k in range(len(models))])


def doc_ppl(losses: DataFrame, *keep: str, max_length: int | None = None, window: int | None = None, stride: int | None = None, ordered: bool = False) -> DataFrame:
    """(doc_id, keep.., n, ppl) with ppl = exp(mean loss); documents of one token have none (null).

    max_length: only the first positions count. window and stride: overlapping windows,
    each weighing its mean loss with the positions it adds, the first with its whole
    length though its first token has no loss there, as the reference semantics have it.
    ordered: losses are added by position, so that equal texts have equal values to the last
    bit in every run; holds a document's losses in memory and doesn't go with windows.
    """
    if ordered and window is not None:
        raise ValueError("ordered sums are for whole documents, not for windows")
    used = losses if max_length is None else losses.where(F.col("pos") <= max_length)
    if ordered:
        cells = used.groupBy("doc_id", *keep).agg(F.sort_array(F.collect_list(F.struct("pos", "nll"))).alias("cells"))
        total = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["nll"])
        return cells.select("doc_id", *keep, F.size("cells").cast("long").alias("n"), F.when(F.size("cells") > 1, F.exp(total / F.size("cells"))).alias("ppl"))
    if window is None:
        return used.groupBy("doc_id", *keep).agg(F.count("*").alias("n"), F.when(F.count("*") > 1, F.exp(F.avg("nll"))).alias("ppl"))
    stride = stride or window // 2
    # each position lies in few windows, whose numbers follow from it; the last window's follows from the size
    low = F.greatest(F.ceil((F.col("pos") - window) / stride), F.lit(0))
    cells = used.where("doc_id is not null").select("doc_id", *keep, "pos", "nll", F.explode(F.sequence(low.cast("bigint"), F.floor((F.col("pos") - 1) / stride).cast("bigint"))).alias("k"))
    means = cells.groupBy("doc_id", *keep, "k").agg(F.max("pos").alias("last"), F.avg(F.when(F.col("pos") > F.col("k") * stride + 1, F.col("nll"))).alias("mean"))
    per = means.groupBy("doc_id", *keep).agg(F.max("last").alias("n"), F.sort_array(F.collect_list(F.struct("k", "mean"))).alias("cells"))

    def weight(k: Column) -> Column:
        return F.least(k * stride + window, F.col("n")) - F.when(k == 0, 0).otherwise(F.least((k - 1) * stride + window, F.col("n")))

    real = F.filter("cells", lambda c: c["mean"].isNotNull() & (c["k"] <= F.ceil(F.greatest(F.col("n") - window, F.lit(0)) / stride)))
    total = F.aggregate(real, F.lit(0.0), lambda s, c: s + c["mean"] * weight(c["k"]))
    return per.where(F.size(real) > 0).select("doc_id", *keep, "n", F.exp(total / F.col("n")).alias("ppl"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ppl_summary(ppls: DataFrame, by: Sequence[str] = (), low: float = 15.0, high: float = 30.0) -> DataFrame:
    ok = ppls.withColumn("v", F.when(finite(F.col("ppl")), F.col("ppl")))
    pct = lambda p: F.percentile("v", F.lit(p))
    return ok.groupBy(*by).agg(
        F.count("*").alias("n_documents"), F.count("v").alias("n_valid"), F.count_if(F.col("v").isNull()).alias("n_invalid"), F.avg("v").alias("mean_ppl"), F.stddev_pop("v").alias("std_ppl"), pct(0.5).alias("median_ppl"),
        pct(0.05).alias("pct5_ppl"), pct(0.25).alias("pct25_ppl"), pct(0.75).alias("pct75_ppl"), pct(0.95).alias("pct95_ppl"), F.min("v").alias("min_ppl"), F.max("v").alias("max_ppl"), F.avg("v").between(low, high).alias("mean_in_range"),
    )


def histogram(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """(bin, n) of equal-width bins from least to greatest; the last is closed. Empty bins have no row."""
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(w > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / w))).otherwise(0)
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # edge is one row


def ppl_ratio(ppls: DataFrame, baseline: float = BASELINE_PPL, cap: float = MAX_PPL, by: Sequence[str] = ()) -> DataFrame:
    """(by, ..): mean perplexity of the valid documents below cap, and baseline / mean; without `by` one row."""
    return ppls.where(finite(F.col("ppl")) & (F.col("ppl") < cap)).groupBy(*by).agg(F.avg("ppl").alias("mean_ppl"), (F.lit(baseline) / F.avg("ppl")).alias("ppl_ratio_vs_baseline"), F.count("*").alias("n_valid"))


def inversion(ppl_g0: DataFrame, ppl_gk: DataFrame) -> DataFrame:
    """One row of the ratio ppl_G0 / ppl_Gk over documents valid under both, joined by id."""
    named = lambda d, n: d.select("doc_id", F.col("ppl").alias(n))
    return inversion_of(named(ppl_g0, "p0").join(named(ppl_gk, "pk"), "doc_id"))


def inversion_of(ppls: DataFrame) -> DataFrame:
    """As inversion(), from one table (p0, pk)."""
    r = ppls.where(finite(F.col("p0")) & finite(F.col("pk"))).withColumn("r", F.col("p0") / F.col("pk"))
    return r.agg(F.count("*").alias("n_valid_samples"), F.avg("p0").alias("ppl_under_g0"), F.avg("pk").alias("ppl_under_gk"), F.avg("r").alias("perplexity_inversion_ratio"), F.stddev_pop("r").alias("std_ppl_inversion_ratio"), (F.avg("r") - 1).alias("ratio_deviation_from_1"))


def ppl_under_gk(ratios: DataFrame) -> DataFrame:
    """ppl_Gk = reference / ratio, where a record has ratios but no perplexities."""
    return ratios.withColumn("ppl_gk", F.coalesce("ppl_gk", F.col("ppl_ref") / F.when(F.col("ratio") != 0, F.col("ratio"))))


def position_buckets(losses: DataFrame, width: int = 15, first: int = 2) -> DataFrame:
    """(bucket, low, high, n, mean_nll, ppl) of positions from `first`."""
    b = F.floor((F.col("pos") - first) / width)
    return losses.where(F.col("pos") >= first).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg("nll").alias("mean_nll")).select("bucket", (F.col("bucket") * width + first).alias("low"), (F.col("bucket") * width + first + width - 1).alias("high"), "n", "mean_nll", F.exp("mean_nll").alias("ppl"))


def decreasing(buckets: DataFrame, order: str, value: str) -> DataFrame:
    """One row: whether value never rises in the order; over a table of buckets."""
    w = Window.orderBy(order)
    return buckets.select((F.col(value) <= F.lag(value).over(w)).alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("monotone"))


def tail_losses(losses: DataFrame, k: int = TAIL) -> DataFrame:
    """(doc_id, at_cap, nll) of the last k positions of documents at the cap and of short ones; losses has every position and n_tokens."""
    cohort = F.when(F.col("n_tokens") >= AT_CAP, True).when(F.col("n_tokens").between(*SHORT), False)
    return losses.where(F.col("pos") > F.col("n_tokens") - k).select("doc_id", cohort.alias("at_cap"), "nll").where("at_cap is not null")


def cold_start(losses: DataFrame, skip: int = COLD_START, tail: int = TAIL, midpoint: float = MIDPOINT) -> DataFrame:
    """One row: mean perplexity of whole documents, without the first `skip` losses, and also without the last `tail` of documents at the cap; what each cut takes, and the gap to midpoint.

    losses has every position of its documents, from 1, and their n_tokens: places follow without a window.
    """
    warm = F.col("pos") > skip
    both = warm & ((F.col("n_tokens") < AT_CAP) | (F.col("pos") <= F.col("n_tokens") - tail))
    per = losses.groupBy("doc_id").agg(F.exp(F.avg("nll")).alias("whole"), F.exp(F.avg(F.when(warm, F.col("nll")))).alias("warm"), F.exp(F.avg(F.when(both, F.col("nll")))).alias("both"))
    out = per.agg(F.avg("whole").alias("whole_ppl"), F.avg("warm").alias("excl_coldstart_ppl"), F.avg("both").alias("excl_both_ppl"), F.count("warm").alias("n_warm"))
    return out.select("*", (F.col("whole_ppl") - F.col("excl_coldstart_ppl")).alias("coldstart_reduction"), (F.col("excl_coldstart_ppl") - F.col("excl_both_ppl")).alias("tail_reduction"), (F.col("whole_ppl") - midpoint).alias("total_gap"), (F.col("excl_both_ppl") - midpoint).alias("remaining_gap"))


def length_bucket(n: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high in list(zip(LENGTH_CUTS, LENGTH_CUTS[1:], strict=False))[::-1]:
        out = F.when((n >= low) & (n < high), f"{low}-{high - 1}").otherwise(out)
    return out


def length_sensitivity(ppls: DataFrame) -> DataFrame:
    """(bucket, n, mean, median, std) of ppl by n_tokens; longer documents have no bucket and drop out."""
    return ppls.withColumn("bucket", length_bucket(F.col("n_tokens"))).where("bucket is not null and ppl is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.avg("ppl").alias("mean_ppl"), F.percentile("ppl", F.lit(0.5)).alias("median_ppl"), F.stddev_pop("ppl").alias("std_ppl"))


def length_verdict(ppls: DataFrame, alpha: float = 0.01) -> DataFrame:
    """One row: Spearman's rho of length and perplexity with p, whether the buckets' means never rise, and whether longer documents are less perplexing (p below alpha, rho negative)."""
    used = ppls.where(length_bucket(F.col("n_tokens")).isNotNull())
    low = F.create_map(*[F.lit(x) for a, b in zip(LENGTH_CUTS, LENGTH_CUTS[1:], strict=False) for x in (f"{a}-{b - 1}", a)])
    means = length_sensitivity(ppls).withColumn("low", low[F.col("bucket")])
    out = spearman(used, "n_tokens", "ppl").crossJoin(F.broadcast(decreasing(means, "low", "mean_ppl")))  # one row each
    return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("supported", F.coalesce((F.col("p") < alpha) & (F.col("rho") < 0), F.lit(False)))
