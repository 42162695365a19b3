"""Lexical statistics. `by` names the columns of the cohorts; () is the whole input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.numeric import relative_change
from driftloom.functions.text import ngrams, tokens
from driftloom.operators import grams
from driftloom.scratch import materialise

#: Fixed values of the reference semantics.
TOP_UNIGRAMS, TOP_TRIGRAMS, RARE = 50_000, 100_000, 5
ZIPF_PASS, ZIPF_WARN = (0.8, 1.2), (0.6, 1.5)


def token_counts(docs: DataFrame, by: Sequence[str] = (), n: int = 1) -> DataFrame:
    """(by, ngram, cnt). Counts are combined before the shuffle, so frequent words cost one row a block or task."""
    if n == 1:
        return grams.word_counts(docs, by)
    t = docs.select(*by, tokens(F.col("text")).alias("_t"))
    return t.select(*by, F.explode(ngrams(F.col("_t"), n)).alias("ngram")).groupBy(*by, "ngram").agg(F.count("*").alias("cnt"))


def doc_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """Per document: n_tokens, n_types, ttr (null without tokens); no shuffle."""
    t = docs.select("doc_id", *keep, tokens(F.col("text")).alias("_t"))
    n, v = F.size("_t"), F.size(F.array_distinct("_t"))
    return t.select("doc_id", *keep, n.alias("n_tokens"), v.alias("n_types"), F.when(n > 0, v / n).alias("ttr"))


def ttr_summary(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation and median of the documents' TTR; documents without tokens don't count."""
    return doc_stats(docs, *by).where("n_tokens > 0").groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg("ttr").alias("mean_ttr"), F.stddev_pop("ttr").alias("std_ttr"), F.percentile("ttr", F.lit(0.5)).alias("median_ttr"))


def shape(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of n-gram counts: total, types, ttr, entropy in bits, hapax and rare counts and shares."""
    s = F.sum("cnt")
    return counts.groupBy(*by).agg(
        s.alias("total"), F.count("*").alias("types"), (F.count("*") / s).alias("ttr"),
        F.greatest(F.lit(0.0), F.log2(s) - F.sum(F.col("cnt") * F.log2("cnt")) / s).alias("entropy"),
        F.count_if(F.col("cnt") == 1).alias("hapax"), F.count_if(F.col("cnt") <= RARE).alias("rare"),
        (F.count_if(F.col("cnt") == 1) / F.count("*")).alias("hapax_share"), (F.count_if(F.col("cnt") <= RARE) / F.count("*")).alias("rare_share"),
    )


#: Ranks up to here are summed one by one, those beyond by Euler-Maclaurin, whose error there is below 1e-12.
_EXACT_RANKS = 64


def _log_sums(a: Column, b: Column) -> tuple[Column, Column]:
    """Sums of ln r and of (ln r)^2 over ranks a..b, in constant time for long blocks of ties."""

    def tail(low: Column, high: Column, power: int) -> Column:
        def f(x):
            return F.log(x) if power == 1 else F.log(x) ** 2

        def integral(x):
            return x * F.log(x) - x if power == 1 else x * F.log(x) ** 2 - 2 * x * F.log(x) + 2 * x

        def slope(x):
            return 1 / x if power == 1 else 2 * F.log(x) / x

        def third(x):
            return 2 / x**3 if power == 1 else (4 * F.log(x) - 6) / x**3

        return integral(high) - integral(low) + (f(low) + f(high)) / 2 + (slope(high) - slope(low)) / 12 - (third(high) - third(low)) / 720

    head_end = F.least(b, F.lit(_EXACT_RANKS))
    head = F.when(a <= head_end, F.sequence(a, head_end)).otherwise(F.array().cast("array<bigint>"))
    low, high = F.greatest(a, F.lit(_EXACT_RANKS + 1)).cast("double"), b.cast("double")
    out = []
    for power in (1, 2):
        logs = F.transform(head, lambda r: F.log(r.cast("double")))
        exact = F.aggregate(logs if power == 1 else F.transform(logs, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)
        out.append(exact + F.when(high >= low, tail(low, high, power)).otherwise(0.0))
    return out[0], out[1]


def zipf(counts: DataFrame, by: Sequence[str] = (), shift: float = 0.0, least_types: int = 1) -> DataFrame:
    """Least-squares line of ln count on ln rank: alpha (the negated slope), log_c, r2, types and a verdict.

    Equal counts are one block of consecutive ranks, so the window runs over distinct
    counts - at most the root of twice the tokens - not over the vocabulary. shift is
    added to counts before the logarithm; below least_types alpha is null.
    """
    blocks = counts.groupBy(*by, "cnt").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*[F.col(c) for c in by]).orderBy(F.col("cnt").desc())
    end = F.sum("m").over(w)
    blocks = blocks.withColumn("b", end).withColumn("a", F.col("b") - F.col("m") + 1)
    sx, sxx = _log_sums(F.col("a"), F.col("b"))
    y = F.log(F.col("cnt") + F.lit(shift)) if shift else F.log("cnt")
    sums = blocks.select(*by, "m", sx.alias("sx"), sxx.alias("sxx"), y.alias("y")).groupBy(*by).agg(
        F.sum("m").alias("types"), F.sum("sx").alias("x"), F.sum("sxx").alias("xx"), F.sum(F.col("m") * F.col("y")).alias("y"), F.sum(F.col("sx") * F.col("y")).alias("xy"), F.sum(F.col("m") * F.col("y") ** 2).alias("yy")
    )
    n = F.col("types")
    cxx, cxy, cyy = n * F.col("xx") - F.col("x") ** 2, n * F.col("xy") - F.col("x") * F.col("y"), n * F.col("yy") - F.col("y") ** 2
    slope = cxy / F.when(n > 1, cxx)
    fit = sums.select(*by, "types", F.when(n >= least_types, -slope).alias("alpha"), ((F.col("y") - slope * F.col("x")) / n).alias("log_c"), (cxy**2 / F.when(cyy * cxx > 1e-12, cxx * cyy)).alias("r2"))
    verdict = F.when(F.col("alpha").between(*ZIPF_PASS), "pass").when(F.col("alpha").between(*ZIPF_WARN), "warn").otherwise("fail")
    return fit.withColumn("verdict", verdict)


def smoothed_baseline(counts: DataFrame, top: int = TOP_UNIGRAMS) -> DataFrame:
    """(ngram, cnt, p) of the `top` most frequent n-grams, p = (c+1) / (N + V) over the whole vocabulary; ties by n-gram."""
    total = counts.agg(F.sum("cnt").alias("_n"), F.count("*").alias("_v"))
    few = counts.orderBy(F.col("cnt").desc(), "ngram").limit(top)
    return few.crossJoin(F.broadcast(total)).select("ngram", "cnt", ((F.col("cnt") + 1) / (F.col("_n") + F.col("_v"))).alias("p"))  # total is one row


def first_seen_baseline(docs: DataFrame, top: int = TOP_UNIGRAMS) -> DataFrame:
    """(ngram, cnt, p) of the first `top` words met in the order of doc_id and place; p = c / N."""
    t = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "ngram"))
    counts = t.groupBy("ngram").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("first"))
    total = counts.agg(F.sum("cnt").alias("_n"))
    return counts.orderBy("first").limit(top).crossJoin(F.broadcast(total)).select("ngram", "cnt", (F.col("cnt") / F.col("_n")).alias("p"))


def kl(counts: DataFrame, baseline: DataFrame, by: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """(by, kl) of cohorts' counts against a stored baseline, in bits.

    The baseline's p is smoothed as the reference semantics have it: S is the stored
    mass, V the stored size, b = (p S + alpha) / (S + alpha (V + 1)). As S is near 1 this is almost
    uniform over V + 2; kl_corrected smooths counts instead.
    """
    size = baseline.agg(F.sum("p").alias("_s"), F.count("*").alias("_v"))
    b = (F.coalesce("p", F.lit(0.0)) * F.col("_s") + alpha) / (F.col("_s") + alpha * (F.col("_v") + 1))
    return _divergence(counts, baseline.select("ngram", "p"), size, b, by)


def kl_corrected(counts: DataFrame, baseline_counts: DataFrame, by: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """(by, kl) with the baseline's counts smoothed: b = (c + alpha) / (N + alpha (V + 1))."""
    size = baseline_counts.agg(F.sum("cnt").alias("_s"), F.count("*").alias("_v"))
    b = (F.coalesce("p", F.lit(0)) + alpha) / (F.col("_s") + alpha * (F.col("_v") + 1))
    return _divergence(counts, baseline_counts.select("ngram", F.col("cnt").alias("p")), size, b, by)


def _divergence(counts: DataFrame, stored: DataFrame, size: DataFrame, b: Column, by: Sequence[str]) -> DataFrame:
    # sum g log2(g/b) = (sum c log2(c/b)) / N - log2 N: one pass, no join of totals back to the counts
    joined = counts.join(stored, "ngram", "left").crossJoin(F.broadcast(size))  # size is one row
    part = F.sum(F.col("cnt") * (F.log2("cnt") - F.log2(b)))
    n = F.sum("cnt")
    return joined.groupBy(*by).agg(F.greatest(F.lit(0.0), part / n - F.log2(n)).alias("kl"))


def layer(docs: DataFrame, baseline: DataFrame, by: Sequence[str] = (), baseline_entropy: float | None = None) -> DataFrame:
    """All lexical metrics of each cohort: ttr, entropies, kl, Zipf alpha (0 below ten types), hapax share."""
    uni, baseline = materialise(token_counts(docs, by), "words"), materialise(baseline, "baseline")  # three readers, two
    total = uni.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    out = shape(uni, by).select(*by, F.col("total").alias("n_tokens"), "ttr", F.col("entropy").alias("entropy_1gram"), F.col("hapax_share").alias("zipf_tail_mass"))
    join = (lambda a, b: a.join(b, list(by), "left")) if by else (lambda a, b: a.crossJoin(b))  # one row each without cohorts
    for n in (2, 3):
        s = F.col("total")
        entropy = F.greatest(F.lit(0.0), F.log2(s) - F.col("weighted") / s)
        sums = materialise(grams.shape_sums(docs, by, n, total), f"grams-{n}")  # a row a cohort; its shuffle files go
        out = join(out, sums.select(*by, entropy.alias(f"entropy_{n}gram")))
    out = join(out, kl(uni, baseline, by).select(*by, F.col("kl").alias("kl_div_1gram")))
    out = join(out, zipf(uni, by, shift=1e-9, least_types=10).select(*by, F.coalesce("alpha", F.lit(0.0)).alias("zipf_alpha")))
    if baseline_entropy is not None:
        out = out.withColumn("entropy_1gram_rel_change", relative_change(F.col("entropy_1gram"), F.lit(baseline_entropy)))
    return out.na.fill(0.0, ["entropy_2gram", "entropy_3gram"])


def corpus_stats(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Documents, tokens, vocabulary, TTR and the documents' mean, deviation, least and most tokens."""
    # one pass: a row per word of a document, the first of which also stands for the document
    t = docs.select(*by, tokens(F.col("text")).alias("_t"))
    words = t.select(*by, F.size("_t").cast("long").alias("_n"), F.posexplode_outer("_t").alias("_pos", "_w"))
    first = F.col("_pos").isNull() | (F.col("_pos") == 0)
    n = F.when(first, F.col("_n"))
    per_word = words.groupBy(*by, "_w").agg(F.count(n).alias("d"), F.sum(n).alias("s"), F.sum(n * n).alias("q"), F.min(n).alias("lo"), F.max(n).alias("hi"))
    both = per_word.groupBy(*by).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_tokens"), F.sum("q").alias("q"), F.min("lo").alias("min_tokens"), F.max("hi").alias("max_tokens"), F.count("_w").alias("n_types"))
    docs_ = F.when(F.col("n_docs") > 0, F.col("n_docs"))
    mean = F.col("n_tokens") / docs_
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / docs_ - mean * mean))
    cast = lambda c: F.col(c).cast("int").alias(c)
    both = both.select(*by, "n_docs", "n_tokens", mean.alias("mean_tokens"), spread.alias("std_tokens"), cast("min_tokens"), cast("max_tokens"), "n_types")
    return both.withColumn("ttr", F.when(F.col("n_tokens") > 0, F.col("n_types") / F.col("n_tokens")).otherwise(0.0))
