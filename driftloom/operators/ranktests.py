"""Rank tests as aggregations. Windows run over distinct values, not over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.numeric import normal_tail, student_two_sided


def mann_whitney(df: DataFrame, value: str, first: Column, by: Sequence[str] = (), alternative: str = "two-sided") -> DataFrame:
    """(by, n1, n2, u, z, effect_r, p): U of the rows where `first` is true against the others; nulls of value or first don't count.

    z is corrected for ties and continuity and gives p (normal approximation); effect_r is
    |z| / sqrt(n1 + n2) of the uncorrected z.
    """
    rows = df.select(*by, F.col(value).alias("x"), first.alias("f")).where("x is not null and f is not null")
    ties = rows.groupBy(*by, "x").agg(F.count_if("f").alias("a"), F.count_if(~F.col("f")).alias("b")).withColumn("t", F.col("a") + F.col("b"))
    before = F.sum("t").over(Window.partitionBy(*[F.col(c) for c in by]).orderBy("x")) - F.col("t")
    ranked = ties.withColumn("rank", before + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    s = ranked.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(t**3 - t).alias("tie"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    mid = n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / F.when(n > 1, n * (n - 1))))
    plain = F.sqrt(n1 * n2 * (n + 1) / 12)
    gap = F.abs(u - mid) if alternative == "two-sided" else u - mid
    z = (gap - 0.5) / F.when(sd > 0, sd)
    out = s.select(*by, "n1", "n2", u.alias("u"), z.alias("z"), (F.abs(u - mid) / F.when(plain > 0, plain) / F.sqrt(n)).alias("effect_r"))
    return out.withColumn("p", F.least(F.lit(1.0), 2 * normal_tail("z")) if alternative == "two-sided" else normal_tail("z"))


def ks_statistic(df: DataFrame, value: str, first: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n1, n2, d): the largest gap between both empirical distributions."""
    rows = df.select(*by, F.col(value).alias("x"), first.alias("f")).where("x is not null and f is not null")
    ties = rows.groupBy(*by, "x").agg(F.count_if("f").alias("a"), F.count_if(~F.col("f")).alias("b"))
    keys = [F.col(c) for c in by]
    run, all_ = Window.partitionBy(*keys).orderBy("x"), Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(run) / F.sum("a").over(all_) - F.sum("b").over(run) / F.sum("b").over(all_))
    return ties.select(*by, "a", "b", gap.alias("g")).groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.max("g").alias("d"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, rho, p): correlation of average ranks and its two-sided p by Student's distribution; rows with a null in either don't count."""
    rows = df.select(*by, F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count("*").alias("w"))
    out = rows
    for c in ("x", "y"):
        t = rows.groupBy(*by, c).agg(F.sum("w").alias("t"))
        rank = F.sum("t").over(Window.partitionBy(*[F.col(k) for k in by]).orderBy(c)) - (F.col("t") - 1) / 2
        out = out.join(t.select(*by, c, rank.alias(f"r{c}")), [*by, c])
    w, a, b = F.col("w").cast("double"), F.col("rx"), F.col("ry")
    n = F.sum(w)
    cov = F.sum(w * a * b) - F.sum(w * a) * F.sum(w * b) / n
    var = (F.sum(w * a * a) - F.sum(w * a) ** 2 / n) * (F.sum(w * b * b) - F.sum(w * b) ** 2 / n)
    out = out.groupBy(*by).agg(F.sum("w").alias("n"), (cov / F.sqrt(F.when(var > 0, var))).alias("rho"))
    rest = 1 - F.col("rho") * F.col("rho")
    t = F.when(F.col("n") > 2, F.when(rest > 1e-12, F.abs("rho") * F.sqrt((F.col("n") - 2) / rest)).otherwise(1e9))
    return out.withColumn("p", F.when(F.col("rho").isNotNull(), student_two_sided(t, F.col("n") - 2)))


def bonferroni(tests: int, alpha: float = 0.01) -> float:
    return alpha / tests


def test_grid(values: DataFrame, baseline: int = 0, alpha: float = 0.01) -> DataFrame:
    """Every later generation of every signal against the baseline one: values has signal, k, value. significant: p below alpha over the number of tests."""
    base = values.where(F.col("k") == baseline).select("signal", "value")
    later = values.where(F.col("k") != baseline)
    ks = later.select("signal", "k").distinct()
    rows = later.select("signal", "k", "value", F.lit(False).alias("is_base")).unionByName(ks.join(base, "signal").select("signal", "k", "value", F.lit(True).alias("is_base")))
    tests = mann_whitney(rows, "value", F.col("is_base"), ["signal", "k"])
    return tests.crossJoin(F.broadcast(ks.agg(F.count("*").alias("tests")))).withColumn("significant", F.col("p") < F.lit(alpha) / F.col("tests"))


def decomposition(groups: DataFrame, human: str, domain: str, model: str) -> DataFrame:
    """Means and standard errors of three conditions (condition, value), and how the gap human - model splits into domain and contamination."""
    s = groups.groupBy("condition").agg(F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))
    pick = lambda c, f: F.max(F.when(F.col("condition") == c, F.col(f)))
    wide = s.agg(*[pick(c, f).alias(f"{f}_{n}") for n, c in (("human", human), ("domain", domain), ("model", model)) for f in ("m", "se")])
    gap = F.col("m_human") - F.col("m_model")
    return wide.select("*", gap.alias("gap"), ((F.col("m_human") - F.col("m_domain")) / gap * 100).alias("pct_domain"), ((F.col("m_domain") - F.col("m_model")) / gap * 100).alias("pct_contamination"))
