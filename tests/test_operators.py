"""Operators against small re-implementations, published figures and directional cases."""

import html
import math
import tracemalloc
import types
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import text as tx
from driftloom.functions.numeric import normal_tail
from driftloom.operators import dedup, density, lexical, nll, ranktests, sampling, score, signals, validation, vectors
from driftloom.plans.baseline import Baseline, Config, build_corpus
from driftloom.plans.golden import COMPOSITE_INDEX, COMPOSITE_ROWS, GENERATION_ROWS
from driftloom.plans.layers import score_dataset
from driftloom.sources import readers, writers

SF = "/root/testdata/sf0.001"


def texts(spark, *xs):
    return spark.createDataFrame(list(enumerate(xs)), "doc_id long, text string")


def values(df, col):
    return [r[0] for r in df.orderBy("doc_id").select(col).collect()]


# ------------------------------------------------------------ text
def test_tokens_equal_python(spark):
    xs = ["a b", "  a\tb\n", "", "a b\u001cc d\u0085e", "x　y z​w", None]
    got = values(texts(spark, *xs), tx.tokens(F.col("text")).alias("t"))
    assert got == [(x or "").split() for x in xs]


def test_cleaner_cases(spark):
    cases = {
        "The café in [[Paris]] serves naïve tourists.": "The café in Paris serves naïve tourists.",
        "Fish &amp; chips": "Fish & chips",
        "Score: &lt;100&gt;": "Score: <100>",
        "#REDIRECT [[x]]": "",
        "  #Redirect [[x]]  ": "",
        "a{{b{{c}}d}}e": "ae",
        "a}}b": "ab",
        "a{{b": "a",
        "café": "café",
        "[[File:x.jpg|thumb|cap]]": "thumb|cap",
        "[[t|shown]] [http://a.b text here] [http://a.b]": "shown text here",
        "==Head==\n\n\n\ntext": "Head\n\ntext",
        "a <b>c</b>": "a c",
    }
    assert values(texts(spark, *cases), tx.clean_wiki(F.col("text"))) == list(cases.values())
    assert values(texts(spark, "a&nbsp;b  c\n\n\n\nd ", "#redirect x"), tx.clean_light(F.col("text"))) == ["a b c\n\nd", ""]


def test_templates_equal_the_depth_rule():
    rng = np.random.default_rng(0)
    for _ in range(500):
        t = "".join(rng.choice(["{{", "}}", "{", "}", "a", "b"], rng.integers(0, 12)))
        out, depth, i = "", 0, 0
        while i < len(t):
            two = t[i : i + 2]
            if two in ("{{", "}}"):
                depth = depth + 1 if two == "{{" else max(0, depth - 1)
                i += 2
            else:
                out += t[i] if depth == 0 else ""
                i += 1
        assert tx._without_templates(t) == out


def test_encoding_filter(spark):
    xs = ["plain", "bad �", "Ελληνικά γράμματα", "a" * 99 + "​", "a" * 98 + "​\x00", "", "line\nfeed\ttab"]

    def rule(t):
        control = sum(unicodedata.category(c) in ("Cc", "Cf") and c not in "\n\t" for c in t)
        return "�" not in t and not control > len(t) * 0.01 and not sum(ord(c) > 127 for c in t) > len(t) * 0.3

    assert values(texts(spark, *xs), tx.encoding_ok(F.col("text"))) == [rule(x) for x in xs]


def test_short_documents_have_no_long_ngrams(spark):
    got = values(texts(spark, "", "a", "a b", "a b c d"), tx.ngrams(tx.tokens(F.col("text")), 3))
    assert got == [[], [], [], ["a b c", "b c d"]]
    assert values(texts(spark, "abcd", "abcdeABCDE"), tx.shingles(F.col("text"))) == [[], ["abcde", "bcdea", "cdeab", "deabc", "eabcd"]]


def test_entities_decode_like_the_library(spark):
    x = "&eacute;&notanentity;&#x41;&hellip;"
    assert values(texts(spark, x), tx.decode_normalise(F.col("text"))) == [unicodedata.normalize("NFKC", html.unescape(x))]


# ------------------------------------------------------------ lexical
def test_lexical_small(spark):
    docs = texts(spark, *["the cat sat on the mat"] * 100)
    s = lexical.shape(lexical.token_counts(docs)).first()
    c = Counter("the cat sat on the mat".split())
    assert s.ttr == 5 / 600 and s.entropy == pytest.approx(-sum(v / 6 * math.log2(v / 6) for v in c.values()))
    one = lexical.shape(lexical.token_counts(texts(spark, *["the " * 7] * 200))).first()
    assert one.ttr == 1 / 1400 and one.entropy == 0


def test_kl_literal_form(spark):
    base = spark.createDataFrame([("the", 0.05), ("cat", 0.02), ("sat", 0.02), ("on", 0.03), ("mat", 0.01), ("a", 0.04), ("in", 0.03)], "ngram string, p double")
    got = lexical.kl(lexical.token_counts(texts(spark, "the the the")), base).first().kl
    assert got == pytest.approx(math.log2(1 / ((0.05 * 0.2 + 1) / (0.2 + 8))), abs=1e-9)


def test_zipf_of_long_tie_blocks_equals_plain_regression(spark):
    rng = np.random.default_rng(3)
    counts = np.sort(np.maximum(1, (3000 / np.arange(1, 4001) ** 1.05).astype(int) + rng.integers(0, 2, 4000)))[::-1]
    df = spark.createDataFrame([(f"w{i}", int(c)) for i, c in enumerate(counts)], "ngram string, cnt long")
    x, y = np.log(np.arange(1, 4001)), np.log(counts)
    slope, icept = np.polyfit(x, y, 1)
    got = lexical.zipf(df).first()
    assert got.alpha == pytest.approx(-slope, abs=1e-9) and got.log_c == pytest.approx(icept, abs=1e-8)
    assert got.r2 == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, abs=1e-9) and got.verdict in ("pass", "warn")
    assert lexical.zipf(df.limit(5), least_types=10).first().alpha is None


# ------------------------------------------------------------ near duplicates
def sequential(docs):
    ab = dedup.coefficients()
    import hashlib

    kept, out = [], {}
    for i, t in sorted(docs):
        low = t.lower()
        grams = {low[k : k + 5] for k in range(len(low) - 4)}
        h = np.array([int(hashlib.sha256(g.encode()).hexdigest(), 16) % 2**31 for g in grams], dtype=np.int64)
        sig = ((ab[:, :1] * h + ab[:, 1:]) % (2**31 - 1)).min(axis=1) if len(h) else np.full(128, np.iinfo(np.int64).max)
        out[i] = not any((sig == s).mean() >= 0.85 for s in kept)
        if out[i]:
            kept.append(sig)
    return out


def test_greedy_dedup_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(60)]
    docs = []
    for i in range(90):
        w = list(words if i % 3 else words[::-1])
        for p in rng.integers(0, 60, rng.integers(0, 4)):
            w[p] = f"edit{rng.integers(0, 9)}"
        docs.append((i, " ".join(w)))
    docs += [(100, "abcd"), (101, "xy"), (102, ""), (103, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sequential(docs)
    assert 5 < sum(want.values()) < 90
    assert {r.doc_id: r.kept for r in dedup.greedy_dedup(df).collect()} == want
    assert {r.doc_id: r.kept for r in dedup.greedy_dedup(df, pairs_per_cell=0.5).collect()} == want  # with leaders


def test_bands_leave_no_match_out():
    cuts = dedup.bands()
    assert len(cuts) == 20 and sum(n for _, n in cuts) == 128 and cuts[0][0] == 0


# ------------------------------------------------------------ statistics
def test_rank_tests_on_small_samples(spark):
    a, b = [1, 2, 2, 3, 9], [2, 4, 5, 5, 6, 7]
    df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b] + [(None, True)], "v double, f boolean")
    r = ranktests.mann_whitney(df, "v", F.col("f")).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n = 11
    tie = 3**3 - 3 + 2**3 - 2
    z = (abs(u - 15) - 0.5) / math.sqrt(30 / 12 * ((n + 1) - tie / (n * (n - 1))))
    assert r.u == u and r.z == pytest.approx(z) and r.p == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert r.effect_r == pytest.approx(abs(u - 15) / math.sqrt(30 * 12 / 12) / math.sqrt(n))
    d = ranktests.ks_statistic(df, "v", F.col("f")).first().d
    assert d == pytest.approx(max(abs(sum(x <= t for x in a) / 5 - sum(x <= t for x in b) / 6) for t in a + b))
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (3.0, 4.0), (9.0, 1.0)], "x double, y double")
    ra, rb = [1, 2, 3.5, 3.5, 5], [2.5, 2.5, 5, 4, 1]
    assert ranktests.spearman(pairs, "x", "y").first().rho == pytest.approx(np.corrcoef(ra, rb)[0, 1])
    assert ranktests.bonferroni(9) == pytest.approx(0.01 / 9)
    assert spark.range(1).select(normal_tail(F.lit(1.0))).first()[0] == pytest.approx(0.15865525)


def test_decomposition(spark):
    rows = [("h", 40.0), ("h", 44.0), ("d", 30.0), ("d", 34.0), ("m", 10.0), ("m", 14.0)]
    r = ranktests.decomposition(spark.createDataFrame(rows, "condition string, value double"), "h", "d", "m").first()
    assert r.gap == 30 and r.pct_domain == pytest.approx(100 / 3) and r.pct_contamination == pytest.approx(200 / 3) and r.se_human == pytest.approx(2)


def test_published_composites(spark):
    df = spark.createDataFrame(COMPOSITE_ROWS, "fraction double, ttr double, kl double, ppl_ratio double, coverage double")
    assert {r.fraction: r.composite_index for r in score.composite(df).collect()} == COMPOSITE_INDEX
    story = spark.createDataFrame([(0.061416, 5.0, None, 1.0)], "ttr double, kl double, ppl_ratio double, coverage double")
    assert score.composite(story, score.STORY_ANCHORS).first().lexical_ttr == 0.9367 and score.composite(story).first().lexical_ttr == 0.9452


def test_published_signal_analysis(spark):
    want = {  # direction aside: first generation, monotone, effect, total change in percent
        "zipf_alpha": (1, True, 2.622, 24.84), "ttr": (1, True, 2.569, -47.92), "ppl_inversion_ratio": (1, True, 2.516, 172.54), "kl_div_1gram": (2, True, 2.467, 6.45),
        "entropy_1gram": (2, True, 2.466, -3.09), "tail_mass_fraction": (None, False, 2.223, 28.59), "avg_pairwise_cos_dist": (None, False, 0.592, -0.1),
    }
    nested = {}
    for s, (layer, metric, _) in signals.SIGNALS.items():
        for k, v in enumerate(GENERATION_ROWS[s]):
            nested.setdefault(k, {}).setdefault(layer, {})[metric] = v
    kinds = {}
    for layer, metric, _ in signals.SIGNALS.values():
        kinds.setdefault(layer, []).append(metric)
    schema = "generation_k int, " + ", ".join(f"{layer} struct<{', '.join(f'{m}: double' for m in ms)}>" for layer, ms in kinds.items())
    records = spark.createDataFrame([(k, *[tuple(nested[k][layer][m] for m in ms) for layer, ms in kinds.items()]) for k in nested], schema)
    rows = signals.analyse(signals.extract(records)).orderBy("rank").collect()
    assert {r.signal: (r.first_detection, r.is_monotonic, r.effect, r.total_effect_pct) for r in rows} == want
    assert [r.signal for r in rows] == list(want)
    h = signals.hypotheses(signals.analyse(signals.extract(records))).first()
    assert (h.h1, h.h2, h.h3) == (False, False, True)
    assert {r.missing for r in signals.completeness(records, ["lexical.ttr", "semantic.avg_pairwise_cosine_dist"]).collect()} == {0}


# ------------------------------------------------------------ vectors and density
def test_cosine_identity_and_degenerate_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 6))
    x[3] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    want = 1 - (u @ u.T)[np.triu_indices(40, 1)].mean()
    assert vectors.cosine_diversity(df).first().avg_cos_dist == pytest.approx(want, abs=1e-12)
    same = spark.createDataFrame([(i, [1.0] * 8) for i in range(50)], "id long, vec array<double>")
    assert vectors.cosine_diversity(same).first().avg_cos_dist == pytest.approx(0, abs=1e-12)
    assert vectors.nn_coverage(same.limit(1), same).first().coverage == 0.0 and vectors.nn_coverage(same, same.limit(9)).first().coverage == 0.0


def test_pca_is_centred_and_signed(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    p = vectors.fit_pca(df, 2)
    low = np.array([r.vec for r in vectors.project(df, p).orderBy("id").collect()])
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(low), np.abs((x - x.mean(0)) @ vt[:2].T)) and p["components"][0][0] > 0
    assert np.allclose(p["ratios"], (s**2 / (s**2).sum())[:2]) and vectors.variance_dim(df, 5) == int(np.searchsorted(np.cumsum(s**2 / (s**2).sum()), 0.95) + 1)
    assert 0 <= vectors.gmm_coverage(df, df, 3) <= 1


def test_kde_equals_the_sum_of_kernels(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    kde = density.Kde.fit(df.where("id < 30"), "scott")
    assert kde.bandwidth == pytest.approx(30 ** (-1 / 7))
    h = kde.bandwidth
    want = [math.log(sum(math.exp(-((a - b) ** 2).sum() / 2 / h / h) for b in x[:30]) / 30 / (h * math.sqrt(2 * math.pi)) ** 3) for a in x]
    got = [r.ll for r in density.log_likelihood(df, kde).orderBy("id").collect()]
    assert np.allclose(got, want)
    scores = density.bandwidth_scores(df.withColumn("fold", (F.col("id") % 5).cast("int")), grid=(0.1, 0.5, 2.0))
    assert density.best_bandwidth(scores) == 0.5


# ------------------------------------------------------------ perplexity
def test_log_sums_equal_all_terms():
    """Also of nearest points that come late, of points out of all reach and of rows without points."""
    rng = np.random.default_rng(0)
    x, b = rng.normal(size=(9, 4)), np.concatenate([rng.normal(size=(40, 4)) + 50, rng.normal(size=(40, 4)), rng.normal(size=(3, 4)) * 1e-3])
    own, of = np.arange(9) % 3, np.arange(len(b)) % 3
    tiles = lambda: ((np.flatnonzero((own != f) & (np.arange(9) < 8)), b[a : a + 20][of[a : a + 20] == f]) for a in range(0, len(b), 20) for f in range(3))
    got = density._log_sums(x, density.GRID, tiles())
    d2 = ((x[:, None] - b[None]) ** 2).sum(axis=2)
    for k, h in enumerate(density.GRID):
        for i in range(8):
            e = -d2[i, of != own[i]] / (2 * h * h)
            assert got[k, i] == pytest.approx(e.max() + math.log(np.exp(e - e.max()).sum()), rel=1e-9)
    assert (got[:, 8] == -np.inf).all()


def test_densities_hold_small_arrays_only():
    """A row's distances to 40,000 points at once were 64 MB an array, several arrays a worker."""
    rng = np.random.default_rng(0)
    x, b, kept = rng.normal(size=(512, 8)), rng.normal(size=(40_000, 8)), {}

    class Frame:
        def withColumn(self, *_):
            return self

    def run(df, base, fn, *_):
        tracemalloc.start()
        kept["ll"] = fn({}, x, (np.arange(len(b)), b), None)["ll"]
        kept["peak"] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return Frame()

    old, density.map_against = density.map_against, run
    try:
        density.log_likelihood(None, density.Kde(types.SimpleNamespace(n=len(b), dims=8), 0.5))
    finally:
        density.map_against = old
    assert kept["peak"] < 8 << 20 and np.isfinite(kept["ll"]).all()


def test_baselines_of_several_blocks_give_the_same(spark, monkeypatch):
    """What once was too large to broadcast; slices within a worker are small, too."""
    from driftloom.plans import queries

    names = ["nn_coverage", "kde_loglik", "tail_mass", "bandwidth_scores", "intrinsic_dim_2nn"]
    run = lambda: {n: sorted(map(tuple, queries.QUERIES[n](spark, "/root/testdata/sf0.001").collect())) for n in names}
    whole = run()
    monkeypatch.setattr(vectors, "BASE_BYTES", 40_000)
    monkeypatch.setattr(vectors, "CELLS", 20_000)
    blocks = run()
    for n in names:
        assert len(blocks[n]) == len(whole[n])
        for a, b in zip(blocks[n], whole[n], strict=True):
            assert a == pytest.approx(b, rel=1e-6), n


def test_ppl_forms(spark):
    losses = spark.createDataFrame([(1, p, p / 10) for p in range(1, 41)] + [(2, 1, 1.0)], "doc_id long, pos int, nll double")
    got = {r.doc_id: r.ppl for r in nll.doc_ppl(losses).collect()}
    assert got[1] == pytest.approx(math.exp(np.mean(np.arange(1, 41) / 10))) and got[2] is None
    x = np.arange(1, 41) / 10
    total = x[1:16].mean() * 16 + x[9:24].mean() * 8 + x[17:32].mean() * 8 + x[25:40].mean() * 8
    assert {r.doc_id: r.ppl for r in nll.doc_ppl(losses.where("doc_id = 1"), window=16, stride=8).collect()}[1] == pytest.approx(math.exp(total / 40))
    b = {r.bucket: (r.low, r.high, r.n) for r in nll.position_buckets(losses).collect()}
    assert b == {0: (2, 16, 15), 1: (17, 31, 15), 2: (32, 46, 9)}
    odd = spark.createDataFrame([(float(i),) for i in range(100)] + [(float("nan"),), (float("inf"),)], "ppl double")
    s = nll.ppl_summary(odd).first()
    assert s.n_invalid == 2 and s.median_ppl == 49.5
    h = {r.bin: r.n for r in nll.histogram(spark.range(500).select(F.col("id").cast("double").alias("v")), "v").collect()}
    assert sum(h.values()) == 500 and max(h) == 49
    g = spark.createDataFrame([(1, 20.0), (2, None), (3, 30.0)], "doc_id long, ppl double")
    inv = nll.inversion(g, g.withColumn("ppl", F.col("ppl") / 2)).first()
    assert inv.n_valid_samples == 2 and inv.perplexity_inversion_ratio == 2
    assert nll.ppl_under_gk(spark.createDataFrame([(None, 10.0, 2.0)], "ppl_gk double, ppl_ref double, ratio double")).first().ppl_gk == 5


def test_ppl_of_equal_losses_is_equal_to_the_last_bit(spark):
    x = [float(v) for v in np.random.default_rng(3).exponential(9, 130)]
    rows = [(i, p + 1, x[p]) for i in range(20) for p in np.random.default_rng(i).permutation(130).tolist()] + [(99, 1, 2.0)]
    losses = spark.createDataFrame(rows, "doc_id long, pos int, nll double").repartition(7)
    got = {r.doc_id: (r.n, r.ppl) for r in nll.doc_ppl(losses, ordered=True).collect()}
    total = 0.0
    for v in x:
        total += v
    assert got.pop(99) == (1, None) and len(got) == 20 and len(set(got.values())) == 1
    assert got[0] == (130, pytest.approx(math.exp(total / 130), rel=1e-15))
    with pytest.raises(ValueError):
        nll.doc_ppl(losses, window=16, ordered=True)


# ------------------------------------------------------------ sampling, sources, packs
def test_sampling(spark):
    docs = spark.range(1000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    a = {r.doc_id for r in sampling.sample(docs, 50).collect()}
    assert len(a) == 50 and a == {r.doc_id for r in sampling.sample(docs.repartition(9), 50).collect()}
    order = sorted(range(1000), key=str)
    want = {order[i] for i in np.random.default_rng(42).choice(1000, 20, replace=False)}
    assert {r.doc_id for r in sampling.sample_exact(docs, 20).collect()} == want
    share = sampling.holdout(docs).where("is_holdout").count() / 1000
    assert 0.15 < share < 0.25
    with pytest.raises(ValueError):
        sampling.mixtures(docs.limit(5), docs, n=10)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/"><page><title>A</title><ns>0</ns><id>7</id><revision><id>9</id><text xml:space="preserve">hello</text></revision></page>'
        "<page><title>T</title><ns>1</ns><id>8</id><revision><id>1</id><text>talk</text></revision></page><page><title>E</title><ns>0</ns><id>9</id><revision><id>1</id><text></text></revision></page></mediawiki>"
    )
    assert [tuple(r) for r in readers.xml_articles(spark, str(tmp_path / "d.xml")).collect()] == [(7, "A", "hello")]
    (tmp_path / "j.jsonl").write_text('{"text": "a"}\n{"text": "  "}\n{"other": 1}\n')
    assert readers.jsonl(spark, str(tmp_path / "j.jsonl")).count() == 1
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    writers.write_table(docs, f"{tmp_path}/c")
    digest = validation.content_digest(docs, ["doc_id", "text"]).first()
    assert digest == validation.content_digest(docs.repartition(5), ["doc_id", "text"]).first()
    manifest = {"digest": digest["digest"]}
    writers.write_record(spark, manifest, f"{tmp_path}/m")
    assert readers.verified(spark, f"{tmp_path}/c", readers.read_manifest(spark, f"{tmp_path}/m")).count() == docs.count()
    assert validation.is_current(docs, ["doc_id", "text"], manifest) and not validation.is_current(docs.limit(3), ["doc_id", "text"], manifest)
    with pytest.raises(ValueError):
        readers.verified(spark, f"{tmp_path}/c", {"digest": "other"})


def test_baseline_pack_and_scoring(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'")
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    corpus, accounting = build_corpus(docs, Config(target_docs=50), clean=tx.clean_light)
    assert corpus.count() == 50 and sum(r.n for r in accounting.collect()) == docs.count()
    with pytest.raises(ValueError):
        build_corpus(docs, Config(target_docs=10_000), clean=tx.clean_light)
    base = Baseline.fit(corpus, vecs.where("label < 5"), components=5)
    base.save(spark, str(tmp_path))
    again = Baseline.load(spark, str(tmp_path), base.meta["digest"])
    assert again.meta == base.meta and again.unigram.count() == base.unigram.count() and np.allclose(again.pca["components"], base.pca["components"])
    with pytest.warns(UserWarning):
        Baseline.load(spark, str(tmp_path), "other")
    entry = score_dataset(docs, again, nll.BigramScorer(corpus), vecs.where("label >= 5").select("id", "vec"), vecs.where("label < 5").select("id", "vec")).first()
    assert 0 <= entry.scores.composite_index <= 1 and entry.metadata.n_documents == docs.count()
    stats = spark.createDataFrame([(1.0, 0.2, 12, None)], "zipf_alpha double, corpus_ttr double, intrinsic_dimensionality int, mean_ppl double")
    assert {r.rule: r.passed for r in validation.sanity(stats).collect()} == {"zipf_alpha": True, "corpus_ttr": True, "intrinsic_dimensionality": True, "mean_ppl": False}


def test_streaming_extension(spark, tmp_path):
    from driftloom.streaming.monitor import windowed_lexical

    src = f"{tmp_path}/in"
    spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'a b a' as text union all select timestamp'2024-01-01 00:02:00', 'c' union all select timestamp'2024-01-01 01:00:00', 'd'").write.parquet(src)
    q = windowed_lexical(spark.readStream.schema("ts timestamp, text string").parquet(src)).writeStream.format("memory").queryName("monitor").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select n_docs, n_tokens, round(mean_ttr, 3) from monitor").collect()
    assert [tuple(r) for r in rows] == [(2, 4, 0.833)]


def test_command_line(spark, tmp_path):
    """build, measure and score over tables, as `python -m driftloom` runs them."""
    from driftloom.__main__ import main

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'")
    docs.write.parquet(f"{tmp_path}/raw")
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    for name, cond in (("base", "label < 5"), ("vecs", "label >= 5")):
        vecs.where(cond).select("id", "vec").write.parquet(f"{tmp_path}/{name}")
    main(["build", f"{tmp_path}/raw", f"{tmp_path}/study", "--docs", "50", "--plain", "--vectors", f"{tmp_path}/base"])
    assert spark.read.parquet(f"{tmp_path}/study/corpus").count() == 50
    main(["measure", f"{tmp_path}/study/pack", f"{tmp_path}/raw", f"{tmp_path}/layer", "--by", "source"])
    assert spark.read.parquet(f"{tmp_path}/layer").count() == docs.select("source").distinct().count()
    main(["score", f"{tmp_path}/study/pack", f"{tmp_path}/raw", f"{tmp_path}/vecs", f"{tmp_path}/base", f"{tmp_path}/entry", "--fit", f"{tmp_path}/study/corpus"])
    assert 0 <= spark.read.parquet(f"{tmp_path}/entry").first().scores.composite_index <= 1


def test_scratch_tables_go_with_their_step(spark):
    import os

    from driftloom.scratch import materialise, passing, scratch_root

    root = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with passing(spark) as keep:
        inner = materialise(spark.range(5).toDF("a"), "inner")
        kept = keep(inner.where("a > 1"), "kept")
    left = set(os.listdir(root)) - before
    assert [x.rpartition("-")[0] for x in left] == ["kept"] and kept.count() == 3


def test_two_nearest_is_the_same_in_blocks_and_alone():
    """Copies are 0 apart, however many rows stand beside them."""
    rng = np.random.default_rng(3)
    b = rng.normal(size=(500, 16)) * 1000
    x = np.concatenate([b[:5], rng.normal(size=(20, 16)) * 1000])
    want = np.sort(np.sqrt(((x[:, None] - b[None]) ** 2).sum(2)), axis=1)[:, :2]
    assert np.array_equal(vectors._two_nearest(x, b), want) and (want[:5, 0] == 0).all()
    alone = np.concatenate([vectors._two_nearest(x[i : i + 1], b) for i in range(len(x))])
    assert np.array_equal(alone, want)
    assert np.isinf(vectors._two_nearest(x, b[:1])[:, 1]).all()


def test_student_tail(spark):
    from driftloom.functions.numeric import student_two_sided

    # closed forms: one degree of freedom is Cauchy's distribution, two has t / sqrt(2 + t^2)
    rows = [(t, n) for t in (0.0, 0.5, 2.0, 10.0) for n in (1, 2)]
    got = {(r.t, r.n): r.p for r in spark.createDataFrame(rows, "t double, n long").select("t", "n", student_two_sided("t", "n").alias("p")).collect()}
    for t, n in rows:
        want = 1 - 2 / np.pi * np.arctan(t) if n == 1 else 1 - t / np.sqrt(2 + t * t)
        assert got[t, n] == pytest.approx(want, abs=1e-9)
