"""Token losses in blocks: against a small re-implementation, and what they shuffle."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from driftloom.operators import bigrams, nll
from driftloom.sources.readers import table

SF = "/root/testdata/sf0.01"


def brute(cohort, docs, max_length=None, lam=0.5, alpha=1.0):
    uni, pair, prev = Counter(), Counter(), Counter()
    for t in cohort:
        w = (t or "").split()
        uni.update(w)
        pair.update(zip(w, w[1:], strict=False))
        prev.update(w[:-1])
    n, v = sum(uni.values()), len(uni)
    out = {}
    for i, t in docs:
        w = (t or "").split()
        for k, x in enumerate(w[:max_length]):
            p = (uni[x] + alpha) / (n + alpha * (v + 1))
            if k and prev[w[k - 1]]:
                p = lam * pair[w[k - 1], x] / prev[w[k - 1]] + (1 - lam) * p
            out[i, k + 1] = -math.log(p)
    return out


DOCS = [(1, "a b a b c", "en"), (2, "", "en"), (3, None, "en"), (4, "b a\u00a0d\u3000a", "de"), (5, "a", None), (6, "x y z " * 40, "en"), (7, "a b a b c", "de"), (None, "b b", "en")]


@pytest.mark.parametrize(("block", "homes"), [(1 << 17, 1 << 21), (3, 2)])
@pytest.mark.parametrize("max_length", [None, 2])
def test_losses_equal_counting(spark, monkeypatch, block, homes, max_length):
    monkeypatch.setattr(bigrams, "BLOCK_TOKENS", block)
    monkeypatch.setattr(bigrams, "HOME_KEYS", homes)
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    found = nll.score_within(df, ["lang = 'en'", "lang = 'none'"], "lang", max_length=max_length).collect()
    for k, lang in enumerate(("en", "none")):
        want = brute([t for _, t, g in DOCS if g == lang], [(i, t) for i, t, _ in DOCS], max_length)
        assert {(r.doc_id, r.pos): r[f"nll_{k}"] for r in found} == pytest.approx(want)
    assert {(r.doc_id, r.lang) for r in found} == {(i, g) for i, t, g in DOCS if t}
    assert all(r.n_tokens == min(len(dict((i, t) for i, t, _ in DOCS)[r.doc_id].split()), max_length or 999) for r in found)
    apart = nll.BigramScorer(df.where("lang = 'en'")).score(df, "lang", max_length=max_length).collect()
    assert {(r.doc_id, r.pos): r.nll for r in apart} == {(r.doc_id, r.pos): r.nll_0 for r in found}


def test_no_documents_and_no_cohort(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    assert nll.BigramScorer(df).score(df.limit(0)).count() == 0
    assert {round(r.nll, 9) for r in nll.BigramScorer(df.limit(0)).score(df).collect()} == {0.0}


def shuffled(spark, run):
    """Rows that the stages of run() write to shuffles."""
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = set(stages())
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for s, n in stages().items() if s not in before)


@pytest.mark.parametrize("name", ["coldstart", "doc_ppl", "length_buckets", "length_verdict", "position_buckets", "position_monotone", "ppl_histogram", "ppl_inversion", "ppl_ratio", "ppl_summary", "tail_comparison", "token_losses", "windowed_ppl"])
def test_no_row_a_token_is_shuffled(spark, name):
    tokens = sum(len(r.text.split()) for r in table(spark, SF, "documents").select("text").collect())
    assert shuffled(spark, lambda: entry.queries()[name](spark, SF).collect()) < tokens / 4
