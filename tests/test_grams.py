"""Counts by cohort in blocks: against counting, over several blocks and homes."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from driftloom.operators import grams, lexical
from driftloom.sources.readers import table
from tests.test_bigrams import SF, shuffled

ROWS = [("a b a b c a b", "x", 1), ("a b a", "x", 1), ("a b a b", "x", 2), ("", "x", 1), (None, "y", 1), ("c", None, 3), ("c d c d c d", None, 3), ("a\u00a0b c", "y", None)]


@pytest.mark.parametrize(("block", "homes"), [(1 << 17, 1 << 21), (2, 2)])
@pytest.mark.parametrize("by", [(), ("g",), ("g", "k")])
def test_counts_equal_counting(spark, monkeypatch, block, homes, by):
    monkeypatch.setattr(grams, "BLOCK_TOKENS", block)
    monkeypatch.setattr(grams, "HOME_KEYS", homes)
    df = spark.createDataFrame(ROWS, "text string, g string, k int")
    for n in (1, 2, 3):
        want = Counter()
        for t, g, k in ROWS:
            w = (t or "").split()
            want.update((*[{"g": g, "k": k}[c] for c in by], " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
        assert {tuple(r[:-1]): r.cnt for r in lexical.token_counts(df, by, n).collect()} == want
        found = {tuple(r[c] for c in by): (r.total, r.types, round(r.weighted, 9), r.hapax, r.rare) for r in grams.shape_sums(df, by, n, 20).collect()}
        own = {c: [x for k, x in want.items() if k[:-1] == c] for c in {k[:-1] for k in want}}
        assert found == {c: (sum(x), len(x), round(sum(i * math.log2(i) for i in x), 9), x.count(1), sum(i <= 5 for i in x)) for c, x in own.items()}


@pytest.mark.parametrize("name", ["composite_index", "lexical_layer_by_source"])
def test_no_row_a_token_is_shuffled(spark, name):
    tokens = sum(len(r.text.split()) for r in table(spark, SF, "documents").select("text").collect())
    assert shuffled(spark, lambda: entry.queries()[name](spark, SF).collect()) < tokens
