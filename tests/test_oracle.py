"""Every query with SQL gives the rows that DuckDB gives; every query runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from driftloom.plans import queries as own
from tests.oracle import DATA, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_equals_sql(spark, con, name):
    assert compare(spark, own.QUERIES[name], own.SQL[name], DATA, con) is None


def test_length_verdict_ranks_unrounded_perplexities(spark):
    folder = "/root/testdata/sf0.01"
    one = connect(folder)
    one.execute("SET threads=1")  # with more, DuckDB adds losses in changing orders and breaks other ties
    assert compare(spark, own.QUERIES["length_verdict"], own.SQL["length_verdict"], folder, one) is None


def test_length_verdict_of_no_short_documents(spark, tmp_path):
    rows = [(i, "a b " * 68, "en", "src0") for i in range(3)]  # 136 words: no bucket
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(spark, own.QUERIES["length_verdict"], own.SQL["length_verdict"], str(tmp_path), con) is None


def odd_pages(spark, folder):
    """Pages cut within an entity, as titles at sf0.1 are, and entities side by side."""
    cuts = ["<title>a &amp</title> b &lt", "&amp", "&ampx &amp;lt; &amp;amp", "&amp&amp;&quot;&#39;&#39 &copy=1", "&lt;b&gt;x&lt;/b&gt; &nbsp;y&eacute"]
    rows = [(i, f"http://a/{i}", x) for i, x in enumerate(cuts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["clean_full", "entity_decode"])
def test_entities_cut_short(spark, tmp_path, name):
    assert compare(spark, own.QUERIES[name], own.SQL[name], str(tmp_path), odd_pages(spark, tmp_path)) is None


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_runs(spark, name):
    assert own.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert {r.lang for r in entry.entry(spark).collect()} == {"en", "fr", "de", "es"}


def test_entry_has_sql_for_queries_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())
