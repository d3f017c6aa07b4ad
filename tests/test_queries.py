import duckdb
import pytest
from conftest import DATA

from pagemill.plans import made_pages, queries as q  # noqa: F401


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_against_sql(spark, duck, same, name):
    same(q.QUERIES[name](spark, DATA), duck.sql(q.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_query_runs(spark, name):
    assert q.QUERIES[name](spark, DATA).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_document_titles_of_odd_first_lines(spark, same, tmp_path):
    heads = ["", " ", "\t\nnext", "\nnext", None, "Title:  x", "TITLE: 'x", "a\rb", "a\u0085", " a", "x", "'q'", "--- ", "$1\\"]
    rows = [(5 * i + k, h) for i, h in enumerate(heads) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(q.QUERIES["document_titles"](spark, str(tmp_path)), con.sql(q.ORACLES["document_titles"]))


def test_arbitrate_captures_of_pages_with_one_url(spark, same, tmp_path):
    page = lambda k, n: f"<html><title>T{k}</title><body><article><h1>H{k}</h1><p>{'word ' * n}</p></article></body></html>"
    rows = [(i, f"https://a.b/{i // 8}", page(i, 10 + 30 * (i % 5))) for i in range(32)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same(q.QUERIES["arbitrate_captures"](spark, str(tmp_path)), con.sql(q.ORACLES["arbitrate_captures"]))


def test_readable_articles_of_long_pages(spark, same, tmp_path):
    page = lambda n: f"<html><title>T</title><body><article><h1>H</h1>{''.join(f'<p>Words of {i} here</p>' for i in range(n))}</article></body></html>"
    spark.createDataFrame([(n, f"https://a.b/{n}", page(n)) for n in (3, 499, 500, 900)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same(q.QUERIES["readable_articles"](spark, str(tmp_path)), con.sql(q.ORACLES["readable_articles"]))
