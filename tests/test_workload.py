import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle import SF, connect, same
from tidewrack.plans import workload


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(workload.SQL))
def test_equals_sql(spark, con, name):
    same(workload.QUERIES[name](spark, SF), workload.SQL[name], con)


def test_snippets_of_every_hit(spark):
    for name in ("snippet_window", "snippet_sentence"):
        rows, best = (workload.QUERIES[n](spark, SF).collect() for n in (f"{name}_all", name))
        assert len(rows) > 60 and set(best) <= set(rows)


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))


def own_documents(spark, folder, texts):
    """A documents table of these texts, and DuckDB with a view of it."""
    rows = [(n, text, "en", f"src{n % 5}", len(text or "")) for n, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con


def test_phrase_is_not_found_in_a_title_cut_within_a_word(spark, tmp_path):
    head = "x" * 73
    con = own_documents(spark, tmp_path, [f"{head} of there", f"{head} of the end", "all of\nthe rest", f"{head} of th", None, ""])
    found = workload.QUERIES["search_phrase"](spark, str(tmp_path))
    assert sorted(r.doc_id for r in found.collect()) == [1, 2]
    same(found, workload.SQL["search_phrase"], con)
