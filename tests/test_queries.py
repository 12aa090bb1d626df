import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seqweft.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, oracle, name):
    oracle(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_header_fields_of_odd_documents(spark, oracle, tmp_path):
    """Texts without letters, nulls, and languages with brackets and white space."""
    texts = ["Hello world", "123 !!", "", None, "\u00e9\u00e9 \u00f1", "a", "12", None] + ["a"] * 9
    langs = ["en", "en", "fr", "de", "", None, None, None, " en ", "e]n", "e[n", "a]b[c", "\ten\u3000", "e\nn", "\u00a0en", "en \n", "] [x"]
    rows = {"doc_id": range(len(texts)), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": ["s"] * len(texts)}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    oracle(spark, QUERIES["header_fields"], ORACLES["header_fields"], str(tmp_path))


def test_latest_listings_of_repeated_urls(spark, oracle, tmp_path):
    urls = ["https://h/a", "https://h/a", "https://h/a/", "https://h/b", "https://h/b//", "", None, None, "https://h/c/\n"]
    pq.write_table(pa.table({"page_id": [1, 2, 3, 4, 5, 7, 8, 10, 11], "url": pa.array(urls, pa.string())}), tmp_path / "pages.parquet")
    oracle(spark, QUERIES["latest_listings"], ORACLES["latest_listings"], str(tmp_path))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
