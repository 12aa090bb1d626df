"""Every query on tables with nulls, repeated rows, extra columns of clashing names, and on empty tables."""

import pytest
from pyspark.sql import functions as F

from seqweft.llm.registry import QUERIES

CLASH = ["kept", "fingerprint", "component_id", "held_out", "score", "lang_pred", "n_tokens", "spans", "feature", "media", "error", "key", "record", "archive", "offset", "length", "ordinal", "__row_", "weight", "blocks", "rest", "base", "u", "v0", "i", "rank", "share", "v"]


@pytest.fixture(scope="module")
def folders(spark, docs, no_docs, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    pages = spark.createDataFrame([(1, "u", "<p>"), (1, "u", "<p>"), (2, None, None), (None, "w", "x" * 100_000), (3, "", "")], "page_id long, url string, html string")
    for name, d, p in (("odd", docs, pages), ("none", no_docs, pages.limit(0))):
        for table, df in (("documents", d), ("pages", p)):
            df.withColumns({c: F.lit(c) for c in CLASH}).write.parquet(f"{root}/{name}/{table}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd(spark, folders, name):
    rows = QUERIES[name](spark, f"{folders}/odd").collect()
    if name.startswith("op6"):
        assert len(rows) <= 5
    else:
        assert len(rows) == (11 if name.startswith("op1_") else 12)  # op1 has a row for each id
    assert QUERIES[name](spark, f"{folders}/none").count() == 0
