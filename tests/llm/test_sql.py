"""Queries of the llm subpackage that SQL can express, against their SQL, and the form of all."""

from __future__ import annotations

import pytest

from keyloft.llm.registry import ORACLE, QUERIES
from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_covers_its_table(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    key = "page_id" if "page_id" in df.columns else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    assert df.select(key).distinct().count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
