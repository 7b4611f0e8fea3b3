"""Every registered core query against its SQL."""

from __future__ import annotations

import pytest

from keyloft.plans.queries import ORACLE, QUERIES
from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert_same(df, duck, ORACLE[name])
    else:
        assert df.count() > 0


def test_subset_uuid_is_the_blake2b_of_the_identity_text(spark, sf_dir):
    import hashlib
    import uuid

    rows = QUERIES["q_subset_uuid"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey").limit(50).collect()
    for r in rows:
        text = f"{r.c_mktsegment},{r.c_nationkey}"
        assert r.subset_uuid == str(uuid.UUID(bytes=hashlib.blake2b(text.encode(), digest_size=16).digest()))


@pytest.mark.parametrize(("n", "nation", "balance", "absent"), [(21, 4, 1.0, {"int", "boolean", "reserved"}), (20, 7, -1.0, {"range"}), (1, 2, 0.0, {"int", "range", "reserved"})])
def test_predicates_that_match_no_subset_give_no_row(spark, tmp_path, n, nation, balance, absent):
    import duckdb

    rows = [(i, nation, balance, s) for i, s in enumerate(["BUILDING", "MACHINERY"] * n)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    df = QUERIES["q_store_predicates"](spark, str(tmp_path))
    assert_same(df, con, ORACLE["q_store_predicates"])
    assert {r.p for r in df.collect()} == {"int", "range", "text", "boolean", "reserved", "live", "window"} - absent
