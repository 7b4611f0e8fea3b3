"""Comparison of a DataFrame with DuckDB SQL."""

from __future__ import annotations

from collections import Counter


def rows_of(frame) -> Counter:
    columns = sorted(frame.columns)
    return Counter(map(str, frame[columns].astype(str).itertuples(index=False)))


def assert_same(df, con, sql: str) -> None:
    want, got = con.execute(sql).to_arrow_table().to_pandas(), df.toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows_of(got) == rows_of(want)
