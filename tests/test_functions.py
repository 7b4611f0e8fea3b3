"""Identity, time, predicates, schema rules and jagged arrays at their edges."""

from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloft.errors import SchemaMismatch
from keyloft.functions import identity, jagged, text, timeutil
from keyloft.operators import chunking, predicates
from keyloft.schema import fingerprint, normal_type, promote, safe_name, structured

NAN, INF = float("nan"), float("inf")


def test_identity_of_special_and_half_way_values(spark):
    values = [NAN, INF, -INF, 0.0, -0.0, 0.5, 1.5, 2.5, -0.5]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, k double").select("i", *identity.identity_columns({"k": "REAL"}, {"k": 1})).sort("i").collect()
    assert [(r.k_s, r.k_q) for r in rows] == [(1, 0), (2, 0), (3, 0), (0, 0), (0, 0), (0, 0), (0, 2), (0, 2), (0, 0)]
    assert [identity.special_of(v, 1) for v in values] == [(r.k_s, r.k_q) for r in rows]


def test_a_key_beyond_64_bits_fails(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(1e30,)], "k double").select(identity.quantized(F.col("k"), 1000)).collect()


def test_text_keys_with_commas_differ(spark):
    keys = {"a": "TEXT", "b": "TEXT"}
    rows = identity.with_subset_uuid(spark.createDataFrame([("x,", "y"), ("x", ",y"), ("x\\", "y")], "a string, b string"), keys, {}).collect()
    assert len({r.subset_uuid for r in rows}) == 3


@pytest.mark.parametrize(("value", "us"), [(0, 0), (1.5, 1_500_000), ("1970-01-02", 86_400_000_000), ("1970-01-01T00:00:01Z", 1_000_000), ("1970-01-01T02:00:00+02:00", 0), ("1970-01-01T00:00:01", 1_000_000)])
def test_times(value, us):
    assert timeutil.to_epoch_us(value) == us


def test_iso_drops_microseconds(spark):
    assert spark.range(1).select(timeutil.iso(F.lit(1_999_999))).first()[0] == "1970-01-01T00:00:01Z"


def test_predicates(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True), (5, NAN, "b", False), (9, INF, "a,b", True)], "i long, r double, t string, b boolean")
    keys = {"i": "INTEGER", "r": "REAL", "t": "TEXT", "b": "BOOLEAN"}
    ids = lambda **q: [r.i for r in df.filter(predicates.compile_predicates(keys, q)).sort("i").collect()]
    assert ids() == [1, 5, 9]
    assert ids(i=(9, 5)) == [5, 9]
    assert ids(i="5") == [5]
    assert ids(r=(0, 1e300)) == [1]
    assert ids(r=NAN) == [5]
    assert ids(r=1.0000001, b=True) == [1]
    assert ids(t="a,b") == [9]
    for bad in ({"nothing": 1}, {"r": (NAN, 1.0)}):
        with pytest.raises(ValueError):
            ids(**bad)
    assert ids(b=[1, 2]) == [1, 9] and ids(b="") == [5] and ids(r="nan") == [5]
    for bad in ({"t": 3}, {"t": ("a", "b")}, {"i": (1, 2, 3)}):
        with pytest.raises(TypeError):
            ids(**bad)


def test_globs(spark):
    df = spark.createDataFrame([("a/b.py",), ("a/b.txt",), ("t_b.py",)], "p string")
    assert {r.p for r in df.filter(predicates.not_ignored(F.col("p"), ["*.txt", "t_*"])).collect()} == {"a/b.py"}


def test_names_types_and_promotion():
    assert safe_name("a_1") == "a_1"
    for bad in ("", "a-b", "a b"):
        with pytest.raises(ValueError):
            safe_name(bad)
    assert promote(T.DoubleType(), T.LongType()) == T.DoubleType()
    with pytest.raises(SchemaMismatch):
        promote(T.LongType(), T.DoubleType())
    for bad in (T.BinaryType(), T.DateType(), T.TimestampType(), T.MapType(T.StringType(), T.LongType())):
        with pytest.raises(TypeError):
            normal_type(bad)
    assert fingerprint({"a": 1, "b": 2}) == fingerprint({"b": 2, "a": 1})


@pytest.mark.parametrize(("value", "good"), [("x" * 256, True), ("x" * 257, False), (None, False)])
def test_text_length_and_nulls(spark, value, good):
    df = spark.createDataFrame([(value,)], "s string")
    rows = df.select(*structured(df, ["s"]))
    if good:
        assert rows.first().s == value
    else:
        with pytest.raises(PySparkException):
            rows.collect()


def test_unsigned_overflow_fails(spark):
    df = spark.sql("SELECT CAST('9223372036854775808' AS DECIMAL(20,0)) AS u")
    with pytest.raises(PySparkException):
        df.select(*structured(df, ["u"])).collect()


def test_pad_unpad_and_shape(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],), (None,)], "a array<double>")
    rows = df.select(jagged.pad(F.col("a"), 3, T.DoubleType()).alias("p"), jagged.length(F.col("a")).alias("n")).select("p", jagged.unpad(F.col("p"), F.col("n")).alias("u")).collect()
    assert [r.p for r in rows] == [[1.0, 2.0, 0.0], [0.0] * 3, [0.0] * 3]
    assert [r.u for r in rows] == [[1.0, 2.0], [], []]
    with pytest.raises(PySparkException):
        df.select(jagged.pad(F.col("a"), 1, T.DoubleType())).collect()
    nested = spark.createDataFrame([([[1, 2, 3], [4]],), ([],)], "a array<array<int>>")
    assert [r[0] for r in nested.select(jagged.shape(F.col("a"), 2)).collect()] == [[2, 3], [0, 0]]


@given(st.floats(allow_nan=True, allow_infinity=True, width=32), st.sampled_from([1.0, 10.0, 1000.0]))
def test_special_of_is_stable(v, scale):
    code, q = identity.special_of(v, scale)
    assert code == (1 if math.isnan(v) else 2 if v == INF else 3 if v == -INF else 0)
    assert code or q == round(v * scale)


def test_nested_pads_and_lengths(spark):
    nested = spark.createDataFrame([([[1, 2, 3], [4]],), ([],), (None,)], "a array<array<int>>")
    rows = [r[0] for r in nested.select(jagged.pad(F.col("a"), [3, 4], T.IntegerType())).collect()]
    assert rows == [[[1, 2, 3, 0], [4, 0, 0, 0], [0] * 4], [[0] * 4] * 3, [[0] * 4] * 3]
    for bad in ([1, 4], [3, 2]):
        with pytest.raises(PySparkException, match="DataExceedsCanon"):
            nested.select(jagged.pad(F.col("a"), bad, T.IntegerType())).collect()
    shaped = nested.select(jagged.shape(F.col("a"), 2).alias("a_shape"))
    assert [shaped.filter(jagged.at_least("a", k)).count() for k in ((2, 3), (2, 4), (0, 3), (0, 0))] == [1, 0, 1, 3]


def test_numbers_and_sums_of_many_rows_keep_all_columns(spark):
    """More rows than a range's sample, and columns beside those that order them."""
    df = spark.range(0, 400_000, 1, 16).select(((F.col("id") * 7919) % 400_000).alias("k"), (F.col("id") % 3).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    numbered = chunking.ordered_numbers(df, ["g"], ["k"])
    w = Window.partitionBy("g").orderBy("k")
    bad = numbered.withColumn("want", F.row_number().over(w) - 1).filter("want <> row_in_subset")
    assert (numbered.count(), bad.count(), numbered.select("more").distinct().count()) == (400_000, 0, 400_000)
    summed = chunking.running_sum(df, ["k"], F.col("k"), "upto")
    assert summed.filter(F.col("upto") != F.col("k") * (F.col("k") + 1) / 2).count() == 0 and summed.count() == 400_000
    sizes = chunking.pages(df, ["k"], 1000).groupBy("page").count().collect()
    assert len(sizes) == 400 and {r["count"] for r in sizes} == {1000}
    assert set(numbered.columns) == {"k", "g", "more", "row_in_subset"} and set(summed.columns) == {"k", "g", "more", "upto"}


def test_numbers_of_null_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, k int")
    rows = {(r.g, r.k, r.row_in_subset) for r in chunking.ordered_numbers(df, ["g"], ["k"]).collect()}
    assert rows == {(None, 1, 0), (None, 3, 1), ("a", 2, 0)}
    assert chunking.ordered_numbers(df.limit(0), ["g"], ["k"]).count() == 0 and chunking.running_sum(df.limit(0), ["k"], F.col("k"), "s").count() == 0


def test_claims_of_large_subsets_against_a_loop(spark):
    import random

    rng = random.Random(1)
    sizes = {s: [rng.choice([0, 1, 5, 30, 200]) for _ in range(500)] for s in ("a", "b")}
    df = spark.createDataFrame([(s, i, n) for s, ns in sizes.items() for i, n in enumerate(ns)], "subset_uuid string, id long, n_rows long")
    want = set()
    for s, ns in sizes.items():
        claim, total = 0, 0
        for i, n in enumerate(ns):
            if not n:
                continue
            if total and total + n > 100:
                claim, total = claim + 1, 0
            total += n
            want.add((s, i, claim))
    assert {(r.subset_uuid, r.id, r.claim) for r in chunking.pack_claims(df, 100).collect()} == want


def test_sealed_payload_is_bound_to_its_data(spark):
    key, iv = F.lit(b"0123456789abcdef"), F.lit(b"abcdefghijkl")
    df = spark.range(1).select(text.sealed(F.lit(b"payload"), key, iv, F.lit("a|b")).alias("s"))
    assert bytes(df.select(text.opened(F.col("s"), key, F.lit("a|b"))).first()[0]) == b"payload"
    with pytest.raises(PySparkException):
        df.select(text.opened(F.col("s"), key, F.lit("a|c"))).collect()
