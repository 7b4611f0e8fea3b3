"""Registered queries over real stores: each writes datasets with the library, works on them and returns what SQL can repeat.

Ids of subsets and parts are BLAKE2b digests, which SQL lacks, so results name subsets by their keys and parts by place.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloft.operators import parts as P
from keyloft.schema import key_type, normal_type
from keyloft.scratch import Scratch, shared_dir
from keyloft.sources import jsonstate
from keyloft.sources.crypto import LocalKeys, decrypt_parts, encrypt_parts, reencrypt_parts
from keyloft.sources.store import Store
from keyloft.streaming.ingest import bounded_stream, ingest, stream_into
from keyloft.streaming.staging import Staging

QUERIES = {}
ORACLE = {}

#: Rows of a part in these stores.
LINE_ROWS, ORDER_ROWS = 2000, 400
LINE_KEYS, LINE_ORDER = ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _store(spark: SparkSession, producer: str = "local") -> Store:
    """A new store in the shared folder."""
    return Store(spark, f"{Scratch(spark, 'store').root}", producer_id=producer)


_held: dict[tuple[str, str, str], Store] = {}


def _shared(spark: SparkSession, sf_dir: str, name: str, fill) -> Store:
    """A store that queries only read, filled once a session."""
    key = (shared_dir(spark) + spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        store = _store(spark)
        fill(store)
        _held[key] = store
    return _held[key]


def _lines(spark: SparkSession, sf_dir: str) -> Store:
    """Dataset lines: all of lineitem by flag and status."""
    rows = _t(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return _shared(spark, sf_dir, "lines", lambda s: s.append("lines", rows, LINE_KEYS, LINE_ORDER, LINE_ROWS, bid="lines-1"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _append_orders(store: Store, rows: DataFrame, alias: str = "orders", **more) -> None:
    store.append(alias, rows, ["o_orderstatus"], ["o_orderkey"], ORDER_ROWS, **more)


_NESTED = """(SELECT o_orderkey, o_orderpriority, o_totalprice, coalesce(qs, []) AS qs, len(coalesce(qs, [])) AS n,
  CASE WHEN qs IS NULL THEN 0 ELSE list_max(list_transform(qs, lambda q: CASE WHEN q > 25 THEN 2 ELSE 1 END)) END AS m
FROM orders LEFT JOIN (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity) AS qs FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _nested(spark: SparkSession, sf_dir: str) -> Store:
    """Dataset nested: all orders by priority, with the quantities of their lines, plain and as rows of one or two numbers."""

    def fill(store: Store) -> None:
        quantities = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_quantity")).alias("q"))
        rows = _t(spark, sf_dir, "orders").join(quantities, "o_orderkey", "left").withColumn("q", F.coalesce("q", F.array().cast("array<double>")))
        grid = F.transform("q", lambda x: F.when(x > 25, F.array(x, x + 1)).otherwise(F.array(x)))
        store.append("nested", rows.select("o_orderkey", "o_orderpriority", "o_totalprice", "q", grid.alias("grid")), ["o_orderpriority"], ["o_orderkey"], ORDER_ROWS, jagged=["q", "grid"])

    return _shared(spark, sf_dir, "nested", fill)


# ---------------------------------------------------------------- append, meta, data


@query("SELECT l_returnflag, l_linestatus, count(*) AS total_rows FROM lineitem GROUP BY 1, 2")
def q_subset_registry(spark, sf_dir):
    """Subsets of a sealed lineitem and their rows."""
    return _lines(spark, sf_dir).meta("lines").subsets.select(*LINE_KEYS, "total_rows")


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS live_rows, (count(*) + {LINE_ROWS - 1}) // {LINE_ROWS} AS n_parts, least(count(*), {LINE_ROWS}) AS longest, 0::BIGINT AS buffer_rows, false AS marked FROM lineitem GROUP BY 1, 2")
def q_store_meta(spark, sf_dir):
    """What a meta query says of every subset: rows, parts, longest part."""
    meta = _lines(spark, sf_dir).meta("lines")
    held = meta.parts.groupBy("subset_uuid").agg(F.count("*").alias("n_parts"), F.max("n_rows").alias("longest"))
    return meta.subsets.join(held, "subset_uuid").select(*LINE_KEYS, "live_rows", "n_parts", "longest", "buffer_rows", F.col("marked_for_deletion").alias("marked"))


@query(f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate,
(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {', '.join(LINE_ORDER)}) - 1) % {LINE_ROWS} AS row_in_part FROM lineitem WHERE l_returnflag = 'A'""")
def q_store_data(spark, sf_dir):
    """Rows of chosen subsets, with their place in their part."""
    store = _lines(spark, sf_dir)
    return store.data(store.meta("lines", l_returnflag="A"), ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]).rows.drop("subset_uuid", "part_uuid")


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS rows, ((count(*) + {LINE_ROWS - 1}) // {LINE_ROWS})::BIGINT AS parts, true AS gapless, (SELECT count(*) FROM lineitem) AS last_row, (SELECT count(*) FROM lineitem) AS total FROM lineitem GROUP BY 1, 2""")
def q_store_bounds(spark, sf_dir):
    """Offsets of subsets and parts among the rows of a selection: gapless, and as long as the subsets are."""
    store = _lines(spark, sf_dir)
    meta = store.meta("lines")
    data = store.data(meta)
    w = Window.orderBy("row_start", "row_end")  # one row a subset
    gapless = (F.coalesce(F.lag("row_end").over(w), F.lit(0)) == F.col("row_start")) & (F.coalesce(F.lag("part_end").over(w), F.lit(0)) == F.col("part_start"))
    subsets = data.subset_bounds.withColumn("gapless", gapless)
    of_parts = data.bounds.groupBy("subset_uuid").agg(F.min("row_start").alias("lo"), F.max("row_end").alias("hi"), F.count("*").alias("n"))
    rows = subsets.join(of_parts, "subset_uuid").join(meta.subsets.select("subset_uuid", *LINE_KEYS), "subset_uuid")
    same = F.col("gapless") & (F.col("lo") == F.col("row_start")) & (F.col("hi") == F.col("row_end")) & (F.col("n") == F.col("part_end") - F.col("part_start"))
    return rows.select(*LINE_KEYS, (F.col("row_end") - F.col("row_start")).alias("rows"), F.col("n").alias("parts"), same.alias("gapless"), F.max("row_end").over(Window.partitionBy()).alias("last_row"), F.lit(meta.total_rows()).cast("long").alias("total"))


@query("SELECT l_returnflag, l_linestatus, 0::BIGINT AS row_start, 0::BIGINT AS row_end, 0::BIGINT AS part_start, 0::BIGINT AS part_end, 0::BIGINT AS n_read FROM lineitem GROUP BY 1, 2")
def q_store_empty_selection(spark, sf_dir):
    """A selection without parts: typed empty rows, and offsets that all are 0."""
    store = _lines(spark, sf_dir)
    meta = store.meta("lines", parts_end_time="2001-01-01")
    data = store.data(meta)
    return data.subset_bounds.join(meta.subsets.select("subset_uuid", *LINE_KEYS), "subset_uuid").drop("subset_uuid").withColumn("n_read", F.lit(data.rows.count()).cast("long"))


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY " + ", ".join(LINE_ORDER) + ") AS k FROM lineitem) WHERE k <= 5")
def q_peek(spark, sf_dir):
    """The first five rows of the first part of each subset."""
    store = _lines(spark, sf_dir)
    subsets = store.meta("lines").subsets.select("subset_uuid", *LINE_KEYS)
    # the part of a subset's smallest row
    firsts = store.data(store.meta("lines"), LINE_ORDER).rows.groupBy("subset_uuid").agg(F.min_by("part_uuid", F.struct(*LINE_ORDER, "row_in_part")).alias("part_uuid"))
    out = None
    for r in firsts.join(subsets, "subset_uuid").collect():  # one row a subset, six at most
        head = store.peek("lines", r.part_uuid, ["l_orderkey", "l_linenumber"], 5).select(F.lit(r.l_returnflag).alias("l_returnflag"), F.lit(r.l_linestatus).alias("l_linestatus"), "l_orderkey", "l_linenumber")
        out = head if out is None else out.union(head)
    return out


@query("""SELECT p, count(*) AS subsets, sum(n)::BIGINT AS rows FROM (
SELECT 'int' AS p, count(*) AS n, c_nationkey, c_mktsegment, c_acctbal > 0 FROM customer WHERE c_nationkey = 7 GROUP BY ALL
UNION ALL SELECT 'range', count(*), c_nationkey, c_mktsegment, c_acctbal > 0 FROM customer WHERE c_nationkey BETWEEN 3 AND 9 AND c_acctbal > 0 GROUP BY ALL
UNION ALL SELECT 'text', count(*), c_nationkey, c_mktsegment, c_acctbal > 0 FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL
UNION ALL SELECT 'boolean', count(*), c_nationkey, c_mktsegment, c_acctbal > 0 FROM customer WHERE NOT (c_acctbal > 0) GROUP BY ALL
UNION ALL SELECT 'reserved', count(*), c_nationkey, c_mktsegment, c_acctbal > 0 FROM customer GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20
UNION ALL SELECT 'live', count(*), c_nationkey, c_mktsegment, c_acctbal > 0 FROM customer GROUP BY ALL
UNION ALL SELECT 'window', count(*), c_nationkey, c_mktsegment, c_acctbal > 0 FROM customer GROUP BY ALL) GROUP BY p""")
def q_store_predicates(spark, sf_dir):
    """Queries by keys of three types, by reserved columns and by time."""

    def fill(store: Store) -> None:
        rows = _t(spark, sf_dir, "customer").withColumn("rich", F.col("c_acctbal") > 0)
        store.append("customers", rows, ["c_nationkey", "c_mktsegment", "rich"], ["c_custkey"])

    store = _shared(spark, sf_dir, "customers", fill)
    asked = {"int": {"c_nationkey": "7"}, "range": {"c_nationkey": (9, 3), "rich": True}, "text": {"c_mktsegment": "BUILDING"}, "boolean": {"rich": 0}, "reserved": {"total_rows": (2, 20)}, "live": {"marked_for_deletion": False}, "window": {"subset_start_time": "2001-01-01", "subset_end_time": 4e9}}
    out = None
    for name, predicates in asked.items():
        rows = store.meta("customers", **predicates).subsets.groupBy(F.lit(name).alias("p")).agg(F.count("*").alias("subsets"), F.sum("total_rows").alias("rows"))  # no row if nothing matches
        out = rows if out is None else out.union(rows)
    return out


_GRADE = "CASE WHEN l_discount = 0 THEN 'nan'::DOUBLE WHEN l_discount = 0.1 THEN 'inf'::DOUBLE ELSE l_discount END"


@query(f"""WITH k AS (SELECT CASE WHEN isfinite(g) THEN round_even(g * 100, 0)::BIGINT ELSE 0 END AS q, CASE WHEN isnan(g) THEN 1 WHEN isinf(g) THEN 2 ELSE 0 END AS s FROM (SELECT {_GRADE} AS g FROM lineitem))
SELECT 'all' AS p, count(DISTINCT (s, q)) AS subsets, count(*) AS rows FROM k UNION ALL SELECT 'nan', count(DISTINCT (s, q)), count(*) FROM k WHERE s = 1
UNION ALL SELECT 'inf', count(DISTINCT (s, q)), count(*) FROM k WHERE s = 2 UNION ALL SELECT 'identity', count(DISTINCT (s, q)), count(*) FROM k WHERE s = 0 AND q = 5
UNION ALL SELECT 'range', count(DISTINCT (s, q)), count(*) FROM k WHERE s = 0 AND q BETWEEN 2 AND 4
UNION ALL SELECT 'rebuilt', count(DISTINCT (s, CASE WHEN s = 0 THEN round_even(q / 10.0, 0) ELSE 0 END)), count(*) FROM k""")
def q_store_real_keys(spark, sf_dir):
    """Identity of real keys, NaN and infinity among them, and the same rows rebuilt under a coarser quantization."""
    grade = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).when(F.col("l_discount") == 0.1, F.lit(float("inf"))).otherwise(F.col("l_discount"))
    rows = _t(spark, sf_dir, "lineitem").select(grade.alias("grade"), *LINE_ORDER)
    store = _store(spark)
    store.append("grades", rows, ["grade"], LINE_ORDER, 5 * LINE_ROWS, quantization={"grade": 100.0})
    store.rebuild("grades", "coarse", LINE_ORDER, quantization={"grade": 10.0})
    count = lambda name, alias="grades", **q: store.meta(alias, **q).subsets.agg(F.count("*").alias("subsets"), F.coalesce(F.sum("total_rows"), F.lit(0)).alias("rows")).select(F.lit(name).alias("p"), "subsets", "rows")
    out = count("all").union(count("nan", grade=float("nan"))).union(count("inf", grade=float("inf"), by_identity=True))
    return out.union(count("identity", grade=0.0501, by_identity=True)).union(count("range", grade=(0.045, 0.015))).union(count("rebuilt", "coarse"))


@query("""SELECT column_name AS field, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'bigint' END AS stored,
CASE column_type WHEN 'VARCHAR' THEN 'TEXT' WHEN 'DOUBLE' THEN 'REAL' ELSE 'INTEGER' END AS key_type FROM (DESCRIBE lineitem) WHERE column_type <> 'TIMESTAMP'""")
def q_schema_types(spark, sf_dir):
    """Stored types and key types of lineitem's columns, as the schema block of a dataset has them."""
    given = _t(spark, sf_dir, "lineitem").drop("l_shipdate")
    head = _lines(spark, sf_dir).catalog.head("lines").schema
    stored = {f["name"]: normal_type(given.schema[f["name"]].dataType).simpleString() for f in head["fields"] if f["name"] in given.columns}
    stored |= {k: "string" for k in head["key_schema"]}
    return spark.createDataFrame([(k, v, key_type(given.schema[k].dataType)) for k, v in stored.items()], "field string, stored string, key_type string")


# ---------------------------------------------------------------- jagged fields and the planner


@query(f"SELECT o_orderkey, n::INTEGER AS q_len, list_sum(qs) AS total FROM {_NESTED} WHERE n >= 6")
def q_store_lengths(spark, sf_dir):
    """Rows whose array is long enough; parts of shorter ones are not opened."""
    store = _nested(spark, sf_dir)
    rows = store.data(store.meta("nested"), at_least={"q": 6}).rows
    return rows.select("o_orderkey", "q_len", F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"SELECT o_orderkey, n::INTEGER AS d0, m::INTEGER AS d1 FROM {_NESTED} WHERE n >= 3 AND m >= 2")
def q_store_shapes(spark, sf_dir):
    """The same for nested arrays, by both extents."""
    store = _nested(spark, sf_dir)
    rows = store.data(store.meta("nested"), at_least={"grid": (3, 2)}).rows
    return rows.select("o_orderkey", F.get("grid_shape", F.lit(0)).alias("d0"), F.get("grid_shape", F.lit(1)).alias("d1"))


_PART_OF_ORDER = f"(SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // {ORDER_ROWS} AS part FROM {_NESTED})"


@query(f"""SELECT o_orderpriority, min(o_orderkey) AS first_key, count(*) AS n_rows, min(n)::INTEGER AS min_len, max(n)::INTEGER AS max_len, avg(n) AS avg_len, count_if(n = (SELECT max(n) FROM {_NESTED}))::INTEGER AS full_rows,
min(m)::INTEGER AS min_1, max(m)::INTEGER AS max_1, avg(m) AS avg_1, CASE WHEN count(DISTINCT n) = 1 THEN 'constant' WHEN count(DISTINCT n) <= 256 AND count(DISTINCT n) <= count(*) * 0.1 THEN 'codebook' ELSE 'plain' END AS len_encoding,
CASE WHEN count(DISTINCT n) > 1 AND count(DISTINCT n) <= 256 AND count(DISTINCT n) <= count(*) * 0.1 THEN count(DISTINCT n)::INTEGER END AS codebook_k, 'uint16' AS width FROM {_PART_OF_ORDER} GROUP BY o_orderpriority, part""")
def q_store_part_stats(spark, sf_dir):
    """Statistics that a part was sealed with, of a plain and of a nested array."""
    store = _nested(spark, sf_dir)
    meta = store.meta("nested")
    firsts = store.data(meta, ["o_orderkey"]).rows.groupBy("part_uuid").agg(F.min("o_orderkey").alias("first_key"))
    get = lambda path, kind="int": F.get_json_object("part_stats_json", f"$.{path}").cast(kind)
    rows = meta.parts.join(firsts, "part_uuid").join(meta.subsets.select("subset_uuid", "o_orderpriority"), "subset_uuid")
    return rows.select("o_orderpriority", "first_key", "n_rows", get("q.min_len").alias("min_len"), get("q.max_len").alias("max_len"), get("q.avg_len", "double").alias("avg_len"), get("q.full_rows").alias("full_rows"), get("grid.dims[1].min").alias("min_1"), get("grid.dims[1].max").alias("max_1"), get("grid.dims[1].avg", "double").alias("avg_1"), get("q.len_encoding", "string").alias("len_encoding"), get("q.codebook_K").alias("codebook_k"), get("q.width", "string").alias("width"))


@query(f"""WITH c AS (SELECT o_orderpriority, part, min(o_orderkey) AS first_key, count(*) AS n_rows, CASE WHEN max(n) < 2 THEN 'none' WHEN min(n) >= 2 THEN 'all' ELSE 'some' END AS match FROM {_PART_OF_ORDER} GROUP BY 1, 2)
SELECT match, count(*) AS parts, sum(n_rows)::BIGINT AS rows FROM c GROUP BY 1""")
def q_store_explain(spark, sf_dir):
    """How the planner classes all parts for a length, before any is opened."""
    from keyloft.plans.planner import explain_parts

    return explain_parts(_nested(spark, sf_dir).meta("nested").parts, {"q": 2})


@query(f"""WITH c AS (SELECT o_orderpriority, part, count(*) AS n_rows, min(n) >= 1 AS sure FROM {_PART_OF_ORDER} GROUP BY 1, 2 HAVING max(n) >= 1),
s AS (SELECT *, sum(CASE WHEN sure THEN n_rows ELSE 0 END) OVER (ORDER BY NOT sure, n_rows DESC, o_orderpriority, part ROWS UNBOUNDED PRECEDING) - CASE WHEN sure THEN n_rows ELSE 0 END AS before FROM c)
SELECT sure, n_rows, count(*) AS parts FROM s WHERE before < 1000 GROUP BY 1, 2""")
def q_store_cost_order(spark, sf_dir):
    """Parts that are opened for any 1000 rows of some length: those of full match first, the longest of them first."""
    from keyloft.plans.planner import bounded, plan_parts

    chosen = bounded(plan_parts(_nested(spark, sf_dir).meta("nested").parts, {"q": 1}), 1000)
    return chosen.groupBy((F.col("match") == "all").alias("sure"), "n_rows").agg(F.count("*").alias("parts"))


# ---------------------------------------------------------------- deletion, reconciliation, compaction


@query(f"""WITH c AS (SELECT o_orderstatus, count(*) AS n, (count(*) + {ORDER_ROWS - 1}) // {ORDER_ROWS} AS p FROM orders GROUP BY 1)
SELECT 'marked' AS step, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE n END AS live_rows, n AS total_rows, o_orderstatus = 'F' AS marked, (SELECT p FROM c WHERE o_orderstatus = 'F') AS changed FROM c
UNION ALL SELECT 'unmarked', o_orderstatus, n, n, false, (SELECT p FROM c WHERE o_orderstatus = 'F') FROM c""")
def q_soft_delete(spark, sf_dir):
    """A subset and its parts are marked, and unmarked again."""
    store, out = _store(spark), None
    _append_orders(store, _orders(spark, sf_dir))
    for step, unmark in (("marked", False), ("unmarked", True)):
        changed = store.soft_delete("orders", {"o_orderstatus": "F"}, unmark=unmark)["parts"]
        shown = store.meta("orders", exclude_marked_subsets=False).subsets
        rows = shown.select(F.lit(step).alias("step"), "o_orderstatus", "live_rows", "total_rows", F.col("marked_for_deletion").alias("marked"), F.lit(changed).cast("long").alias("changed"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"""WITH c AS (SELECT o_orderstatus, count(*) AS n, (count(*) + {ORDER_ROWS - 1}) // {ORDER_ROWS} AS p FROM orders GROUP BY 1)
SELECT 'collected' AS step, o_orderstatus, n AS rows, (SELECT p FROM c WHERE o_orderstatus = 'P') AS parts_gone FROM c WHERE o_orderstatus <> 'P' UNION ALL SELECT 'again', o_orderstatus, n, 0::BIGINT FROM c""")
def q_store_gc(spark, sf_dir):
    """Marked parts and their files go for good; the same rows may come back later."""
    store, out = _store(spark), None
    orders = _orders(spark, sf_dir)
    _append_orders(store, orders)
    store.soft_delete("orders", {"o_orderstatus": "P"})
    for step in ("collected", "again"):
        if step == "again":
            _append_orders(store, orders)
        gone = store.delete("orders")["files"]
        rows = store.data(store.meta("orders")).rows.join(store.meta("orders").subsets.select("subset_uuid", "o_orderstatus"), "subset_uuid")
        rows = rows.groupBy("o_orderstatus").agg(F.count("*").alias("rows")).select(F.lit(step).alias("step"), "o_orderstatus", "rows", F.lit(gone).cast("long").alias("parts_gone"))
        out = rows if out is None else out.union(rows)
    return out


_PARTS = f"(SELECT o_orderstatus, (count(*) + {ORDER_ROWS - 1}) // {ORDER_ROWS} AS p FROM orders GROUP BY 1)"


@query(f"""SELECT (SELECT sum(p) FROM {_PARTS} WHERE o_orderstatus <> 'P')::BIGINT AS parts, (SELECT p FROM {_PARTS} WHERE o_orderstatus = 'F') AS inserted, (SELECT p FROM {_PARTS} WHERE o_orderstatus = 'P') AS skipped,
(SELECT p FROM {_PARTS} WHERE o_orderstatus = 'O') AS conflicts, (SELECT sum(p) FROM {_PARTS})::BIGINT AS orphans, (SELECT p FROM {_PARTS} WHERE o_orderstatus = 'F') AS missing_files, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS rows""")
def q_fsck_orphans(spark, sf_dir):
    """Files that no part names: of a known subset (taken up), of an unknown one (left), of content that is held (left); and parts without files."""
    source, store = _store(spark), _store(spark)
    orders = _orders(spark, sf_dir)
    _append_orders(source, orders)
    _append_orders(store, orders.filter("o_orderstatus = 'O'"))
    # F is known as a subset, its parts are gone
    _append_orders(store, orders.filter("o_orderstatus = 'F'"))
    lost = store.meta("orders", o_orderstatus="F").parts.select("part_uuid")

    def forget(head):
        held = store.catalog.table("orders", head, "parts")
        return head.schema, {"parts": P.not_present(held, lost, ["part_uuid"])}, {"op": "forget"}

    folder = store.catalog.folder("orders")
    paths = [r[0] for r in store.meta("orders", o_orderstatus="F").parts.select("file_relpath").collect()]
    missing = store.fsck("orders", insert_orphans=False)["missing_files"]
    for p in paths:
        store.files.delete(f"{folder}/{p}")
    missing += store.fsck("orders", insert_orphans=False)["missing_files"]
    store.catalog.commit("orders", forget)
    all_parts = source.meta("orders")
    source._write_parts("orders", all_parts.snapshot.schema, source.data(all_parts).rows, all_parts.parts, f"{source.catalog.folder('orders')}/copied")
    copied = spark.read.parquet(source.files.uri(f"{source.catalog.folder('orders')}/copied/p")).drop("p")
    store._write_parts("orders", store.catalog.head("orders").schema, copied, all_parts.parts, f"{folder}/data/found")
    report = store.fsck("orders")
    rows = store.data(store.meta("orders")).rows.agg(F.count("*").alias("rows"))
    return rows.select(F.lit(store.meta("orders").parts.count()).cast("long").alias("parts"), *[F.lit(report[k]).cast("long").alias(k) for k in ("inserted", "skipped", "conflicts", "orphans")], F.lit(missing).cast("long").alias("missing_files"), "rows")


@query(f"SELECT o_orderstatus, count(*) AS rows, (SELECT p FROM {_PARTS} WHERE o_orderstatus = 'P') AS missing FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def q_store_missing(spark, sf_dir):
    """Parts whose files are gone are named, and the rest is read."""
    store = _store(spark)
    _append_orders(store, _orders(spark, sf_dir))
    for r in store.meta("orders", o_orderstatus="P").parts.collect():
        store.files.delete(f"{store.catalog.folder('orders')}/{r.file_relpath}")
    data = store.data(store.meta("orders"))
    rows = data.rows.join(store.meta("orders").subsets.select("subset_uuid", "o_orderstatus"), "subset_uuid")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("rows")).withColumn("missing", F.lit(len(data.missing)).cast("long"))


@query(f"""SELECT o_orderstatus, count(*) AS rows, count(DISTINCT o_orderkey) AS orders, ((count(*) + {ORDER_ROWS - 1}) // {ORDER_ROWS})::BIGINT AS parts FROM orders GROUP BY 1""")
def q_store_compact(spark, sf_dir):
    """Short parts of five batches are joined into full ones in one commit; every row is there once."""
    store = _store(spark)
    orders = _orders(spark, sf_dir)
    for priority in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        _append_orders(store, orders.filter(F.col("o_orderpriority") == priority))
    store.compact("orders")
    meta = store.meta("orders")
    rows = store.data(meta).rows.join(meta.subsets.select("subset_uuid", "o_orderstatus"), "subset_uuid").groupBy("subset_uuid", "o_orderstatus").agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("orders"))
    held = meta.parts.groupBy("subset_uuid").agg(F.count("*").alias("parts"))
    return rows.join(held, "subset_uuid").select("o_orderstatus", "rows", "orders", "parts")


# ---------------------------------------------------------------- change feed, merge, verification


@query(f"""WITH c AS (SELECT o_orderstatus, count(*) AS n, (count(*) + {ORDER_ROWS - 1}) // {ORDER_ROWS} AS p FROM orders GROUP BY 1), f AS (SELECT p FROM c WHERE o_orderstatus = 'F'), o AS (SELECT p FROM c WHERE o_orderstatus = 'O')
SELECT 'plan' AS step, o_orderstatus, n AS rows, (SELECT p FROM f) AS new_parts, (SELECT p FROM o) AS duplicates, 1::BIGINT AS batches FROM c WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'merge', o_orderstatus, n, (SELECT p FROM f), (SELECT p FROM o), 1::BIGINT FROM c UNION ALL SELECT 'again', o_orderstatus, n, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM c""")
def q_store_merge(spark, sf_dir):
    """Batches of another store: planned, taken over once, and not again."""
    a, b, out = _store(spark, "a"), _store(spark, "b"), None
    orders = _orders(spark, sf_dir)
    _append_orders(a, orders.filter("o_orderstatus <> 'P'"))
    _append_orders(b, orders.filter("o_orderstatus <> 'F'"))
    for step in ("plan", "merge", "again"):
        report = b.merge_from("orders", a, verify_hash=step == "merge", dry_run=step == "plan")
        rows = b.meta("orders").subsets.select(F.lit(step).alias("step"), "o_orderstatus", F.col("live_rows").alias("rows"), F.lit(report.new_parts).cast("long").alias("new_parts"), F.lit(report.duplicate_parts).cast("long").alias("duplicates"), F.lit(len(report.batches)).cast("long").alias("batches"))
        rows = Scratch(spark, "merge").save(rows, step)
        out = rows if out is None else out.union(rows)
    return out


def _batches(spark: SparkSession, sf_dir: str) -> Store:
    """Dataset orders in five batches, one a priority."""

    def fill(store: Store) -> None:
        orders = _orders(spark, sf_dir)
        for r in orders.select("o_orderpriority").distinct().sort("o_orderpriority").collect():  # five rows
            _append_orders(store, orders.filter(F.col("o_orderpriority") == r[0]), bid=f"batch of {r[0]}")

    return _shared(spark, sf_dir, "batches", fill)


_BATCHED = f"(SELECT o_orderpriority, o_orderstatus, count(*) AS n, (count(*) + {ORDER_ROWS - 1}) // {ORDER_ROWS} AS p FROM orders GROUP BY 1, 2)"


@query(f"SELECT 'batch of ' || o_orderpriority AS bid, o_orderstatus, n AS rows, p::BIGINT AS parts, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS tail FROM {_BATCHED}")
def q_store_batches(spark, sf_dir):
    """Batches of the change feed, with the subsets and rows of each."""
    store = _batches(spark, sf_dir)
    tail, out = store.tail_batches("orders", 20).collect(), None
    for b in tail:
        rows = store.show_batch("orders", b.bid).groupBy("bid", "o_orderstatus").agg(F.sum("n_rows").alias("rows"), F.count("*").alias("parts"))
        out = rows if out is None else out.union(rows)
    return out.withColumn("tail", F.lit(len(tail)).cast("long"))


@query(f"""SELECT 'orders' AS alias, sum(p)::BIGINT AS files, sum(p)::BIGINT AS parts, 0::BIGINT AS missing_files, 0::BIGINT AS orphans, 0::BIGINT AS broken, sum(n)::BIGINT AS live_rows, count(DISTINCT o_orderstatus) AS subsets FROM {_BATCHED}""")
def q_store_audit(spark, sf_dir):
    """What an audit of a store finds, by way of the id that its catalog gave the dataset."""
    store = _batches(spark, sf_dir)
    alias = store.catalog.by_uuid(store.list_nodes().first().dataset_uuid)["alias"]
    found = store.audit(alias)
    counts = store.statistics(alias).filter("not marked_for_deletion")
    return counts.select(F.lit(alias).alias("alias"), *[F.lit(found[k]).cast("long").alias(k) for k in ("files", "parts", "missing_files", "orphans")], F.lit(len(found["broken_batches"])).cast("long").alias("broken"), F.col("rows").alias("live_rows"), "subsets")


@query(f"""SELECT 'batch_parts' AS name, sum(p)::BIGINT AS rows, true AS whole FROM {_BATCHED} UNION ALL SELECT 'parts', sum(p)::BIGINT, true FROM {_BATCHED}
UNION ALL SELECT 'batches', count(DISTINCT o_orderpriority), true FROM orders UNION ALL SELECT 'subsets', count(DISTINCT o_orderstatus), true FROM orders""")
def q_store_optimize(spark, sf_dir):
    """Tables of a store that several commits added to, written anew in one folder each."""
    store = _batches(spark, sf_dir)
    counts = store.optimize("orders")
    folders = store.catalog.head("orders").paths
    return spark.createDataFrame([(name, n, len(folders[name]) == 1) for name, n in counts.items()], "name string, rows long, whole boolean")


@query("SELECT 'edge' AS kind, n_name AS a, r_name AS b FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'module', n_name, CASE WHEN n_regionkey = 0 THEN 'done' ELSE 'pending' END FROM nation")
def q_json_state(spark, sf_dir):
    """Call graph and progress kept as JSON files; a missing file reads as nothing."""
    files = _store(spark).files
    pairs = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "n_regionkey").collect()  # 25 rows
    files.create("edges.json", json.dumps({"out": {r.n_name: [r.r_name] for r in pairs}}))
    files.create("progress.json", json.dumps({"modules": {r.n_name: {"status": "done"} if r.n_regionkey == 0 else {} for r in pairs}}))
    edges = jsonstate.edges(spark, files, "edges.json").union(jsonstate.edges(spark, files, "none.json"))
    return edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).union(jsonstate.progress(spark, files, "progress.json").select(F.lit("module"), "path", "status"))


@query(f"""SELECT 'intact' AS state, 0::BIGINT AS broken_batches, 0::BIGINT AS bad_parts, sum(p)::BIGINT AS parts FROM {_PARTS}
UNION ALL SELECT 'edited', 1, (SELECT p FROM {_PARTS} WHERE o_orderstatus = 'F')::BIGINT, sum(p)::BIGINT FROM {_PARTS}""")
def q_store_verify(spark, sf_dir):
    """Chain and contents of an intact store, and of one whose batch time and whose rows of one subset were edited."""
    store = _store(spark)
    orders = _orders(spark, sf_dir)
    for status in ("F", "O", "P"):
        _append_orders(store, orders.filter(F.col("o_orderstatus") == status), bid=status)
    check = lambda state: (state, len(store.verify_chain("orders")), store.verify_content("orders").count(), store.meta("orders").parts.count())
    found = [check("intact")]

    def edit(head):
        batches = store.catalog.table("orders", head, "batches")
        return head.schema, {"batches": batches.withColumn("created_at", F.when(F.col("bid") == "O", 1).otherwise(F.col("created_at")))}, {"op": "edit"}

    store.catalog.commit("orders", edit)
    meta = store.meta("orders", o_orderstatus="F")
    changed = Scratch(spark, "edit").save(store.data(meta).rows.withColumn("o_totalprice", F.col("o_totalprice") + 1), "rows")
    target = f"{store.catalog.folder('orders')}/data/edited"
    store._write_parts("orders", meta.snapshot.schema, changed, meta.parts, target)

    def point(head):
        parts = store.catalog.table("orders", head, "parts")
        mine = F.col("batch_id") == "F"
        return head.schema, {"parts": parts.withColumn("file_relpath", F.when(mine, F.concat(F.lit("data/edited/p/p="), "part_uuid")).otherwise(F.col("file_relpath")))}, {"op": "edit"}

    store.catalog.commit("orders", point)
    found.append(check("edited"))
    return spark.createDataFrame(found, "state string, broken_batches long, bad_parts long, parts long")


@query(f"SELECT (SELECT p FROM {_PARTS} WHERE o_orderstatus = 'F') AS inserted, 0::BIGINT AS skipped, 0::BIGINT AS again, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS rows")
def q_store_register(spark, sf_dir):
    """Parts that another store sealed are taken up once; their subset is known here by one row."""
    a, b = _store(spark, "a"), _store(spark, "b")
    orders = _orders(spark, sf_dir)
    _append_orders(a, orders.filter("o_orderstatus <> 'P'"))
    _append_orders(b, orders.filter("o_orderstatus = 'O'"))
    first = orders.filter("o_orderstatus = 'F'").orderBy("o_orderkey").limit(1).withColumn("o_totalprice", F.lit(-1.0))
    _append_orders(b, first)
    uri = a.files.uri(f"{a.catalog.folder('orders')}/data")
    report, again = b.register_existing("orders", uri), b.register_existing("orders", uri)
    rows = b.data(b.meta("orders")).rows.filter("o_totalprice >= 0").agg(F.count("*").alias("rows"))
    return rows.select(*[F.lit(x).cast("long").alias(name) for name, x in (("inserted", report["inserted"]), ("skipped", report["skipped"]), ("again", again["inserted"]))], "rows")


@query(f"SELECT o_orderstatus, p::BIGINT AS parts, p::BIGINT AS opened, p::BIGINT AS reopened FROM {_PARTS}")
def q_store_encrypted(spark, sf_dir):
    """Part files under encryption: sealed, opened to the same bytes, and sealed anew under another key."""

    def fill(store: Store) -> None:
        _append_orders(store, _orders(spark, sf_dir))

    store = _shared(spark, sf_dir, "orders", fill)
    meta, keys = store.meta("orders"), LocalKeys()
    old, scratch = keys.generate_data_key(), Scratch(spark, "sealed")
    good = lambda df, ref, name: scratch.save(decrypt_parts(store, meta, df, keys, ref).filter(F.substring("content", 1, 4) == b"PAR1").select("part_uuid", F.octet_length("content").cast("long").alias(name)), name)
    sealed = scratch.save(encrypt_parts(store, meta, keys, old), "sealed")
    opened = good(sealed, old, "opened")
    new = keys.rotate(old)
    moved = scratch.save(reencrypt_parts(meta, sealed, keys, old, new), "moved")
    keys.revoke(old)
    reopened = good(moved, new, "reopened")
    rows = sealed.select("part_uuid", "plaintext_size", "subset_uuid").join(opened, "part_uuid", "left").join(reopened, "part_uuid", "left").join(meta.subsets.select("subset_uuid", "o_orderstatus"), "subset_uuid")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("parts"), *[F.count_if(F.col(c) == F.col("plaintext_size")).alias(c) for c in ("opened", "reopened")])


# ---------------------------------------------------------------- ingest


@query(f"""SELECT o_orderstatus, count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)) AS drained, 0::BIGINT AS waiting FROM orders GROUP BY 1""")
def q_store_staging(spark, sf_dir):
    """Payloads of five enqueues wait, are claimed and sealed until nothing waits."""
    store = _store(spark)
    staging = Staging(store, "orders", ["o_orderstatus"], ["o_orderkey"])
    orders = _orders(spark, sf_dir)
    for r in orders.select("o_orderpriority").distinct().sort("o_orderpriority").collect():  # five rows
        staging.enqueue(orders.filter(F.col("o_orderpriority") == r[0]), writers=4)
    staging.claim("lost", ORDER_ROWS)
    staging.reclaim_stale(0)
    total = int(staging.table().agg(F.sum("n_rows")).first()[0] or 0)
    drained = staging.drain("writer", max(ORDER_ROWS, total // 4))
    left = staging.table().count()
    return store.meta("orders").subsets.select("o_orderstatus", F.col("live_rows").alias("rows"), F.lit(drained).cast("long").alias("drained"), F.lit(left).cast("long").alias("waiting"))


@query("SELECT mode, n_regionkey AS region, count(*) * 10 AS rows, (SELECT count(*) FROM nation) AS tasks, (SELECT count(*) FROM nation WHERE n_regionkey = 4) AS errors FROM nation, (VALUES ('direct'), ('staged')) t(mode) WHERE n_regionkey <> 4 GROUP BY 1, 2")
def q_store_ingest(spark, sf_dir):
    """A worker over all nations, which fails for those of one region; sealed at once and by way of staging."""

    def worker(n_nationkey, n_name, n_regionkey):
        if n_regionkey == 4:
            raise RuntimeError("no data")
        return pd.DataFrame({"region": n_regionkey, "nation": n_name, "seq": range(10)})

    out = None
    for mode in ("direct", "staged"):
        store = _store(spark)
        report = ingest(store, "made", _t(spark, sf_dir, "nation"), worker, "region long, nation string, seq long", ["region"], ["nation", "seq"], 15, raise_on_error=False, staged=mode == "staged", writers=2)
        rows = store.meta("made").subsets.select(F.lit(mode).alias("mode"), F.col("region").cast("int").alias("region"), F.col("live_rows").alias("rows"), *[F.lit(report[k]).cast("long").alias(k) for k in ("tasks", "errors")])
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT c_mktsegment, count(*) AS rows, 2::BIGINT AS batches FROM customer GROUP BY 1")
def q_store_stream(spark, sf_dir):
    """A stream over two files, one a micro-batch, appended exactly once though its checkpoint is lost and it starts again."""
    store = _store(spark)
    folder = f"{Scratch(spark, 'stream').root}"
    _t(spark, sf_dir, "customer").repartitionByRange(2, "c_custkey").write.parquet(f"{folder}/in")
    stream = bounded_stream(spark, f"{folder}/in", _t(spark, sf_dir, "customer").schema, files=1)
    for k in range(2):
        stream_into(store, "customers", stream, ["c_mktsegment"], ["c_custkey"], f"{folder}/check-{k}").awaitTermination()
    batches = store.tail_batches("customers").count()
    return store.meta("customers").subsets.select("c_mktsegment", F.col("live_rows").alias("rows"), F.lit(batches).cast("long").alias("batches"))


@query("SELECT user_id AS subset_uuid, count(*) AS n, 1::BIGINT AS writers FROM events GROUP BY 1")
def q_affinity_routing(spark, sf_dir):
    """Staged rows of a subset were written by one task: all of them are in one file."""
    store = _store(spark)
    Staging(store, "events", ["user_id"], ["event_id"]).enqueue(_t(spark, sf_dir, "events").select("user_id", "event_id"), writers=4)
    rows = spark.read.parquet(store.files.uri(f"{store.catalog.folder('events')}/staged/*")).withColumn("file", F.input_file_name())
    return rows.groupBy(F.col("user_id").alias("subset_uuid")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("writers"))


@query("SELECT 'page' AS view, l_returnflag, l_linestatus FROM lineitem GROUP BY ALL UNION ALL SELECT 'search', l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def q_store_navigate(spark, sf_dir):
    """Subsets page by page, two at a time, and by text."""
    store, out, after = _lines(spark, sf_dir), None, None
    while page := store.list_subsets("lines", after, 2).collect():  # two rows
        after = page[-1].subset_uuid
        rows = spark.createDataFrame([("page", r.l_returnflag, r.l_linestatus) for r in page], "view string, l_returnflag string, l_linestatus string")
        out = rows if out is None else out.union(rows)
    return out.union(store.search("lines", "r").select(F.lit("search"), *LINE_KEYS))


@query(f"SELECT l_returnflag, l_linestatus, ((count(*) + {LINE_ROWS - 1}) // {LINE_ROWS})::BIGINT AS files FROM lineitem GROUP BY 1, 2")
def q_store_files(spark, sf_dir):
    """Part files found by walking the store's folders, by the subsets that the parts table gives them."""
    store = _lines(spark, sf_dir)
    found = store.files.discover(f"{store.catalog.folder('lines')}", ["data/*/p/p=*.parquet"], ["*/_*"])
    relpath = F.regexp_extract("path", "^(data/.*)/[^/]*$", 1)
    meta = store.meta("lines")
    rows = found.select(relpath.alias("file_relpath")).distinct().join(meta.parts, "file_relpath").join(meta.subsets.select("subset_uuid", *LINE_KEYS), "subset_uuid")
    return rows.groupBy(*LINE_KEYS).agg(F.count("*").alias("files"))
