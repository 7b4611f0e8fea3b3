"""Registered queries: the library's operators on the driver's tables, each with DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloft import schema
from keyloft.functions import hashing, identity, jagged, text, timeutil
from keyloft.operators import chunking, graph, parts, predicates

QUERIES = {}
ORACLE = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose values hold NaN and infinities at known places."""
    k = F.col("event_id") % 50
    odd = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).when(k == 3, F.lit(float("-inf"))).otherwise(F.col("value"))
    return _t(spark, sf_dir, "events").withColumn("value", odd)


_ODD = "(SELECT * REPLACE (CASE event_id % 50 WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE ELSE value END AS value) FROM events)"


# ---------------------------------------------------------------- subsets, identity and predicates


@query(f"SELECT CASE WHEN isnan(value) THEN 1 WHEN value = 'inf'::DOUBLE THEN 2 WHEN value = '-inf'::DOUBLE THEN 3 ELSE 0 END AS k_s, count(*) AS n FROM {_ODD} GROUP BY 1")
def q_identity_specials(spark, sf_dir):
    return _odd_values(spark, sf_dir).groupBy(identity.special_code(F.col("value")).alias("k_s")).agg(F.count("*").alias("n"))


@query(f"SELECT count(DISTINCT q) AS n, min(q) AS lo, max(q) AS hi FROM (SELECT CASE WHEN isfinite(value) THEN round_even(value * 1000, 0)::BIGINT ELSE 0 END AS q FROM {_ODD})")
def q_identity_quantize(spark, sf_dir):
    return _odd_values(spark, sf_dir).select(identity.quantized(F.col("value"), 1000).alias("q")).agg(F.count_distinct("q").alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi"))


@query(f"SELECT event_id FROM {_ODD} WHERE isfinite(value) AND round_even(value * 10, 0) = 120")
def q_identity_eq(spark, sf_dir):
    df = _odd_values(spark, sf_dir).select("event_id", *identity.identity_columns({"value": "REAL"}, {"value": 10}))
    return df.filter(predicates.identity_eq("value", 12.0, 10)).select("event_id")


@query(f"SELECT event_id, value FROM {_ODD} WHERE value BETWEEN 12 - 0.05 AND 12 + 0.05")
def q_approx_eq(spark, sf_dir):
    return _odd_values(spark, sf_dir).filter(predicates.approx_eq(F.col("value"), 12.0, 0.05)).select("event_id", "value")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey BETWEEN 3 AND 10")
def q_find_int_range(spark, sf_dir):
    return _t(spark, sf_dir, "customer").filter(predicates.compile_predicates({"c_nationkey": "INTEGER"}, {"c_nationkey": (10, 3)})).select("c_custkey", "c_nationkey")


@query(f"SELECT event_id, value FROM {_ODD} WHERE value BETWEEN 5.0 AND 20.0")
def q_find_real_range(spark, sf_dir):
    return _odd_values(spark, sf_dir).filter(predicates.compile_predicates({"value": "REAL"}, {"value": (20.0, 5.0)})).select("event_id", "value")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def q_find_text_bool(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").withColumn("large", F.col("o_totalprice") > 100000)
    return df.filter(predicates.compile_predicates({"o_orderpriority": "TEXT", "large": "BOOLEAN"}, {"o_orderpriority": "1-URGENT", "large": True})).select("o_orderkey")


@query(f"SELECT event_id FROM {_ODD} WHERE isnan(value)")
def q_find_nan(spark, sf_dir):
    return _odd_values(spark, sf_dir).filter(predicates.predicate("value", "REAL", float("nan"))).select("event_id")


@query("""SELECT event_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events
WHERE epoch_us(ts) BETWEEN epoch_us(TIMESTAMP '2024-01-10') AND epoch_us(TIMESTAMP '2024-01-20 12:00:00')""")
def q_time_window(spark, sf_dir):
    us = timeutil.epoch_us(F.col("ts"))
    df = _t(spark, sf_dir, "events").withColumn("us", us)
    return df.filter(predicates.time_window("us", "2024-01-10", "2024-01-20T12:00:00Z")).select("event_id", "us", timeutil.iso(F.col("us")).alias("iso"))


@query("SELECT event_type, count(*) AS n, regexp_full_match(event_type, '[A-Za-z0-9_]+') AS safe, regexp_full_match(event_type || '-', '[A-Za-z0-9_]+') AS marked FROM events GROUP BY 1")
def q_schema_names(spark, sf_dir):
    """Which values would do as names of keys or fields."""
    rows = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", "n", schema.is_safe(F.col("event_type")).alias("safe"), schema.is_safe(F.concat("event_type", F.lit("-"))).alias("marked"))


@query("""SELECT c_custkey, '{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}' AS display_key FROM customer""")
def q_display_key(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", identity.display_key({"c_nationkey": "INTEGER", "c_mktsegment": "TEXT"}).alias("display_key"))


@query("SELECT l_extendedprice, l_linenumber::BIGINT AS l_linenumber, l_orderkey, l_quantity, l_returnflag FROM lineitem")
def q_sorted_projection(spark, sf_dir):
    """Fields in name order and in their stored types, as rows are sealed."""
    df = _t(spark, sf_dir, "lineitem")
    return df.select(*schema.structured(df, ["l_quantity", "l_orderkey", "l_returnflag", "l_linenumber", "l_extendedprice"]))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, count(DISTINCT l_orderkey) AS orders
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' GROUP BY 1, 2""")
def q_rows_of_subsets(spark, sf_dir):
    """Registry, predicate on the registry, then rows of the chosen subsets."""
    li = _t(spark, sf_dir, "lineitem")
    chosen = li.select("l_returnflag", "l_linestatus").distinct().filter(predicates.compile_predicates({"l_linestatus": "TEXT"}, {"l_linestatus": "F"})).filter(F.col("l_returnflag").isin("A", "R"))
    rows = li.join(chosen, ["l_returnflag", "l_linestatus"], "left_semi")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.count_distinct("l_orderkey").alias("orders"))


# ---------------------------------------------------------------- joins of the catalog


@query("""SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey), '') AS parts, count(o_orderkey) AS n
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def q_subset_parts_left(spark, sf_dir):
    """Customers with their orders; those without any are kept."""
    subsets = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subset_uuid"))
    owned = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subset_uuid"), F.col("o_orderdate").alias("created_at_epoch"), F.col("o_orderkey").alias("part_uuid"))
    return _parts_of(subsets, owned).select(F.col("subset_uuid").alias("c_custkey"), F.array_join("parts", ",").alias("parts"), F.size("parts").cast("long").alias("n"))


def _parts_of(subsets: DataFrame, owned: DataFrame) -> DataFrame:
    """subset_parts needs text ids that sort like the numbers; the numbers are padded and unpadded again."""
    padded = owned.withColumn("part_uuid", F.lpad(F.col("part_uuid").cast("string"), 19, "0"))
    return parts.subset_parts(subsets, padded).withColumn("parts", F.transform("parts", lambda x: x.cast("long").cast("string")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_parts_semi(spark, sf_dir):
    chosen = _t(spark, sf_dir, "customer").filter(predicates.predicate("c_mktsegment", "TEXT", "BUILDING"))
    return _t(spark, sf_dir, "orders").join(chosen.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) THEN 'insert' ELSE 'skip' END AS action FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q_orphans(spark, sf_dir):
    """Customers as files, urgent orders as parts, nations of two regions as known subsets."""
    files = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_relpath"), F.col("c_nationkey").alias("subset_uuid"))
    held = _t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("file_relpath"))
    known = _t(spark, sf_dir, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("subset_uuid"))
    return parts.orphans(files, held, known).select(F.col("file_relpath").alias("c_custkey"), "action")


@query("SELECT user_id AS bid, event_type AS producer_id, min(event_id) AS created_at FROM events e WHERE NOT EXISTS (SELECT 1 FROM events l WHERE l.event_type = 'click' AND l.event_type = e.event_type AND l.user_id = e.user_id AND l.value > 10) GROUP BY 1, 2")
def q_merge_unmerged(spark, sf_dir):
    """Batches of a source that a target has not merged: its log holds the clicks of large value."""
    events = _t(spark, sf_dir, "events").withColumnsRenamed({"user_id": "bid", "event_type": "producer_id"})
    batches = events.groupBy("bid", "producer_id").agg(F.min("event_id").alias("created_at"))
    log = events.filter("producer_id = 'click' and value > 10").select("producer_id", "bid").distinct()
    return parts.unmerged(batches, log)


@query("SELECT doc_id FROM documents d WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM documents h WHERE h.source = 'src0' AND h.lang = d.lang AND md5(h.text) = md5(d.text))")
def q_merge_dedupe(spark, sf_dir):
    """Parts of a source whose (subset, content) the target lacks."""
    docs = _t(spark, sf_dir, "documents").withColumn("content_hash", F.md5("text"))
    return parts.not_present(docs.filter("source <> 'src0'"), docs.filter("source = 'src0'"), ["lang", "content_hash"]).select("doc_id")


@query("SELECT doc_id, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def q_dedupe_parts(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return parts.first_wins(docs, ["h"], ["doc_id"])


# ---------------------------------------------------------------- parts: chunks, bounds, totals, statistics


@query("""SELECT user_id, part, count(*) AS n_rows, min(event_id) AS first_id FROM
(SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 25 AS part FROM events) GROUP BY 1, 2""")
def q_part_chunks(spark, sf_dir):
    df = chunking.with_part_ordinal(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], 25)
    return df.groupBy("user_id", F.col("part_ordinal").alias("part")).agg(F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_in_subset FROM events""")
def q_ordered_numbers(spark, sf_dir):
    """Row numbers without a window over whole groups."""
    return chunking.ordered_numbers(_t(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])


@query("""SELECT user_id, n_rows, (sum(n_rows) OVER w - n_rows)::BIGINT AS row_start, (sum(n_rows) OVER w)::BIGINT AS row_end FROM
(SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1) WINDOW w AS (ORDER BY user_id)""")
def q_bounds(spark, sf_dir):
    manifest = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subset_uuid")).agg(F.count("*").alias("n_rows")).withColumns({"created_at_epoch": F.lit(0), "part_uuid": F.lit("")})
    return chunking.bounds(manifest).select(F.col("subset_uuid").alias("user_id"), "n_rows", "row_start", "row_end")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as staged payloads of their lines, by customer."""
    n = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_rows"))
    return _t(spark, sf_dir, "orders").join(n, "o_orderkey", "left").select(F.col("o_custkey").cast("string").alias("subset_uuid"), F.col("o_orderkey").alias("id"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


_PAYLOADS = "(SELECT o_custkey::VARCHAR AS subset_uuid, o_orderkey AS id, count(l_orderkey) AS n_rows FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query(f"""SELECT subset_uuid, id, n_rows FROM (SELECT *, sum(n_rows) OVER w AS s, row_number() OVER w AS k FROM {_PAYLOADS} WHERE n_rows > 0
WINDOW w AS (PARTITION BY subset_uuid ORDER BY id ROWS UNBOUNDED PRECEDING)) WHERE s <= 20 OR k = 1""")
def q_prefix_claim(spark, sf_dir):
    return chunking.prefix_claim(_payloads(spark, sf_dir), 20)


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY subset_uuid ORDER BY id) AS k FROM {_PAYLOADS} WHERE n_rows > 0),
f AS (SELECT subset_uuid, id, n_rows, k, 0::BIGINT AS claim, n_rows AS total FROM p WHERE k = 1
UNION ALL SELECT p.subset_uuid, p.id, p.n_rows, p.k, CASE WHEN f.total + p.n_rows > 12 THEN f.claim + 1 ELSE f.claim END, CASE WHEN f.total + p.n_rows > 12 THEN p.n_rows ELSE f.total + p.n_rows END
FROM f JOIN p ON p.subset_uuid = f.subset_uuid AND p.k = f.k + 1) SELECT subset_uuid, id, n_rows, claim FROM f""")
def q_prefix_pack(spark, sf_dir):
    return chunking.pack_claims(_payloads(spark, sf_dir), 12)


@query("SELECT user_id AS subset_uuid, min(event_id) AS first_id FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def q_hot_subsets(spark, sf_dir):
    staged = _t(spark, sf_dir, "events").select(F.col("user_id").alias("subset_uuid"), F.col("event_id").alias("id"), F.lit(None).cast("string").alias("claimed_by"))
    return chunking.hot_subsets(staged, 10)


@query(f"SELECT subset_uuid, sum(n_rows)::BIGINT AS rows, count(*) AS payloads FROM {_PAYLOADS} GROUP BY 1")
def q_backlog(spark, sf_dir):
    return chunking.backlog(_payloads(spark, sf_dir))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND epoch_us(ts) <= epoch_us(TIMESTAMP '2024-01-15')")
def q_stale_claims(spark, sf_dir):
    staged = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "w").alias("claimed_by"), timeutil.epoch_us(F.col("ts")).alias("claimed_at"))
    return chunking.stale(staged, timeutil.to_epoch_us("2024-01-15")).select("event_id")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parts of customers, the open ones marked."""
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subset_uuid"), F.col("o_orderkey").alias("part_uuid"), (F.col("o_orderkey") % 100).alias("n_rows"), (F.col("o_orderstatus") == "O").alias("marked_for_deletion"))


@query("SELECT c_custkey AS subset_uuid, coalesce(sum(o_orderkey % 100) FILTER (WHERE o_orderstatus <> 'O'), 0)::BIGINT AS live_rows FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q_gc_totals(spark, sf_dir):
    subsets = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subset_uuid"))
    return parts.live_rows(subsets, _manifest(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the jagged list of their lines' quantities, in a defined order."""
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("seq")).withColumn("seq_len", jagged.length(F.col("seq")))


_LINES = "(SELECT l_orderkey, list(l_quantity ORDER BY l_quantity) AS seq, count(*)::INTEGER AS seq_len FROM lineitem GROUP BY 1)"


@query(f"SELECT l_orderkey, seq_len FROM {_LINES} WHERE seq_len >= 5")
def q_jagged_len(spark, sf_dir):
    return _lines(spark, sf_dir).filter(jagged.at_least("seq", 5)).select("l_orderkey", "seq_len")


@query(f"SELECT o_orderkey, coalesce(seq_len, 0) > 0 AS has FROM orders LEFT JOIN {_LINES} ON l_orderkey = o_orderkey")
def q_jagged_exists(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey").join(_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["seq_len"])
    return orders.select("o_orderkey", jagged.has_any("seq").alias("has"))


@query(f"SELECT l_orderkey, len(list_resize(seq, 20, 0.0))::BIGINT AS size, list_sum(list_resize(seq, 20, 0.0)) AS total, list_resize(seq, 20, 0.0)[20] AS last_value FROM {_LINES}")
def q_jagged_pad(spark, sf_dir):
    from pyspark.sql import types as T

    padded = _lines(spark, sf_dir).withColumn("p", jagged.pad(F.col("seq"), 20, T.DoubleType()))
    return padded.select("l_orderkey", F.size("p").cast("long").alias("size"), F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("p", F.lit(19)).alias("last_value"))


@query(f"SELECT l_orderkey, seq_len, list_sum(seq) AS total FROM {_LINES}")
def q_jagged_unpad(spark, sf_dir):
    from pyspark.sql import types as T

    back = _lines(spark, sf_dir).withColumn("u", jagged.unpad(jagged.pad(F.col("seq"), 20, T.DoubleType()), F.col("seq_len")))
    return back.select("l_orderkey", F.size("u").alias("seq_len"), F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("total"))


_STATS = """count(*) AS n_rows, min(seq_len) AS min_len, max(seq_len) AS max_len, avg(seq_len) AS avg_len, count_if(seq_len = 8)::BIGINT AS full_rows, count(DISTINCT seq_len) AS distinct_lens,
CASE WHEN count(DISTINCT seq_len) = 1 THEN 'constant' WHEN count(DISTINCT seq_len) <= 256 AND count(DISTINCT seq_len) <= count(*) * 0.1 THEN 'codebook' ELSE 'plain' END AS len_encoding"""


@query(f"SELECT l_orderkey // 1000 AS part, {_STATS} FROM {_LINES} GROUP BY 1")
def q_part_stats(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumn("part", F.floor(F.col("l_orderkey") / 1000))
    return parts.part_stats(df, ["part"], "seq_len", 8)


@query("SELECT label, count(*) AS n_rows, min(len(embedding))::INTEGER AS min_len, max(len(embedding))::INTEGER AS max_len, CASE WHEN count(DISTINCT len(embedding)) = 1 THEN 'constant' ELSE 'plain' END AS len_encoding FROM embeddings GROUP BY 1")
def q_part_stats_fixed(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings").withColumn("n", jagged.length(F.col("embedding")))
    return parts.part_stats(df, ["label"], "n", 64).select("label", "n_rows", "min_len", "max_len", "len_encoding")


@query(f"SELECT l_orderkey // 100 AS part, CASE WHEN max(seq_len) < 7 THEN 'none' WHEN min(seq_len) >= 7 THEN 'all' ELSE 'some' END AS match FROM {_LINES} GROUP BY 1")
def q_stats_prune(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumn("part", F.floor(F.col("l_orderkey") / 100))
    stats = parts.part_stats(df, ["part"], "seq_len", 8)
    return stats.select("part", parts.prune_class(F.col("min_len"), F.col("max_len"), 7).alias("match"))


@query(f"SELECT l_orderkey // 1000 AS part, count_if(seq_len < 8)::BIGINT AS padded_rows FROM {_LINES} GROUP BY 1")
def q_padded_rows(spark, sf_dir):
    return parts.padded_rows(_lines(spark, sf_dir).withColumn("part", F.floor(F.col("l_orderkey") / 1000)), ["part"], "seq_len", 8)


@query("SELECT p_partkey, 'subsets/' || p_brand || '/parts/v1/' || sha256(p_brand || p_partkey)[1:2] || '/' || sha256(p_brand || p_partkey)[3:4] || '/' || p_partkey || '.parquet' AS relpath FROM part")
def q_relpath(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.relpath(F.col("p_brand"), F.col("p_partkey").cast("string")).alias("relpath"))


@query("SELECT p_partkey, p_name[1:4] || '…' AS redacted, CASE WHEN length(p_name) <= 12 THEN p_name ELSE p_name[1:11] || '…' END AS short, p_brand || '|' || p_type || '|' || p_size AS aad FROM part")
def q_text_functions(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.redacted(F.col("p_name")).alias("redacted"), text.ellipsized(F.col("p_name"), 12).alias("short"), text.aad(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("aad"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def q_page(spark, sf_dir):
    return chunking.keyset_page(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 50)


@query("SELECT page, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 200 AS page FROM orders) GROUP BY 1")
def q_fixed_pages(spark, sf_dir):
    """All orders in pages of 200."""
    return chunking.pages(_t(spark, sf_dir, "orders"), ["o_orderkey"]).groupBy("page").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


_ALL_OF_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


@query(f"SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {_ALL_OF_LINE}) - 1 AS row_in_subset FROM lineitem")
def q_line_numbers(spark, sf_dir):
    """All columns of all lines, numbered within six large groups."""
    return chunking.ordered_numbers(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], _ALL_OF_LINE.split(", "))


@query(f"SELECT *, (row_number() OVER (ORDER BY {_ALL_OF_LINE}, l_returnflag, l_linestatus) - 1) // 200 AS page FROM lineitem")
def q_line_pages(spark, sf_dir):
    """All columns of all lines in pages of 200."""
    return chunking.pages(_t(spark, sf_dir, "lineitem"), [*_ALL_OF_LINE.split(", "), "l_returnflag", "l_linestatus"])


@query(f"SELECT *, sum(l_linenumber) OVER (ORDER BY {_ALL_OF_LINE}, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM lineitem")
def q_line_sums(spark, sf_dir):
    """All columns of all lines with a running sum over all of them."""
    return chunking.running_sum(_t(spark, sf_dir, "lineitem"), [*_ALL_OF_LINE.split(", "), "l_returnflag", "l_linestatus"], F.col("l_linenumber"), "upto")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def q_tail(spark, sf_dir):
    return chunking.tail(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 20)


# ---------------------------------------------------------------- chains, hashes


@query("""SELECT conv_id, list_reduce(list_prepend('salt', list(role || ':' || text ORDER BY turn)), lambda acc, x: sha256(acc || x)) AS entry FROM conversations GROUP BY 1""")
def q_hash_chain(spark, sf_dir):
    """Chain over the turns of each conversation."""
    entries = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("e"))))
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(entries.alias("es"))
    return rows.select("conv_id", hashing.chain(F.transform("es", lambda x: x["e"]), "salt").alias("entry"))


@query("SELECT conv_id, turn, md5(text) AS entry_hash, coalesce(lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev_hash FROM conversations")
def q_chain_lag(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, sf_dir, "conversations").withColumn("entry_hash", F.md5("text")).select("conv_id", "turn", "entry_hash", F.coalesce(F.lag("entry_hash").over(w), F.lit("")).alias("prev_hash"))


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'x' ELSE coalesce(lag(md5(text)) OVER w, '') END AS prev_hash, coalesce(lag(md5(text)) OVER w, '') AS want
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE prev_hash <> want""")
def q_chain_breaks(spark, sf_dir):
    """Links that were tampered with."""
    chained = q_chain_lag(spark, sf_dir).withColumn("prev_hash", F.when(F.col("turn") == 3, "x").otherwise(F.col("prev_hash")))
    return parts.chain_breaks(chained, ["turn"], ["conv_id"]).select("conv_id", "turn")


@query("SELECT o_orderkey, sha256(o_custkey || '|' || o_orderkey || '|' || o_orderpriority || '|' || o_orderstatus) AS fp FROM orders")
def q_row_fingerprint(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", hashing.row_fingerprint(["o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority"]).alias("fp"))


@query()
def q_subset_uuid(spark, sf_dir):
    """Ids of customer subsets; BLAKE2b has no SQL form."""
    keys = {"c_mktsegment": "TEXT", "c_nationkey": "INTEGER"}
    return identity.with_subset_uuid(_t(spark, sf_dir, "customer"), keys, {}).select("c_custkey", "subset_uuid")


@query("SELECT p_partkey, p_name FROM part")
def q_sealed_round_trip(spark, sf_dir):
    """Encrypts with bound data and opens again."""
    key, iv = F.lit(b"0123456789abcdef"), F.lit(b"abcdefghijkl")
    bound = text.aad(F.col("p_brand"), F.col("p_type"))
    sealed = text.sealed(F.col("p_name").cast("binary"), key, iv, bound)
    return _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", sealed.alias("s")).select("p_partkey", text.opened(F.col("s"), key, bound).cast("string").alias("p_name"))


# ---------------------------------------------------------------- graphs and progress


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call parts."""
    return _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))


_EDGES = "(SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


@query(f"SELECT dst, string_agg(src, ',' ORDER BY src) AS srcs FROM (SELECT DISTINCT src, dst FROM {_EDGES}) GROUP BY 1")
def q_in_edges(spark, sf_dir):
    return graph.in_edges(_edges(spark, sf_dir)).select("dst", F.array_join("srcs", ",").alias("srcs"))


@query(f"""WITH e AS {_EDGES}, s AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
k AS (SELECT DISTINCT src AS id FROM e UNION SELECT 'p' || p_partkey FROM part WHERE p_size > 25)
SELECT DISTINCT id FROM (SELECT id FROM s UNION SELECT dst FROM e JOIN s ON src = id UNION SELECT src FROM e JOIN s ON dst = id) WHERE id IN (SELECT id FROM k)""")
def q_neighborhood(spark, sf_dir):
    e = _edges(spark, sf_dir)
    seeds = _t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"))
    known = e.select(F.col("src").alias("id")).union(_t(spark, sf_dir, "part").filter("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"))).distinct()
    return graph.neighborhood(seeds, e, known)


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM {_EDGES}), d AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'new' AS dst FROM lineitem WHERE l_returnflag = 'R')
SELECT src, dst FROM e WHERE src NOT IN (SELECT src FROM d) UNION ALL SELECT src, dst FROM d""")
def q_merge_edges(spark, sf_dir):
    e = _edges(spark, sf_dir).distinct()
    delta = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.lit("new").alias("dst")).distinct()
    return graph.merge_edges(e, delta)


@query("""WITH h AS (SELECT * FROM (VALUES ('O'), ('F'), ('P'), ('X')) t(status)), c AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)
SELECT status, coalesce(n, 0) AS n, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 1)::DOUBLE AS pct FROM h LEFT JOIN c USING (status)""")
def q_status_hist(spark, sf_dir):
    return graph.status_histogram(_t(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F", "P", "X"]).select("status", "n", "pct")


@query("SELECT c_nationkey AS k, count(DISTINCT c_mktsegment) AS variants FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def q_conflicting_keys(spark, sf_dir):
    return graph.conflicting_keys(_t(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k"), "k", ["c_mktsegment"])


@query("SELECT split_part(url, '/', 3) AS top, count(*) AS n FROM pages GROUP BY 1")
def q_by_top_directory(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return graph.by_top_directory(pages).select("top", "n")


@query("SELECT k, max(ts) AS stamp FROM (SELECT user_id AS k, ts FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT user_id, ts FROM events WHERE event_type NOT IN ('view', 'click')) GROUP BY 1")
def q_upsert_stamps(spark, sf_dir):
    """Views and clicks as the base, all other events as the delta."""
    ev = _t(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("path"), F.col("ts").alias("stamp"))
    base = F.col("event_type").isin("view", "click")
    return graph.upsert_stamps(ev.filter(base), ev.filter(~base)).withColumnRenamed("path", "k")


@query("SELECT l_orderkey, row::INTEGER AS row, q, p FROM (SELECT l_orderkey, unnest(range(len(qs))) AS row, unnest(qs) AS q, unnest(ps) AS p FROM (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity) AS qs, list(l_extendedprice ORDER BY l_extendedprice) AS ps FROM lineitem GROUP BY 1))")
def q_rows_of_arrays(spark, sf_dir):
    """Columnar payloads as rows."""
    packed = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("q"), F.sort_array(F.collect_list("l_extendedprice")).alias("p"))
    return jagged.rows_of_arrays(packed, ["q", "p"])


@query(f"SELECT l_orderkey // 1000 AS part, max(seq_len) AS longest, CASE WHEN max(seq_len) <= 65535 THEN 'uint16' ELSE 'uint32' END AS width FROM {_LINES} GROUP BY 1")
def q_length_width(spark, sf_dir):
    longest = _lines(spark, sf_dir).groupBy(F.floor(F.col("l_orderkey") / 1000).alias("part")).agg(F.max("seq_len").alias("longest"))
    return longest.withColumn("width", jagged.width(F.col("longest")))


@query("""SELECT o_custkey, count(*) AS n_rows, min(n)::INTEGER AS min_0, max(n)::INTEGER AS max_0, avg(n) AS avg_0, min(m)::INTEGER AS min_1, max(m)::INTEGER AS max_1, avg(m) AS avg_1
FROM (SELECT o_custkey, o_orderkey, count(*) AS n, max(CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1""")
def q_shape_stats(spark, sf_dir):
    """Statistics of both dimensions of nested arrays: lines by order, each one or two numbers."""
    return parts.shape_stats(_grids(spark, sf_dir).withColumn("shape", jagged.shape(F.col("a"), 2)), ["o_custkey"], "shape", 2)


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = F.when(F.col("l_quantity") > 25, F.array(F.col("l_quantity"), F.col("l_quantity") + 1)).otherwise(F.array("l_quantity"))
    return joined.groupBy("o_custkey", "o_orderkey").agg(F.sort_array(F.collect_list(rows)).alias("a"))


@query("""SELECT o_orderkey, n::INTEGER AS size_0, 2 AS size_1, 12 AS least_0, total FROM (SELECT o_orderkey, count(*) AS n, sum(CASE WHEN l_quantity > 25 THEN 2 * l_quantity + 1 ELSE l_quantity END) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def q_jagged_pad_nested(spark, sf_dir):
    """Nested arrays padded to canonical extents: outer rows added, inner ones filled with zeros."""
    from pyspark.sql import types as T

    padded = _grids(spark, sf_dir).withColumn("p", jagged.pad(F.col("a"), [20, 2], T.DoubleType()))
    own = padded.select("o_orderkey", F.size("a").alias("size_0"), F.array_min(F.transform("p", lambda x: F.size(x))).alias("size_1"), F.when(F.size("p") == 20, 12).alias("least_0"), F.aggregate(F.flatten("p"), F.lit(0.0), lambda a, x: a + x).alias("total"))
    return own


@query("SELECT url FROM pages WHERE NOT (url LIKE '%.html' OR url LIKE 'http://%')")
def q_glob_ignore(spark, sf_dir):
    return _t(spark, sf_dir, "pages").filter(predicates.not_ignored(F.col("url"), ["*.html", "http://*"])).select("url")


@query("""WITH b AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'), d AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5)
SELECT 'c' || c_custkey AS fqid, 'n' || c_nationkey AS source_path FROM b WHERE c_nationkey NOT IN (SELECT c_nationkey FROM d) UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM d""")
def q_merge_nodes(spark, sf_dir):
    """Delta nodes replace all nodes of their sources."""
    n = _t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("fqid"), F.concat(F.lit("n"), "c_nationkey").alias("source_path"), "c_mktsegment", "c_nationkey")
    pick = lambda df: df.select("fqid", "source_path")
    return graph.merge_nodes(pick(n.filter("c_mktsegment <> 'BUILDING'")), pick(n.filter("c_mktsegment = 'BUILDING' and c_nationkey < 5")))


@query("""WITH e AS (SELECT 'u' || user_id AS src, 'u' || (user_id * 7 % 997) AS dst FROM events), k AS (SELECT 'u' || c_custkey AS f FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT src, dst, 'unknown source' AS reason FROM e WHERE src NOT IN (SELECT f FROM k) UNION ALL SELECT src, dst, 'unknown target' FROM e WHERE dst NOT IN (SELECT f FROM k) UNION ALL SELECT src, dst, 'calls itself' FROM e WHERE src = dst""")
def q_bad_calls(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("src"), F.concat(F.lit("u"), F.col("user_id") * 7 % 997).alias("dst"))
    n = _t(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.concat(F.lit("u"), "c_custkey").alias("fqid"))
    return graph.bad_calls(e, n)


@query("SELECT conv_id AS path, last(text ORDER BY turn) AS note, max(turn) AS updated_at FROM conversations GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20")
def q_latest_notes(spark, sf_dir):
    notes = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    modules = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("path")).agg(notes.alias("notes"), F.max("turn").alias("updated_at"))
    return graph.latest_notes(modules, 20)


@query("""SELECT o_orderkey AS path, CASE WHEN o_orderpriority = '5-LOW' AND (CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END) <= 2 THEN 'F' ELSE o_orderstatus END AS status FROM orders""")
def q_advance_status(spark, sf_dir):
    """Orders of low priority are set to F, which never takes a later status back."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return graph.advance_status(rows, rows.filter("o_orderpriority = '5-LOW'").withColumn("status", F.lit("F")), ["O", "F", "P"])


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def q_set_intersect(spark, sf_dir):
    """Users with an error that also made a large purchase, once each."""
    ev = _t(spark, sf_dir, "events")
    return parts.in_both(ev.filter("event_type = 'error'"), ev.filter("event_type = 'purchase' and value > 50"), ["user_id"])


@query("SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer")
def q_set_touched(spark, sf_dir):
    """Touched or marked subsets, once each."""
    marked = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return parts.in_either(_t(spark, sf_dir, "orders"), marked, ["o_custkey"])


@query("SELECT o_orderkey FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT 'o' || l_orderkey FROM lineitem)")
def q_without_calls(spark, sf_dir):
    """Orders, as functions with a body, that call no part."""
    nodes = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("fqid"), F.lit(True).alias("has_body"))
    return graph.without_calls(nodes, _edges(spark, sf_dir)).select("o_orderkey")


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN p_name ELSE p_name[1:5] || chr(10) || '…' || chr(10) || p_name[-3:] END AS trimmed, replace(p_brand || '|' || p_type, '|', chr(92) || '|') AS cell FROM part")
def q_trimmed_cells(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.trimmed(F.col("p_name"), 5, 3).alias("trimmed"), text.table_cell(F.concat_ws("|", "p_brand", "p_type")).alias("cell"))


@query("""SELECT o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'previous' ELSE 'current' END AS role, o_orderkey AS path FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT c_custkey, 'next', c_nationkey FROM customer""")
def q_promote(spark, sf_dir):
    """Queues of orders by customer, by status previous, current or next, one step on."""
    role = F.when(F.col("o_orderstatus") == "O", "previous").when(F.col("o_orderstatus") == "F", "current").otherwise("next")
    queue = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), role.alias("role"), F.col("o_orderkey").alias("path"))
    following = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_nationkey").cast("long").alias("path"))
    return graph.promote(queue, following)


from keyloft.plans import store_queries  # noqa: E402

QUERIES |= store_queries.QUERIES
ORACLE |= store_queries.ORACLE
