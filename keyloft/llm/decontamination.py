"""Benchmark decontamination as a prefix-filtered set join, in column expressions only.

A window (13 consecutive words of an item, or a shorter item as a whole) is a set of word shingles with places. To occur in
a document all of its shingles must be there, so one of them is a sufficient prefix: the window's rarest, by occurrences
in all documents. Documents are joined to windows on that shingle alone. The shingle's place in the window gives the only
place where the window could start (positional bound); it must lie inside the document (length bound); then the words
themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.llm.common import Scratch, let, lower_ascii, table

#: Words of a shingle; items of fewer words have shingles as long as they are.
SHINGLE = 3
#: Windows are broadcast up to this many bytes (their measured text with 64 bytes a row); more are joined by shuffling.
BROADCAST_BYTES = 64 << 20


def alnum_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A to Z; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows of the items: words (array), k (shingle length), items (sorted ids; a null id is left out)."""
    items = benchmark.select(F.col("item_id"), alnum_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    each = items.select("item_id", F.explode(let(F.col("w"), lambda w: F.transform(starts, lambda i: F.slice(w, i, window)))).alias("words"))
    grouped = each.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return grouped.withColumn("k", F.least(F.lit(SHINGLE), F.size("words")))


def _shingle(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from place ``at`` (from 0); null beyond the end."""
    parts = [F.get(words, at + i) for i in range(k)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(k), *parts))


def _document_shingles(docs: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """Every shingle (at, h) of every document for the given lengths, beside the columns in keep; words is only referred to.

    A document without words has one row with null at and h.
    """
    placed = docs.select(*keep, "words", F.posexplode_outer("words").alias("at", "_w"))
    keys = [_shingle(F.col("words"), F.col("at"), k) for k in lengths]
    h = keys[0] if len(keys) == 1 else F.explode(F.array(*keys))
    return placed.select(*keep, "words", "at", h.alias("h"))


def _anchors(docs: DataFrame, windows: DataFrame, lengths: list[int], hint, scratch: Scratch) -> DataFrame:
    """For each window that can occur at all, its rarest shingle: h, o (the shingle's place in the window), window, items, wid."""
    none = F.array().cast("array<struct<o:int,h:bigint>>")

    def shingles(k: int) -> Column:
        return let(F.col("words"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("o"), _shingle(w, i, k).alias("h"))))

    of_window = F.concat(*[F.when(F.col("k") == k, shingles(k)).otherwise(none) for k in lengths])
    places = scratch.save(windows.select("wid", F.explode(of_window).alias("p")).select("wid", "p.o", "p.h"), "places")
    seen = _document_shingles(docs, lengths).select("h").join(hint(places.select("h").distinct()), "h", "left_semi")
    counts = scratch.save(seen.groupBy("h").agg(F.count("*").alias("n")), "counts")
    # a shingle that no document holds rules its window out
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "h")
    rarest = places.join(counts, "h", "left").groupBy("wid").agg(F.min(order).alias("r")).filter("r.n > 0").select("wid", "r.o", "r.h")
    return scratch.save(rarest.join(windows, "wid").select("h", "o", F.col("words").alias("window"), "items", "wid"), "anchors")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rid, doc_id, text_key, n_words, start, length, items: each place (from 0) where a window occurs in a document.

    rid numbers the rows of docs, text_key is the SHA-256 of the text. Each row of docs also has at least one row here with start, length and items null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    windows = scratch.save(item_windows(benchmark, window).withColumn("wid", F.monotonically_increasing_id()), "windows")
    bytes_of = F.lit(64) + F.aggregate("words", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + 16 * F.size("items")
    size, lengths = windows.agg(F.coalesce(F.sum(bytes_of), F.lit(0)), F.sort_array(F.collect_set("k"))).first()
    small = size <= broadcast_bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"), text_key(F.col("text")).alias("text_key"))
    if not small:
        rows = scratch.save(rows, "rows")
    rows = rows.select("rid", "doc_id", "text_key", alnum_words(F.col("text")).alias("words"))
    anchors = _anchors(rows, windows, lengths or [SHINGLE], F.broadcast if small else (lambda df: df), scratch)

    start = F.col("at") - F.col("o")
    fits = (start >= 0) & (start + F.size("window") <= F.size("words"))
    same = F.coalesce(fits & F.when(fits, F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")), F.lit(False))
    found = [F.when(same, x).alias(name) for x, name in ((start, "start"), (F.size("window"), "length"), (F.col("items"), "items"))]
    out = ["rid", "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), *found]
    if small:
        near = _document_shingles(rows, lengths or [SHINGLE], "rid", "doc_id", "text_key").join(F.broadcast(anchors), "h", "left")
        return near.filter(same | F.coalesce(F.col("at") == 0, F.lit(True))).select(*out)
    near = _document_shingles(rows, lengths, "rid").select("rid", "at", "h").join(anchors.select("h", "o", "wid"), "h").select("rid", "at", "o", "wid")
    near = near.join(rows, "rid").join(anchors.select("wid", "window", "items"), "wid").filter(same)
    none = rows.select("rid", "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast(windows.schema["items"].dataType).alias("items"))
    return near.select(*out).union(none)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans (start, length), items and text_key, for each row of docs.

    Null or wordless texts have no hits; null or wordless items have no windows; an item of a null id marks words but is
    not counted. Repeated rows are answered each; other columns are ignored; empty tables are allowed on both sides. A text
    of any length is read whole, as one cell; its words come as rows of their own.
    """
    spans = F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length"))))
    rows = occurrences(docs, benchmark, window, broadcast_bytes).groupBy("rid", "doc_id").agg(F.first("text_key").alias("text_key"), F.max("n_words").alias("n_words"), spans.alias("spans"), F.collect_set("items").alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))

    def cover(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["to"], x["start"]))).alias("n"), F.greatest(acc["to"], end).alias("to"))

    items = F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string")))
    rows = rows.withColumn("items", items).withColumn("n_hit", F.aggregate("spans", zero, cover)["n"].cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "items",
        "text_key",
    )


def text_key(text: Column) -> Column:
    """What contamination calls a text: its SHA-256."""
    return F.unhex(F.sha2(text.cast("string"), 256))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in 13-word windows of the benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items", "text_key")


#: Every window of every document is looked up among the windows of the items.
OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS g
  FROM (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: w[i:i + 12])) AS win FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n),
found AS (SELECT doc_id, item_id, i, places.n FROM places JOIN windows ON windows.n = places.n AND windows.g = array_to_string(w[i:i + places.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
