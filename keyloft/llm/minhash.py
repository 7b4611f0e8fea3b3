"""MinHash near-duplicate detection with circulant MinHash.

Two permutations make all signature coordinates: the first scatters an element over a universe of D places, the second is
read through a window that moves by one place per coordinate (a circular shift). The K values of an element are therefore
K neighbouring entries of one table, and a signature is the columnwise minimum of such rows.

Bands of the signature propose candidates, and every link is confirmed on full shingle sets:

1. texts with equal sets form one class, represented by its smallest doc_id;
2. in each bucket of a band the members are compared to the bucket's best known member (whose buckets hold most), first
   once per member, then wherever the two are not yet in one component;
3. where the members of a leader's buckets still are in several components, those outside the largest one are compared to
   all the others: as blocks of sets, in tasks of bounded size that return links only. Members that share too few of their
   shingles with anything at all are left out first.

So no bucket is expanded into all its pairs, none is capped, and the components are those of the full link relation. A
pair of similarity 0.8 shares none of 32 bands of 4 coordinates with a chance of about 5e-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.llm.common import Scratch, map_arrow, semi_join, table, worker_store
from keyloft.llm.components import components
from keyloft.llm.shingling import shingle_sets, splitmix

#: Places of the universe that the permutations act on.
UNIVERSE = 1 << 20
#: Documents of either side in a block of the last comparison.
BLOCK_X, BLOCK_Y = 256, 2048
SHARED = ("circulant", "shingling")


def _windows(coordinates: int, seed: int) -> np.ndarray:
    """Row x holds the values of place x under the second permutation and its circular shifts."""
    key = ("circulant", coordinates, seed)
    store = worker_store()
    if key not in store:
        order = np.argsort(splitmix(np.arange(UNIVERSE, dtype=np.uint64) + np.uint64(seed << 32)), kind="stable").astype(np.int32)
        store[key] = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: coordinates - 1]]), coordinates)
    return store[key]


def signature(shingles: np.ndarray, coordinates: int, seed: int = 7) -> np.ndarray:
    """Circulant MinHash signature of a non-empty set of 64-bit hashes."""
    windows = _windows(coordinates, seed)
    with np.errstate(over="ignore"):
        places = np.unique(((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64))
    out = windows[places[:2048]].min(axis=0)
    for at in range(2048, len(places), 2048):
        out = np.minimum(out, windows[places[at : at + 2048]].min(axis=0))
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1).astype(np.uint64)
    out = splitmix(np.arange(bands, dtype=np.uint64))
    for i in range(rows.shape[1]):
        out = splitmix(out ^ rows[:, i])
    return out.view(np.int64)


def _utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def profiles(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set, keys of the bands; one row per input row."""

    def run(batches):
        kinds = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ns, fps, keys = [], [], []
                for s in shingle_sets(_utf8(part.column("text")), width):
                    ns.append(len(s))
                    fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(signature(s, bands * rows), bands) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=kinds)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_shingles long, fp binary, bands array<long>", SHARED)


def _measure(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b, common, size_a, size_b of each pair, from the full sets of the two documents' texts."""

    def run(batches):
        kinds = pa.schema([(c, pa.int64()) for c in ("a", "b", "common", "size_a", "size_b")])
        held: dict[int, tuple[bytes, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = (part.column("a").to_pylist(), part.column("b").to_pylist())
                sets_a = list(shingle_sets(_utf8(part.column("text_a")), width))
                out = []
                for a, b, sa, tb in zip(*ids, sets_a, _utf8(part.column("text_b"))):
                    if b not in held or held[b][0] != tb:
                        if len(held) > 16:
                            held.clear()
                        held[b] = (tb, next(iter(shingle_sets([tb], width))))
                    sb = held[b][1]
                    common = len(np.intersect1d(sa, sb, assume_unique=True))
                    out.append((a, b, common, len(sa), len(sb)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, schema=kinds)

    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return map_arrow(pairs.select("a", "b").join(ta, "a").join(tb, "b"), run, "a long, b long, common long, size_a long, size_b long", SHARED)


def _private(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """set, private: how many shingles of a set no other set of these texts holds (none: no row); and rep, set, hashes: the sets.

    A set goes by a hash of its fingerprint, so that several texts of a document count apart and equal ones as one.
    """

    def run(batches):
        kinds = pa.schema([("rep", pa.int64()), ("fp", pa.binary()), ("hashes", pa.list_(pa.int64()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [s.view(np.int64) for s in shingle_sets(_utf8(part.column("text")), width)]
                fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], schema=kinds)

    sets = map_arrow(texts.select("doc_id", "text"), run, "rep long, fp binary, hashes array<long>", SHARED).select("rep", F.xxhash64("fp").alias("set"), "hashes")
    held = sets.select("set", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("set").alias("set"), F.max("set").alias("last"))
    return held.filter("set = last").groupBy("set").agg(F.count("*").alias("private")), sets


def _links_in_block(percent: int):
    """For a table with rows of two sides (x or not), the links between sides and across roots; one per x and root of y."""

    def run(rows: pa.Table) -> pa.Table:
        names = ("rep", "root", "hashes")
        sides = [rows.filter(pa.compute.equal(rows.column("x"), flag)) for flag in (True, False)]
        (xr, xroot, xs), (yr, yroot, ys) = ([side.column(c).to_pylist() if c != "hashes" else [np.sort(np.array(h, np.int64)) for h in side.column(c).to_pylist()] for c in names] for side in sides)
        found: dict[tuple[int, int], int] = {}
        if xs and ys:
            row = np.repeat(np.arange(len(xs)), [len(h) for h in xs])
            flat = np.concatenate(xs)
            order = np.argsort(flat, kind="stable")
            flat, row = flat[order], row[order]
            nx, roots = np.array([len(h) for h in xs]), np.array(xroot)
            for rep, root, h in zip(yr, yroot, ys):
                lo, n = np.searchsorted(flat, h, "left"), 0
                spans = np.searchsorted(flat, h, "right") - lo
                n = int(spans.sum())
                if not n:
                    continue
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(n)
                common = np.bincount(row[at], minlength=len(xs))
                for i in np.flatnonzero((common * 100 >= percent * (nx + len(h) - common)) & (roots != root)).tolist():
                    found.setdefault((xr[i], root), rep)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array(list(found.values()), pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """Components of documents whose shingle sets have ``100 * common >= percent * union``.

    Returns doc_id, n_shingles, component_id, kept for every row of docs. width is the number of words of a shingle.

    Null or blank texts have an empty set and no links. Rows that share a doc_id count as one document (linked through
    any of their texts); rows with a null doc_id are returned with a null component_id, kept, and take no part. Other
    columns are ignored. A text of any length is hashed whole, in pieces. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    linked = (F.col("common") * 100 >= percent * (F.col("size_a") + F.col("size_b") - F.col("common"))) & (F.col("common") > 0)

    rows_of = scratch.save(profiles(docs, width, bands, rows), "profiles")
    valid = rows_of.filter("fp is not null and doc_id is not null")
    classes = scratch.save(valid.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")), "classes")
    shared = classes.filter("rep < last").select("fp", "rep")
    placed = scratch.save(rows_of.drop("bands").join(shared, "fp", "left").withColumn("rep", F.coalesce("rep", "doc_id")), "placed")
    # a doc_id with several texts joins their classes
    same_id = placed.filter("fp is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
    several = placed.join(same_id.select("doc_id", "a"), "doc_id").filter("rep > a").select("a", F.col("rep").alias("b"))

    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    # what is found per key is written before it is joined to the rows of the key: a join of two plain tables can be split
    # where a key is hot, one that reuses the grouping of an aggregate can't
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("size")).filter("first < last").select("key", "size")
    members = scratch.save(keyed.join(scratch.save(buckets, "buckets"), "key"), "in-buckets")
    known = scratch.save(members.groupBy("rep").agg(F.sum("size").alias("known")), "known")
    members = members.join(known, "rep")
    leaders = members.groupBy("key").agg(F.max(F.struct("known", -F.col("rep"))).alias("l")).select("key", (-F.col("l.col2")).alias("leader"))
    members = scratch.save(members.join(scratch.save(leaders, "leaders"), "key").select("rep", "n", "key", "known", "leader"), "members")
    once_each = scratch.save(members.filter("rep <> leader").select("rep", "leader").distinct(), "pairs")
    fame = known.withColumnsRenamed({"rep": "leader", "known": "fame"})
    candidates = scratch.save(once_each.join(fame, "leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"), "fame"), "candidates")
    wanted = candidates.select(F.col("a").alias("doc_id")).union(candidates.select(F.col("b").alias("doc_id"))).distinct()
    texts = scratch.save(semi_join(docs, wanted, "doc_id"), "texts")

    once = candidates.groupBy("a").agg(F.max(F.struct("fame", -F.col("b"))).alias("l")).select("a", (-F.col("l.col2")).alias("b"))
    links = scratch.save(_measure(once, texts, width).filter(linked).select("a", "b").union(several), "links")
    labels = components(links, scratch)
    label = lambda df, c, out: df.join(labels.select(F.col("v").alias(c), F.col("root").alias(out)), c, "left").withColumn(out, F.coalesce(out, c))

    rest = label(label(candidates.select("a", "b"), "a", "ra"), "b", "rb").filter("ra <> rb").select("a", "b").join(once, ["a", "b"], "left_anti")
    rest = scratch.save(_measure(rest, texts, width), "rest")
    if not rest.filter(linked).isEmpty():
        links = scratch.save(links.union(rest.filter(linked).select("a", "b")), "links")
        labels = components(links, scratch)

    crowd = candidates.select(F.col("b").alias("leader"), F.col("a").alias("rep")).union(candidates.select(F.col("b").alias("leader"), F.col("b").alias("rep"))).distinct()
    crowd = scratch.save(label(crowd, "rep", "root"), "crowd")
    several_roots = crowd.groupBy("leader").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("leader")
    mixed = scratch.save(crowd.join(scratch.save(several_roots, "several-roots"), "leader"), "mixed")
    if not mixed.isEmpty():
        ids = mixed.select(F.col("rep").alias("doc_id")).distinct()
        private, sets = _private(texts.join(ids, "doc_id", "left_semi"), width)
        # whatever two sets share is private to neither, so a set with many private shingles has no link at all
        own = valid.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.xxhash64("fp").alias("set"), F.col("n_shingles").alias("n")).distinct()
        able = own.join(private, "set", "left").withColumn("shared", F.col("n") - F.coalesce("private", F.lit(0))).filter(F.col("shared") * 100 >= percent * F.col("n")).select("rep", "set")
        mixed = scratch.save(mixed.join(able, "rep"), "able")
        sizes = mixed.groupBy("leader", "root").agg(F.count("*").alias("size"))
        groups = sizes.groupBy("leader").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("all"), F.count("*").alias("roots")).filter("roots > 1")
        groups = groups.select("leader", F.col("most.root").alias("major"), F.ceil((F.col("all") - F.col("most.size")) / BLOCK_X).cast("int").alias("nx"), F.ceil(F.col("all") / BLOCK_Y).cast("int").alias("ny"))
        placed_x = mixed.join(scratch.save(groups, "groups"), "leader").withColumn("mine", F.pmod(F.xxhash64("rep", "set"), F.col("nx"))).withColumn("other", F.pmod(F.xxhash64("rep", "set"), F.col("ny")))
        x = placed_x.filter("root <> major").select("leader", F.col("mine").alias("bx"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny").cast("long") - 1)).alias("by"), "rep", "set", "root", F.lit(True).alias("x"))
        y = placed_x.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx").cast("long") - 1)).alias("bx"), F.col("other").alias("by"), "rep", "set", "root", F.lit(False).alias("x"))
        blocks = x.union(y).join(sets, ["rep", "set"]).select("leader", "bx", "by", "rep", "root", "hashes", "x")
        cross = scratch.save(blocks.groupBy("leader", "bx", "by").applyInArrow(_links_in_block(percent), "a long, b long"), "cross")
        if not cross.isEmpty():
            labels = components(links.union(cross), scratch)

    # labels and placed are all that is read from here on
    scratch.drop(rows_of, classes, members, once_each, candidates, texts, links, rest, crowd, mixed)
    out = placed.join(labels.select(F.col("v").alias("rep"), "root"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents: 2-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: Every pair that shares a shingle is counted, linked at 0.8, and closed over the links.
OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words
), sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS sh FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM items a JOIN items b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT sides.y, reach.r FROM reach JOIN sides ON sides.x = reach.v
)
SELECT n.doc_id, n.n AS n_shingles, min(r.r) AS component_id, n.doc_id = min(r.r) AS kept
FROM sizes n JOIN reach r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
"""
