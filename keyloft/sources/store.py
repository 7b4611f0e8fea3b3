"""Subset-keyed datasets: append, query, read, delete, reconcile, merge.

Rows of a dataset belong to subsets, one per distinct key tuple. A subset's rows are sealed into parts of at most part_rows
rows; a part's id follows from its subset and content, so repeated writes and retried tasks give the same parts, and equal
content is stored once per subset.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloft.errors import CommitConflict, DataExceedsCanon, IdentityConflict, InvalidKeyValue, SchemaMismatch, named, translated
from keyloft.functions.hashing import chain_entry, content_hash
from keyloft.functions.identity import with_subset_uuid
from keyloft.functions.jagged import length, shape
from keyloft.functions.timeutil import iso
from keyloft.operators import parts as P
from keyloft.operators.chunking import bounds, lifted, numbered_ranges, subset_bounds
from keyloft.operators.parts import CODEBOOK_LENGTHS, CODEBOOK_SHARE
from keyloft.operators.predicates import compile_predicates, live, time_window
from keyloft.plans.planner import bounded, plan_parts, residual
from keyloft.schema import RESERVED, depth, field_json, field_types, fingerprint, key_type, normal_type, safe_name, structured
from keyloft.sources.catalog import Added, Catalog, Snapshot

DEFAULT_PART_ROWS = 100_000
#: What hooks are told, beside commit.begin, commit.done and commit.lost of the catalog.
EVENTS = ("ingest.begin", "ingest.parts_hashed", "ingest.parts_written", "batch.committed", "compact.committed", "gc.committed", "merge.begin", "merge.parts_copied", "merge.committed")
_HASHED = "subset_uuid string, part_ordinal long, content_hash string, n_rows long, part_stats_json string"


def _uuid(text: str) -> str:
    return str(uuid.UUID(bytes=hashlib.blake2b(text.encode(), digest_size=16).digest()))


@F.udf(T.StringType(), useArrow=True)
def part_id(subset: str, content: str) -> str:
    return _uuid(f"{subset},{content}")


@dataclass
class Meta:
    """Result of a query: a plan that can be looked at and narrowed before data() runs it."""

    alias: str
    info: dict
    snapshot: Snapshot
    subsets: DataFrame
    parts: DataFrame

    def total_rows(self) -> int:
        """Rows of all parts selected, by the parts table alone."""
        return self.parts.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]


@dataclass
class Data:
    """rows is lazy; missing names the parts that were not there; offsets of those that were are computed when asked for."""

    rows: DataFrame
    missing: list[str]
    subsets: DataFrame
    parts: DataFrame

    @cached_property
    def bounds(self) -> DataFrame:
        """row_start and row_end of each part read, in subset and part order."""
        return bounds(self.parts)

    @cached_property
    def subset_bounds(self) -> DataFrame:
        """row_start, row_end, part_start, part_end of each subset, in order; all 0 for a selection without parts."""
        return subset_bounds(self.subsets, self.parts)


@dataclass
class MergeReport:
    batches: list[str]
    new_parts: int
    duplicate_parts: int
    dry_run: bool


class Store:
    """All datasets under one root folder."""

    def __init__(self, spark: SparkSession, root: str, producer_id: str = "local", salt: str = ""):
        self.spark, self.catalog, self.producer_id, self.salt = spark, Catalog(spark, root, self._tell), producer_id, salt
        self.files = self.catalog.files
        self.hooks: list = []

    def _tell(self, event: str, **what) -> None:
        """Calls every hook with the event's name and what is known of it; a hook that fails is the caller's failure."""
        for hook in self.hooks:
            hook(event, what)

    # ------------------------------------------------------------------ writing

    def init_dataset(self, alias: str, key_schema: dict[str, str] | None = None, key_order: list[str] | None = None, fields: dict[str, T.DataType] | None = None, part_rows: int = DEFAULT_PART_ROWS, quantization: dict[str, float] | None = None, jagged: list[str] | dict[str, list[int]] | None = None, compression: str = "zstd", compression_level: int | None = None) -> str:
        """Creates a dataset and locks what is given of its schema; a second call must agree.

        jagged names the fields of varying extent, with their canonical extents or without: the first batch then sets them.
        """
        if part_rows < 1:
            raise ValueError("part_rows is at least 1")
        uid = self.catalog.ensure_dataset(alias)

        def build(head: Snapshot):
            if head.schema:
                return None
            return self._schema(key_schema or {}, key_order, fields or {}, part_rows, quantization or {}, jagged or [], compression, compression_level), {}, {"op": "init"}

        self.catalog.commit(alias, build)
        return uid

    @staticmethod
    def _schema(keys, order, fields, part_rows, scales, jagged, compression, level=None) -> dict:
        for k in [*keys, *fields]:
            safe_name(k)
        if taken := set(keys) & set(RESERVED):
            raise ValueError(f"reserved: {sorted(taken)}")
        order = order or sorted(keys)
        canonical = {k: list(v) for k, v in jagged.items()} if isinstance(jagged, dict) else {}
        return {"key_schema": {k: keys[k] for k in order}, "key_order": order, "fields": field_json(fields), "part_config": {"part_rows": part_rows, "compression": compression} | ({"compression_level": level} if level is not None else {}), "quantization": scales, "jagged": sorted(jagged), "canonical": canonical, "encryption": {"mode": "none"}}

    def append(self, alias: str, df: DataFrame, keys: list[str], order: list[str], part_rows: int = DEFAULT_PART_ROWS, quantization: dict[str, float] | None = None, jagged: list[str] | dict[str, list[int]] | None = None, bid: str | None = None) -> Snapshot:
        """Seals all rows of df, for all subsets at once, in one commit.

        ``order`` names columns whose values order the rows of a subset; where they tie, the fields decide. A batch id that
        is already committed is left alone, so replays are harmless. Null keys, values that do not fit and jagged values
        beyond the canonical extents raise InvalidKeyValue, SchemaMismatch and DataExceedsCanon; nothing is committed then.
        """
        self._tell("ingest.begin", alias=alias)
        fields = [c for c in df.columns if c not in keys]
        given_keys = {k: key_type(df.schema[k].dataType) for k in keys}
        given_fields = {f: normal_type(df.schema[f].dataType) for f in fields}
        self.init_dataset(alias, given_keys, None, given_fields, part_rows, quantization, jagged)
        head = self.catalog.head(alias)
        if not head.schema["key_schema"] and not head.schema["fields"]:
            schema = self._schema(given_keys, None, given_fields, head.schema["part_config"]["part_rows"], head.schema["quantization"] or quantization or {}, head.schema["jagged"] or jagged or [], head.schema["part_config"]["compression"])
            head = self.catalog.commit(alias, lambda h: (schema, {}, {"op": "lock"}))
        schema = head.schema
        if schema["key_schema"].keys() != given_keys.keys() or any(schema["key_schema"][k] != t and (schema["key_schema"][k], t) != ("REAL", "INTEGER") for k, t in given_keys.items()):
            raise SchemaMismatch(f"keys {given_keys} are not {schema['key_schema']}")
        stored = field_types(schema["fields"])
        bid = bid or uuid.uuid4().hex
        if self._has_batch(alias, head, bid):
            return head
        staging = f"{self.catalog.folder(alias)}/data/{bid}-{uuid.uuid4().hex[:8]}"
        with translated():
            schema, numbered, sealed = self._seal(df, schema, stored, order, staging)
            return self._commit_parts(alias, schema, numbered, sealed, bid, staging)

    def _has_batch(self, alias: str, head: Snapshot, bid: str) -> bool:
        return not self.catalog.table(alias, head, "batches").filter((F.col("bid") == bid) & (F.col("producer_id") == self.producer_id)).isEmpty()

    def _seal(self, df: DataFrame, schema: dict, stored: dict, order: list[str], staging: str, own_order: tuple[str, ...] = ()) -> tuple[dict, DataFrame, DataFrame]:
        """Numbers and hashes the rows of df: the schema with canonical extents, the numbered rows, and one row per part.

        Rows are written once, in ordered ranges; whatever follows reads them there. own_order names columns that order rows
        and are not stored.
        """
        keys = schema["key_schema"]
        fields = structured(df, [c for c in df.columns if c not in keys and c not in own_order], stored)
        checked = [F.when(F.col(k).isNull(), F.raise_error(F.lit(named(InvalidKeyValue, f"key {k} is null"))).cast(df.schema[k].dataType)).otherwise(F.col(k)).cast("double" if keys[k] == "REAL" else df.schema[k].dataType).alias(k) for k in keys]
        rows = with_subset_uuid(df.select(*checked, *fields, *own_order), keys, schema["quantization"], lambda ids: self._save(ids, f"{staging}/_ids"))
        for name in schema["jagged"]:
            dims = depth(stored[name])
            rows = rows.withColumn(*((f"{name}_len", length(F.col(name))) if dims == 1 else (f"{name}_shape", shape(F.col(name), dims))))
        tie = list(own_order) or [c for c in sorted(stored) if depth(stored[c]) == 0 and c not in order]
        ranged = self._save(numbered_ranges(rows, ["subset_uuid"], [*order, *tie]), f"{staging}/_ranged")
        schema = schema | {"canonical": self._canonical(ranged, schema, stored)}
        per_part, place = schema["part_config"]["part_rows"], F.col("row_in_subset")
        numbered = lifted(ranged, ["subset_uuid"]).withColumn("part_ordinal", F.floor(place / per_part).cast("long")).withColumn("row_in_part", (place % per_part).cast("long"))
        hashed = numbered.select("subset_uuid", "part_ordinal", "row_in_part", *self._own(schema)).groupBy("subset_uuid", "part_ordinal").applyInArrow(_hash_part(stored, schema), _HASHED)
        hashed = hashed.withColumn("part_uuid", part_id("subset_uuid", "content_hash"))
        key_cols = [c for k in keys for c in ([k, f"{k}_s", f"{k}_q"] if keys[k] == "REAL" else [k])]
        firsts = numbered.filter(place == 0).select("subset_uuid", *key_cols)
        sealed = self._save(hashed.join(firsts, "subset_uuid"), f"{staging}/_parts")
        self._tell("ingest.parts_hashed", staging=staging)
        return schema, numbered, sealed

    @staticmethod
    def _own(schema: dict) -> list[str]:
        """Stored columns of a row beside its ids."""
        fields = field_types(schema["fields"])
        return sorted([*fields, *[f"{n}_len" if depth(fields[n]) == 1 else f"{n}_shape" for n in schema["jagged"]]])

    @staticmethod
    def _canonical(rows: DataFrame, schema: dict, stored: dict) -> dict[str, list[int]]:
        """Canonical extents of the jagged fields: those that are locked, else the longest of these rows."""
        extents = {n: [F.col(f"{n}_len")] if depth(stored[n]) == 1 else [F.get(f"{n}_shape", F.lit(d)) for d in range(depth(stored[n]))] for n in schema["jagged"]}
        if not extents:
            return {}
        longest = rows.agg(*[F.array(*[F.coalesce(F.max(x), F.lit(0)) for x in xs]).alias(n) for n, xs in extents.items()]).first()
        return _within({n: longest[n] for n in extents}, schema.get("canonical", {}))

    def _save(self, df: DataFrame, rel: str) -> DataFrame:
        df.write.parquet(self.files.uri(rel))
        return self.spark.read.schema(df.schema).parquet(self.files.uri(rel))

    def _write_parts(self, alias: str, schema: dict, rows: DataFrame, parts: DataFrame, target: str) -> None:
        """Writes one folder per part under target/p, and beside it what each part says of itself."""
        data = rows.select("subset_uuid", "part_uuid", "row_in_part", *self._own(schema)).withColumn("p", F.col("part_uuid"))
        config = schema["part_config"]
        out = data.repartition("part_uuid").sortWithinPartitions("part_uuid", "row_in_part").write.partitionBy("p").option("compression", config["compression"])
        if "compression_level" in config:
            out = out.option("parquet.compression.codec.zstd.level", config["compression_level"])
        about = parts.select("part_uuid", "subset_uuid", "content_hash", "n_rows", "part_stats_json")
        about = about.withColumns({"dataset_uuid": F.lit(self.catalog.info(alias)["dataset_uuid"]), "scheme_version": F.lit(1).cast("long"), "producer_id": F.lit(self.producer_id), "batch_id": F.lit(target.rpartition("/")[2]), "created_at_epoch": F.lit(self.catalog.now())})
        with ThreadPoolExecutor(2) as pool:
            both = [pool.submit(out.parquet, self.files.uri(f"{target}/p")), pool.submit(about.hint("rebalance").write.parquet, self.files.uri(f"{target}/header"))]
            for each in both:
                each.result()

    def _commit_parts(self, alias: str, schema: dict, numbered: DataFrame, sealed: DataFrame, bid: str, staging: str, instead_of: DataFrame | None = None) -> Snapshot:
        """Writes the parts that are new and commits; parts that were deleted softly are revived instead of written again.

        Parts that were there at first and are gone when the commit is built, by garbage collection, are written then. With
        instead_of (part_uuid), those parts leave the table in the same commit, if they all still are live.
        """
        keys = [c for c in sealed.columns if c not in ("subset_uuid", "part_ordinal", "content_hash", "n_rows", "part_stats_json", "part_uuid")]
        unique = self._save(P.first_wins(sealed, ["subset_uuid", "content_hash"], ["part_ordinal"]), f"{staging}/_unique")
        written: list[tuple[DataFrame, str]] = []

        def write(parts: DataFrame) -> None:
            target = f"{staging}/w{len(written)}"
            chosen = parts if parts is unique else self._save(parts, f"{staging}/_new{len(written)}")
            rows = numbered.join(chosen.select("subset_uuid", "part_ordinal", "part_uuid"), ["subset_uuid", "part_ordinal"])
            self._write_parts(alias, schema, rows, chosen, target)
            written.append((chosen, target))

        first = self.catalog.head(alias)
        write(P.not_present(unique, self.catalog.table(alias, first, "parts"), ["part_uuid"]) if first.paths.get("parts") else unique)
        self._tell("ingest.parts_written", bid=bid)

        def build(head: Snapshot):
            if self._has_batch(alias, head, bid):
                return None
            canonical = _within(schema["canonical"], head.schema.get("canonical", {}))
            now = self.catalog.now()
            subsets, held = self.catalog.table(alias, head, "subsets"), self.catalog.table(alias, head, "parts")
            if first.paths.get("parts"):  # else everything was written
                absent = P.not_present(unique, held, ["part_uuid"])
                for chosen, _ in written:
                    absent = P.not_present(absent, chosen, ["part_uuid"])
                if not absent.isEmpty():
                    write(absent)
            added = None
            for chosen, target in written:
                rows = (P.not_present(chosen, held, ["part_uuid"]) if head.paths.get("parts") else chosen).select(
                    "part_uuid", "subset_uuid", F.lit(now).alias("created_at_epoch"), "n_rows", F.lit(1).cast("long").alias("scheme_version"),
                    F.concat(F.lit(f"{target.split('/', 2)[2]}/p/p="), F.col("part_uuid")).alias("file_relpath"), F.lit(False).alias("marked_for_deletion"), "content_hash",
                    F.lit(self.producer_id).alias("producer_id"), F.lit(bid).alias("batch_id"), "part_stats_json", F.lit(0).alias("enc_version"), F.lit(None).cast("string").alias("key_ref"), F.lit(None).cast("binary").alias("nonce"), F.lit(None).cast("binary").alias("tag"), F.lit(None).cast("long").alias("plaintext_size"),
                )
                added = rows if added is None else added.unionByName(rows)
            tables: dict[str, DataFrame | Added] = {}
            marked = held.filter("marked_for_deletion").select("part_uuid")
            none_marked = not head.paths.get("parts") or marked.isEmpty()
            marked = marked.join(unique.select("part_uuid"), "part_uuid", "left_semi")
            if instead_of is not None:
                if not instead_of.join(held.filter(live()), "part_uuid", "left_anti").isEmpty():
                    raise CommitConflict("parts to be replaced are gone")
                kept = P.not_present(held, P.not_present(instead_of, unique, ["part_uuid"]), ["part_uuid"])
                tables["parts"] = self._unmarked(kept, marked, "part_uuid").unionByName(added.select(kept.columns))
                tables["dropped"] = Added(self._dropped(held.join(P.not_present(instead_of, unique, ["part_uuid"]), "part_uuid", "left_semi"), now))
            elif none_marked:
                tables["parts"] = Added(added.select(held.columns))
            else:
                tables["parts"] = self._unmarked(held, marked, "part_uuid").unionByName(added.select(held.columns))
            touched = sealed.groupBy("subset_uuid").agg(*[F.first(k).alias(k) for k in keys])
            fresh = P.not_present(touched, subsets, ["subset_uuid"]).withColumns({"created_at_epoch": F.lit(now), "marked_for_deletion": F.lit(False), "total_rows": F.lit(0).cast("long")}).select(subsets.columns)
            marked = subsets.filter("marked_for_deletion").select("subset_uuid")
            none_marked = not head.paths.get("subsets") or marked.isEmpty()
            marked = marked.join(touched.select("subset_uuid"), "subset_uuid", "left_semi")
            tables["subsets"] = Added(fresh) if none_marked else self._unmarked(subsets, marked, "subset_uuid").unionByName(fresh)
            tables |= self._batch_tables(alias, head, schema, self.producer_id, bid, unique, now)
            return schema | {"canonical": canonical}, tables, {"op": "append" if instead_of is None else "compact", "bid": bid}

        snapshot = self.catalog.commit(alias, build)
        for name in self.files.names(staging):
            if name.startswith("_"):
                self.files.delete(f"{staging}/{name}")
        self._tell("batch.committed", bid=bid, version=snapshot.version)
        return snapshot

    @staticmethod
    def _unmarked(df: DataFrame, which: DataFrame, key: str) -> DataFrame:
        again = which.select(key).distinct().withColumn("_again", F.lit(True))
        return df.join(again, key, "left").withColumn("marked_for_deletion", F.col("marked_for_deletion") & F.col("_again").isNull()).select(df.columns)

    @staticmethod
    def _dropped(parts: DataFrame, now: int) -> DataFrame:
        return parts.select("file_relpath", F.lit(now).cast("long").alias("dropped_at"))

    def _batch_tables(self, alias: str, head: Snapshot, schema: dict, producer: str, bid: str, parts: DataFrame, now: int) -> dict[str, Added]:
        """Rows of the change feed for one more batch of parts, linked to the last entry of the chain."""
        batches = self.catalog.table(alias, head, "batches")
        prev = self._chain_head(batches)
        links = parts.select(F.lit(bid).alias("bid"), "part_uuid", "content_hash")
        listed = links.agg(F.sort_array(F.collect_list(F.struct("part_uuid", "content_hash"))).alias("parts"))
        entry = listed.select(chain_entry(F.lit(prev), F.lit(bid), F.col("parts"), F.lit(now), self.salt)).first()[0]
        row = self.spark.createDataFrame([(bid, producer, now, fingerprint(schema), prev, entry)], batches.schema)
        return {"batches": Added(row), "batch_parts": Added(links)}

    @staticmethod
    def _chain_head(batches: DataFrame) -> str:
        last = batches.join(batches.select(F.col("prev_hash").alias("entry_hash")), "entry_hash", "left_anti").first()
        return last.entry_hash if last else ""

    @staticmethod
    def _with_totals(subsets: DataFrame, parts: DataFrame) -> DataFrame:
        """total_rows counts all parts that exist, soft-deleted ones included."""
        sums = parts.groupBy("subset_uuid").agg(F.sum("n_rows").alias("_n"))
        return subsets.join(sums, "subset_uuid", "left").withColumn("total_rows", F.coalesce("_n", F.lit(0))).drop("_n").select(subsets.columns)

    def subsets(self, alias: str, head: Snapshot | None = None) -> DataFrame:
        """The subset table with total_rows, which is always counted from the parts and so never drifts."""
        head = head or self.catalog.head(alias)
        return self._with_totals(self.catalog.table(alias, head, "subsets"), self.catalog.table(alias, head, "parts"))

    # ------------------------------------------------------------------ reading

    def meta(self, alias: str, *, subset_start_time=None, subset_end_time=None, exclude_marked_subsets: bool = True, parts_start_time=None, parts_end_time=None, exclude_marked_parts: bool = True, float_tolerance: float | None = None, by_identity: bool = False, **queries) -> Meta:
        """Subsets and parts that match all predicates; lazy tables in a defined order."""
        head = self.catalog.head(alias)
        scales = None
        if by_identity:
            scales = {k: head.schema["quantization"].get(k, 1e3) for k, t in head.schema["key_schema"].items() if t == "REAL"}
        wanted = compile_predicates(head.schema.get("key_schema", {}), queries, float_tolerance, scales) & time_window("created_at_epoch", subset_start_time, subset_end_time)
        subsets = self.subsets(alias, head).filter(wanted)
        parts = self.catalog.table(alias, head, "parts").filter(time_window("created_at_epoch", parts_start_time, parts_end_time))
        subsets = subsets.filter(live()) if exclude_marked_subsets else subsets
        parts = parts.filter(live()) if exclude_marked_parts else parts
        parts = parts.join(subsets.select("subset_uuid"), "subset_uuid", "left_semi")
        rows = P.live_rows(subsets, self.catalog.table(alias, head, "parts"))
        shown = subsets.join(rows, "subset_uuid").withColumn("created_at_utc", iso(F.col("created_at_epoch"))).withColumn("buffer_rows", F.lit(0).cast("long"))
        listed = parts.withColumn("created_at_utc", iso(F.col("created_at_epoch")))
        return Meta(alias, self.catalog.info(alias), head, shown.orderBy("subset_uuid", "created_at_epoch"), listed.orderBy("subset_uuid", "created_at_epoch", "part_uuid"))

    def row_schema(self, snapshot: Snapshot) -> T.StructType:
        fields = field_types(snapshot.schema.get("fields", []))
        meta = {f"{n}_len": T.IntegerType() if depth(fields[n]) == 1 else T.ArrayType(T.IntegerType()) for n in snapshot.schema.get("jagged", [])}
        fields |= {k if isinstance(t, T.IntegerType) else k.removesuffix("_len") + "_shape": t for k, t in meta.items()}
        return T.StructType([T.StructField("subset_uuid", T.StringType()), T.StructField("part_uuid", T.StringType()), T.StructField("row_in_part", T.LongType()), *[T.StructField(k, fields[k]) for k in sorted(fields)]])

    def data(self, meta: Meta, fields: list[str] | None = None, at_least: dict[str, int | tuple[int, ...]] | None = None, ordered: bool = False, enough: int | None = None) -> Data:
        """Rows of a selection. Parts whose statistics rule ``at_least`` lengths out are not opened.

        With ``enough``, any that many matching rows will do: parts are taken in cost order and no more of them than
        surely suffice. The pruned list of parts is the one thing that comes to the driver.
        """
        schema = self.row_schema(meta.snapshot)
        chosen = plan_parts(meta.parts, at_least or {})
        if enough is not None:
            chosen = bounded(chosen, enough)
        folder = self.catalog.folder(meta.alias)
        listed = chosen.select("part_uuid", "file_relpath").collect()
        if listed and not meta.snapshot.schema.get("fields"):
            raise RuntimeError(f"{meta.alias} has parts but no fields")
        above = {r.file_relpath.rpartition("/")[0] for r in listed}  # one listing a batch instead of a question a part
        with ThreadPoolExecutor(16) as pool:
            held = dict(zip(above, pool.map(lambda rel: set(self.files.names(f"{folder}/{rel}")), above)))
        there = [r for r in listed if r.file_relpath.rpartition("/")[2] in held[r.file_relpath.rpartition("/")[0]]]
        missing = [r for r in listed if r.file_relpath.rpartition("/")[2] not in held[r.file_relpath.rpartition("/")[0]]]
        if there:
            rows = self.spark.read.schema(schema).parquet(*[self.files.uri(f"{folder}/{r.file_relpath}") for r in there])
        else:
            rows = self.spark.createDataFrame([], schema)
        rows = residual(rows, at_least or {})
        if ordered:
            rows = rows.join(chosen.select("part_uuid", "created_at_epoch"), "part_uuid").orderBy("subset_uuid", "created_at_epoch", "part_uuid", "row_in_part").select(schema.names)
        if fields:
            rows = rows.select("subset_uuid", "part_uuid", "row_in_part", *fields)
        if enough is not None:
            rows = rows.limit(enough)
        lost = self.spark.createDataFrame([(r.part_uuid,) for r in missing], "part_uuid string")
        read = chosen.join(lost, "part_uuid", "left_anti").select("subset_uuid", "part_uuid", "created_at_epoch", "n_rows")
        return Data(rows, [r.file_relpath for r in missing], meta.subsets, read)

    def peek(self, alias: str, part_uuid: str, fields: list[str] | None = None, rows: int = 64) -> DataFrame:
        """First rows of one part."""
        meta = self.meta(alias, exclude_marked_subsets=False, exclude_marked_parts=False)
        meta.parts = meta.parts.filter(F.col("part_uuid") == part_uuid)
        return self.data(meta, fields).rows.orderBy("row_in_part").limit(rows)

    # ------------------------------------------------------------------ maintenance

    def soft_delete(self, alias: str, queries: dict | None = None, *, start_time=None, end_time=None, mark_parts: bool = True, parts_start_time=None, parts_end_time=None, unmark: bool = False) -> dict[str, int]:
        """Marks (or unmarks) matching subsets and their parts; with a window on parts only those parts change."""
        counts = {"subsets": 0, "parts": 0}

        def build(head: Snapshot):
            window = parts_start_time is not None or parts_end_time is not None
            subsets, parts = self.catalog.table(alias, head, "subsets"), self.catalog.table(alias, head, "parts")
            hit = subsets.filter(compile_predicates(head.schema["key_schema"], queries or {}) & time_window("created_at_epoch", start_time, end_time)).select("subset_uuid")
            tables = {}
            if not window:
                tables["subsets"], counts["subsets"] = self._mark(subsets, hit, F.lit(True), not unmark)
            if mark_parts:
                tables["parts"], counts["parts"] = self._mark(parts, hit, time_window("created_at_epoch", parts_start_time, parts_end_time), not unmark)
            return (head.schema, tables, {"op": "unmark" if unmark else "mark"}) if any(counts.values()) else None

        self.catalog.commit(alias, build)
        return counts

    @staticmethod
    def _mark(df: DataFrame, hit: DataFrame, also, value: bool) -> tuple[DataFrame, int]:
        flagged = df.join(hit.withColumn("_hit", F.lit(True)), "subset_uuid", "left").withColumn("_hit", F.col("_hit").isNotNull() & also)
        changed = flagged.filter(F.col("_hit") & (F.col("marked_for_deletion") != value)).count()
        return flagged.withColumn("marked_for_deletion", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("marked_for_deletion"))).select(df.columns), changed

    def delete(self, alias: str) -> dict[str, int]:
        """Drops marked parts, and marked subsets without parts, from the tables first, then the files."""
        gone: list[str] = []
        counts = {"parts": 0, "subsets": 0, "files": 0}

        def build(head: Snapshot):
            gone.clear()
            subsets, parts = self.catalog.table(alias, head, "subsets"), self.catalog.table(alias, head, "parts")
            gone.extend(r[0] for r in parts.filter("marked_for_deletion").select("file_relpath").toLocalIterator())
            left = parts.filter(live())
            empty = self._with_totals(subsets, left).filter("marked_for_deletion and total_rows = 0").select("subset_uuid")
            counts["subsets"] = empty.count()
            if not gone and not counts["subsets"]:
                return None
            dropped = Added(self._dropped(parts.filter("marked_for_deletion"), self.catalog.now()))
            return head.schema, {"parts": left, "subsets": P.not_present(subsets, empty, ["subset_uuid"]).select(subsets.columns), "dropped": dropped}, {"op": "gc"}

        self.catalog.commit(alias, build)
        counts["parts"] = len(gone)
        counts["files"] = self._unlink(alias, gone)
        self._tell("gc.committed", alias=alias, **counts)
        return counts

    def _unlink(self, alias: str, relpaths: list[str]) -> int:
        """Deletes folders of parts and what is empty above them; how many there were."""
        folder = self.catalog.folder(alias)
        with ThreadPoolExecutor(16) as pool:
            n = sum(pool.map(lambda rel: self.files.delete(f"{folder}/{rel}"), relpaths))
        for above in {rel.rpartition("/")[0] for rel in relpaths}:
            self.files.prune(f"{folder}/{above}", f"{folder}/data")
        return n

    def fsck(self, alias: str, insert_orphans: bool = True) -> dict[str, int]:
        """Compares files with the parts table; can take up unknown files whose subset is known and whose content is new.

        Files of parts that were dropped on purpose are leftovers of a crash: they are counted as garbage and, with
        insert_orphans, deleted. What a part says of itself beside its file fills the columns that its rows don't tell.
        """
        folder = self.catalog.folder(alias)
        head = self.catalog.head(alias)
        files = self.files.scan(f"{folder}/data").filter(F.col("path").contains("/p/p=")).select(F.regexp_extract("path", "/(data/.*)/[^/]*$", 1).alias("file_relpath")).distinct()
        parts, subsets = self.catalog.table(alias, head, "parts"), self.catalog.table(alias, head, "subsets")
        unknown = P.not_present(files, parts, ["file_relpath"])
        dropped = self.catalog.table(alias, head, "dropped").select("file_relpath")
        absent = parts.join(files, "file_relpath", "left_anti")
        report = {"files": files.count(), "parts": parts.count(), "missing_files": absent.count(), "orphans": 0, "inserted": 0, "skipped": 0, "conflicts": 0, "garbage": 0}
        garbage = [r[0] for r in unknown.join(dropped, "file_relpath", "left_semi").toLocalIterator()]
        report["garbage"] = len(garbage)
        paths = [r[0] for r in P.not_present(unknown, dropped, ["file_relpath"]).toLocalIterator()]
        report["orphans"] = len(paths)
        if insert_orphans:
            self._unlink(alias, garbage)
        if not paths:
            return report
        schema = self.row_schema(head)
        rows = self.spark.read.schema(schema).parquet(*[self.files.uri(f"{folder}/{p}") for p in paths])
        hashed = self._rehash(rows, head)
        where = rows.select("part_uuid", F.regexp_extract(F.input_file_name(), "/(data/.*)/[^/]*$", 1).alias("file_relpath")).distinct()
        found = hashed.join(where, "part_uuid")
        known = found.join(subsets.select("subset_uuid"), "subset_uuid", "left_semi")
        fresh = P.not_present(known, parts, ["subset_uuid", "content_hash"])
        report["skipped"] = found.count() - known.count()
        report["conflicts"] = known.count() - fresh.count()
        if insert_orphans and not fresh.isEmpty():
            report["inserted"] = fresh.count()
            headers = self._headers({p.rpartition("/p/")[0] for p in paths}, folder)
            told = headers.select("part_uuid", "producer_id", "batch_id", "scheme_version", "created_at_epoch").dropDuplicates(["part_uuid"])
            fresh = fresh.join(told, "part_uuid", "left").fillna({"scheme_version": 1, "created_at_epoch": self.catalog.now()})

            def build(now_head: Snapshot):
                held = self.catalog.table(alias, now_head, "parts")
                blank = {c: F.lit(None).cast(held.schema[c].dataType) for c in held.columns if c not in fresh.columns}
                added = P.not_present(fresh, held, ["part_uuid"]).withColumns(blank | {"marked_for_deletion": F.lit(False), "enc_version": F.lit(0)}).select(held.columns)
                return now_head.schema, {"parts": Added(added)}, {"op": "fsck"}

            self.catalog.commit(alias, build)
        return report

    def _headers(self, targets: set[str], folder: str) -> DataFrame:
        """What parts say of themselves, of the folders that have it."""
        schema = "part_uuid string, subset_uuid string, content_hash string, n_rows long, part_stats_json string, dataset_uuid string, scheme_version long, producer_id string, batch_id string, created_at_epoch long"
        there = [f"{folder}/{t}/header" for t in sorted(targets) if self.files.exists(f"{folder}/{t}/header")]
        return self.spark.read.schema(schema).parquet(*map(self.files.uri, there)) if there else self.spark.createDataFrame([], schema)

    def register_existing(self, alias: str, uri: str) -> dict[str, int]:
        """Takes up parts that another store sealed, by a copy of their files; content that is there already is left out.

        Their subsets have to be known here. Registering twice changes nothing.
        """
        head, folder = self.catalog.head(alias), self.catalog.folder(alias)
        rows = self.spark.read.schema(self.row_schema(head)).option("recursiveFileLookup", True).parquet(uri).filter("row_in_part is not null")
        fresh = P.not_present(rows, self.catalog.table(alias, head, "parts"), ["part_uuid"])
        target = f"{folder}/data/registered-{uuid.uuid4().hex}"
        self._write_parts(alias, head.schema, fresh, self._rehash(fresh, head), target)
        report = self.fsck(alias)
        if not report["inserted"]:
            self.files.delete(target)
        return {k: report[k] for k in ("inserted", "skipped", "conflicts")}

    def compact(self, alias: str, tries: int = 3) -> dict[str, int]:
        """Joins short live parts of a subset into full ones, as streams and small batches leave them.

        One commit adds the new parts and drops the old ones, so no reader sees rows twice or not at all; files of the old
        ones go afterwards. If another writer marks or drops one of them meanwhile, the work starts again.
        """
        for left in reversed(range(tries)):
            try:
                return self._compact(alias)
            except CommitConflict:
                if not left:
                    raise
        return {}

    def _compact(self, alias: str) -> dict[str, int]:
        head = self.catalog.head(alias)
        parts = self.catalog.table(alias, head, "parts").filter(live()).filter(F.col("n_rows") < head.schema["part_config"]["part_rows"])
        several = parts.groupBy("subset_uuid").agg(F.count("*").alias("n")).filter("n > 1").select("subset_uuid")
        short = parts.join(several, "subset_uuid", "left_semi")
        if short.isEmpty():
            return {"before": 0, "after": 0}
        stored, keys = field_types(head.schema["fields"]), list(head.schema["key_schema"])
        bid = f"compact-{uuid.uuid4().hex}"
        staging = f"{self.catalog.folder(alias)}/data/{bid}"
        old = self._save(short.select("part_uuid", "subset_uuid", "created_at_epoch", "n_rows", "file_relpath", "part_stats_json"), f"{staging}/_old")
        subsets = self.catalog.table(alias, head, "subsets")
        data = self.data(Meta(alias, {}, head, subsets, old))
        if data.missing:
            raise FileNotFoundError(f"{alias} lacks {data.missing[:3]}")
        rows = data.rows.join(old.select("part_uuid", F.col("created_at_epoch").alias("_o1")), "part_uuid").join(subsets.select("subset_uuid", *keys), "subset_uuid")
        rows = rows.select(*keys, *sorted(stored), "_o1", F.col("part_uuid").alias("_o2"), F.col("row_in_part").alias("_o3"))
        schema, numbered, sealed = self._seal(rows, head.schema, stored, [], staging, ("_o1", "_o2", "_o3"))
        counts = {"before": old.count(), "after": sealed.count()}
        paths = [r[0] for r in P.not_present(old, sealed, ["part_uuid"]).select("file_relpath").toLocalIterator()]
        self._commit_parts(alias, schema, numbered, sealed, bid, staging, old.select("part_uuid"))
        self._unlink(alias, paths)
        self._tell("compact.committed", alias=alias, **counts)
        return counts

    # ------------------------------------------------------------------ change feed and merge

    def tail_batches(self, alias: str, n: int = 20) -> DataFrame:
        return self.catalog.table(alias, self.catalog.head(alias), "batches").orderBy(F.desc("created_at"), F.desc("bid")).limit(n)

    def show_batch(self, alias: str, bid: str) -> DataFrame:
        """Parts of a batch with their subsets."""
        head = self.catalog.head(alias)
        links = self.catalog.table(alias, head, "batch_parts").filter(F.col("bid") == bid)
        return links.drop("content_hash").join(self.catalog.table(alias, head, "parts"), "part_uuid").join(self.catalog.table(alias, head, "subsets").drop("created_at_epoch", "marked_for_deletion"), "subset_uuid")

    def merge_from(self, alias: str, source: Store, source_alias: str | None = None, verify_hash: bool = False, dry_run: bool = False) -> MergeReport:
        """Takes over the batches of another store that were not merged yet, live parts only, in one commit; twice is once."""
        source_alias = source_alias or alias
        theirs = source.catalog.head(source_alias)
        self.catalog.ensure_dataset(alias)
        mine = self.catalog.head(alias)
        if mine.schema and fingerprint(mine.schema) != fingerprint(theirs.schema):
            raise IdentityConflict("the schemas, their quantization or encryption differ")
        todo = P.unmerged(source.catalog.table(source_alias, theirs, "batches"), self.catalog.table(alias, mine, "merge_log"))
        todo = todo.join(self.catalog.table(alias, mine, "batches").select("producer_id", "bid"), ["producer_id", "bid"], "left_anti").orderBy("created_at", "bid")
        self._tell("merge.begin", alias=alias)
        batches = todo.collect()  # one row per batch since the last merge
        links = source.catalog.table(source_alias, theirs, "batch_parts").join(todo.select("bid"), "bid", "left_semi")
        wanted = source.catalog.table(source_alias, theirs, "parts").filter(live()).join(links.select("part_uuid").distinct(), "part_uuid", "left_semi")
        fresh = P.not_present(wanted, self.catalog.table(alias, mine, "parts"), ["subset_uuid", "content_hash"])
        total, new = wanted.count(), fresh.count()
        report = MergeReport([b.bid for b in batches], new, total - new, dry_run)
        if dry_run or not batches:
            return report
        staging = f"{self.catalog.folder(alias)}/data/merge-{uuid.uuid4().hex}"
        written: list[tuple[DataFrame, str]] = []

        def copy(parts: DataFrame) -> None:
            target = f"{staging}/w{len(written)}"
            chosen = self._save(parts, f"{staging}/_new{len(written)}")
            data = source.data(Meta(source_alias, {}, theirs, source.catalog.table(source_alias, theirs, "subsets"), chosen))
            if data.missing:
                raise FileNotFoundError(f"the source lacks {data.missing[:3]}")
            self._write_parts(alias, theirs.schema, data.rows, chosen, target)
            if verify_hash and not chosen.isEmpty():
                told = chosen.select("part_uuid", F.col("content_hash").alias("told"))
                there = self.spark.read.schema(self.row_schema(theirs)).option("recursiveFileLookup", True).parquet(self.files.uri(f"{target}/p"))
                if not self._rehash(there, theirs).join(told, "part_uuid").filter("told <> content_hash").isEmpty():
                    raise IdentityConflict("content differs from its hash")
            written.append((chosen, target))

        copy(fresh)
        self._tell("merge.parts_copied", alias=alias, parts=new)

        def build(head: Snapshot):
            held, subsets = self.catalog.table(alias, head, "parts"), self.catalog.table(alias, Snapshot(head.version, theirs.schema, head.paths), "subsets")
            absent = P.not_present(wanted, held, ["subset_uuid", "content_hash"])
            for chosen, _ in written:
                absent = P.not_present(absent, chosen, ["part_uuid"])
            if not absent.isEmpty():  # parts that were here at first and have been collected since
                copy(absent)
            added = None
            for chosen, target in written:
                rows = P.not_present(chosen, held, ["subset_uuid", "content_hash"]).withColumn("file_relpath", F.concat(F.lit(f"{target.split('/', 2)[2]}/p/p="), F.col("part_uuid"))).select(held.columns)
                added = rows if added is None else added.unionByName(rows)
            marked = held.filter("marked_for_deletion").join(wanted, ["subset_uuid", "content_hash"], "left_semi").select("part_uuid")
            parts = Added(added) if marked.isEmpty() else self._unmarked(held, marked, "part_uuid").unionByName(added)
            known = source.catalog.table(source_alias, theirs, "subsets").join(wanted.select("subset_uuid").distinct(), "subset_uuid", "left_semi")
            now = self.catalog.now()
            again = subsets.filter("marked_for_deletion").join(known, "subset_uuid", "left_semi").select("subset_uuid")
            mine = P.not_present(known, subsets, ["subset_uuid"]).select(subsets.columns)
            log = self.catalog.table(alias, head, "merge_log")
            tables = {"parts": parts, "subsets": Added(mine) if again.isEmpty() else self._unmarked(subsets, again, "subset_uuid").unionByName(mine), "merge_log": Added(self.spark.createDataFrame([(b.producer_id, b.bid, now) for b in batches], log.schema))}
            tables |= self._batch_tables(alias, head, theirs.schema, self.producer_id, f"merge-{uuid.uuid4().hex}", wanted, now)
            ours = head.schema.get("canonical", {})
            canonical = {n: [max(a, b) for a, b in zip(x, ours.get(n, x))] for n, x in theirs.schema.get("canonical", {}).items()}
            return theirs.schema | {"canonical": ours | canonical}, tables, {"op": "merge", "batches": len(batches)}

        self.catalog.commit(alias, build)
        self._tell("merge.committed", batches=len(batches))
        return report

    def _rehash(self, rows: DataFrame, head: Snapshot) -> DataFrame:
        return rows.groupBy("subset_uuid", "part_uuid").applyInArrow(_hash_part(field_types(head.schema["fields"]), head.schema, "part_uuid"), _HASHED.replace("part_ordinal long", "part_uuid string"))

    def verify_content(self, alias: str, fraction: float = 1.0, seed: int = 0) -> DataFrame:
        """Parts, or a random share of them, whose content no longer matches its hash."""
        meta = self.meta(alias, exclude_marked_subsets=False)
        if fraction < 1:
            meta.parts = meta.parts.sample(fraction=fraction, seed=seed)
        rows = self.data(meta).rows
        return self._rehash(rows, meta.snapshot).join(meta.parts.select("part_uuid", F.col("content_hash").alias("told")), "part_uuid").filter("told <> content_hash").select("part_uuid", "told", "content_hash")

    def verify_chain(self, alias: str) -> list[str]:
        """Batch ids whose entry does not follow from the entry before and the parts named; empty for an intact chain.

        Entries are computed anew by a join; a batch is also broken if nothing, or a batch before it, has the entry it
        builds on. Only ids of broken batches come to the driver.
        """
        head = self.catalog.head(alias)
        batches = self.catalog.table(alias, head, "batches")
        listed = self.catalog.table(alias, head, "batch_parts").groupBy("bid").agg(F.sort_array(F.collect_list(F.struct("part_uuid", "content_hash"))).alias("parts"))
        rows = batches.join(listed, "bid", "left")
        entry = chain_entry(F.col("prev_hash"), F.col("bid"), F.col("parts"), F.col("created_at"), self.salt)
        edited = rows.filter(entry != F.col("entry_hash")).select("bid")
        loose = batches.filter("prev_hash <> ''").join(batches.select(F.col("entry_hash").alias("prev_hash")), "prev_hash", "left_anti").select("bid")
        forks = batches.groupBy("prev_hash").agg(F.count("*").alias("n")).filter("n > 1").select("prev_hash")
        forked = batches.join(forks, "prev_hash", "left_semi").select("bid")
        return sorted(r.bid for r in edited.union(loose).union(forked).distinct().collect())

    def rebuild(self, alias: str, target: str, order: list[str], quantization: dict[str, float] | None = None, canonical: dict[str, list[int]] | None = None) -> Snapshot:
        """A copy under other quantization or other canonical extents: rows are read, identified anew and sealed under another alias."""
        meta = self.meta(alias)
        schema = meta.snapshot.schema
        keys = list(schema["key_schema"])
        fields = [f["name"] for f in schema["fields"]]
        rows = self.data(meta).rows.join(meta.subsets.select("subset_uuid", *keys), "subset_uuid").select(*keys, *fields)
        extents = schema.get("canonical", {}) | (canonical or {})
        return self.append(target, rows, keys, order, schema["part_config"]["part_rows"], schema["quantization"] | (quantization or {}), extents or schema["jagged"])

    def optimize(self, alias: str) -> dict[str, int]:
        """Writes every table anew in few files, and gathers counts by which a planner may judge them."""

        def build(head: Snapshot):
            tables = {name: self.catalog.table(alias, head, name) for name, paths in head.paths.items() if len(paths) > 1}
            return (head.schema, tables, {"op": "optimize"}) if tables else None

        head = self.catalog.commit(alias, build)
        return {name: self.catalog.table(alias, head, name).count() for name in sorted(head.paths)}

    # ------------------------------------------------------------------ navigation

    def list_nodes(self) -> DataFrame:
        return self.spark.createDataFrame([(a, self.catalog.info(a)["dataset_uuid"], self.catalog.head(a).version) for a in self.catalog.aliases()], "alias string, dataset_uuid string, version long")

    def list_subsets(self, alias: str, after: str | None = None, size: int = 100) -> DataFrame:
        subsets = self.subsets(alias)
        return (subsets if after is None else subsets.filter(F.col("subset_uuid") > after)).orderBy("subset_uuid").limit(size)

    def list_parts(self, alias: str, subset_uuid: str, after: str | None = None, size: int = 100) -> DataFrame:
        parts = self.catalog.table(alias, self.catalog.head(alias), "parts").filter(F.col("subset_uuid") == subset_uuid)
        return (parts if after is None else parts.filter(F.col("part_uuid") > after)).orderBy("part_uuid").limit(size)

    def search(self, alias: str, text: str, after: str | None = None, size: int = 100) -> DataFrame:
        """Subsets with a key whose text contains the given one, whatever its case."""
        subsets = self.subsets(alias)
        keys = self.catalog.head(alias).schema["key_schema"]
        wanted = F.lit(False)
        for k in keys:
            wanted |= F.contains(F.lower(F.col(k).cast("string")), F.lit(text.lower()))
        found = subsets.filter(F.coalesce(wanted, F.lit(False)))
        return (found if after is None else found.filter(F.col("subset_uuid") > after)).orderBy("subset_uuid").limit(size)

    def statistics(self, alias: str) -> DataFrame:
        """Rows, parts and subsets that are live or marked, and folders of each table: what an operator looks at first."""
        head = self.catalog.head(alias)
        parts, subsets = self.catalog.table(alias, head, "parts"), self.catalog.table(alias, head, "subsets")
        rows = parts.groupBy("marked_for_deletion").agg(F.count("*").alias("parts"), F.sum("n_rows").alias("rows"))
        counted = subsets.groupBy("marked_for_deletion").agg(F.count("*").alias("subsets"))
        return rows.join(counted, "marked_for_deletion", "full").fillna(0, ["parts", "rows", "subsets"])

    def audit(self, alias: str) -> dict:
        """What an auditor asks for: version, counts, state of chain and files."""
        report = self.fsck(alias, insert_orphans=False)
        head = self.catalog.head(alias)
        return report | {"version": head.version, "commits": len(self.catalog.commits(alias)), "chain_head": self._chain_head(self.catalog.table(alias, head, "batches")), "broken_batches": self.verify_chain(alias)}


def _within(longest: dict[str, list[int]], canonical: dict[str, list[int]]) -> dict[str, list[int]]:
    """Canonical extents with those of new fields; longer values than the canonical ones are an error."""
    for name, extents in longest.items():
        if any(x > c for x, c in zip(extents, canonical.get(name, extents))):
            raise DataExceedsCanon(f"{name}: {extents} is longer than the canonical {canonical[name]}")
    return {n: list(x) for n, x in longest.items()} | {n: list(x) for n, x in canonical.items()}


def _hash_part(stored: dict[str, T.DataType], schema: dict, second: str = "part_ordinal"):
    """For applyInArrow: content hash, rows and statistics of the jagged fields of one part."""
    dims = {n: depth(stored[n]) for n in schema["jagged"]}
    canonical = schema.get("canonical", {})

    def of_lengths(lens: list[int], full: int | None) -> dict:
        distinct = len(set(lens))
        coded = "constant" if distinct == 1 else "codebook" if distinct <= min(CODEBOOK_LENGTHS, CODEBOOK_SHARE * len(lens)) else "plain"
        out = {"min_len": min(lens), "max_len": max(lens), "avg_len": sum(lens) / len(lens), "len_encoding": coded, "width": "uint16" if max(lens) <= 65535 else "uint32"}
        return out | ({"codebook_K": distinct} if coded == "codebook" else {}) | ({"full_rows": sum(x == full for x in lens)} if full is not None else {})

    def run(key, rows):
        rows = rows.sort_by("row_in_part")
        stats = {}
        for name, n in dims.items():
            full = canonical.get(name)
            if n == 1:
                stats[name] = of_lengths(rows.column(f"{name}_len").to_pylist(), full[0] if full else None)
            else:
                extents = list(zip(*rows.column(f"{name}_shape").to_pylist()))
                stats[name] = {"dims": [{"min": min(x), "max": max(x), "avg": sum(x) / len(x)} for x in extents], "full_rows": sum(list(x) == list(full) for x in zip(*extents)) if full else None}
        return pa.table({"subset_uuid": [key[0].as_py()], second: pa.array([key[1].as_py()], pa.int64() if second == "part_ordinal" else pa.string()), "content_hash": [content_hash(rows, stored)], "n_rows": pa.array([rows.num_rows], pa.int64()), "part_stats_json": [json.dumps(stats, sort_keys=True)]})

    return run
