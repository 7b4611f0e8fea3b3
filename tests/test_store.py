"""Life of a dataset: sealing, replay, deletion, reconciliation, merge, chain, streams."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloft.errors import DataExceedsCanon, IdentityConflict, InvalidKeyValue, SchemaMismatch
from keyloft.operators import graph
from keyloft.sources.files import Files
from keyloft.sources.jsonstate import load_json, nodes
from keyloft.sources.store import Store
from keyloft.streaming.ingest import ingest, stream_into

KEYS, ORDER = ["site", "temp"], ["seq"]


def rows(spark, n=25, site="a", start=0):
    return spark.range(start, start + n).select(F.lit(site).alias("site"), (F.col("id") % 2).cast("double").alias("temp"), F.col("id").alias("seq"), (F.col("id") * 1.5).alias("v"), F.slice(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 1, (F.col("id") % 4).cast("int")).alias("jag"))


def store(spark, tmp_path, name="a", **more):
    return Store(spark, f"file://{tmp_path}/{name}", **more)


def part_ids(s, alias="d"):
    return {r.part_uuid for r in s.meta(alias).parts.collect()}


def test_append_read_prune_and_replay(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER, part_rows=5, jagged=["jag"], bid="b1")
    meta = s.meta("d")
    assert [(r.temp, r.total_rows) for r in meta.subsets.sort("temp").collect()] == [(0.0, 13), (1.0, 12)]
    assert sorted(r.n_rows for r in meta.parts.collect()) == [2, 3, 5, 5, 5, 5]
    data = s.data(meta, ordered=True)
    assert data.missing == [] and data.rows.count() == 25
    assert data.bounds.agg(F.max("row_end")).first()[0] == 25
    for r in data.rows.groupBy("part_uuid").agg(F.sort_array(F.collect_list(F.struct("row_in_part", "seq"))).alias("x")).collect():
        assert [x.seq for x in r.x] == sorted(x.seq for x in r.x)
    long = s.data(meta, at_least={"jag": 3})
    assert {r.seq for r in long.rows.collect()} == {i for i in range(25) if i % 4 == 3}
    before = part_ids(s)
    assert s.append("d", rows(spark), KEYS, ORDER, bid="b1").version == meta.snapshot.version  # replay of a batch
    s.append("d", rows(spark).repartition(3), KEYS, ORDER, bid="b2")  # same content under another batch
    assert part_ids(s) == before and s.data(s.meta("d")).rows.count() == 25
    assert s.verify_chain("d") == [] and s.verify_content("d").count() == 0


def test_queries_and_times(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark).unionByName(rows(spark, site="b").withColumn("temp", F.lit(float("nan")))), KEYS, ORDER)
    count = lambda **q: s.meta("d", **q).subsets.count()
    assert (count(), count(site="b"), count(temp=float("nan")), count(temp=(1, 0)), count(temp=1.0000001, by_identity=True)) == (3, 1, 1, 2, 1)
    assert count(subset_end_time="2001-01-01") == 0 and s.meta("d", parts_start_time="2001-01-01").parts.count() == 3
    with pytest.raises(ValueError):
        s.meta("d", nothing=1)
    with pytest.raises(ValueError):
        s.meta("unknown")


def test_schema_is_locked(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER)
    with pytest.raises(SchemaMismatch):
        s.append("d", rows(spark).withColumn("w", F.lit(1)), KEYS, ORDER)
    with pytest.raises(SchemaMismatch):
        s.append("d", rows(spark).withColumn("seq", F.col("seq").cast("double")), KEYS, ORDER)
    s.append("d", rows(spark, start=100).withColumn("v", F.col("seq")), KEYS, ORDER)  # long widens to double
    with pytest.raises(ValueError):
        s.append("e", rows(spark).withColumnRenamed("site", "total_rows"), ["total_rows"], ORDER)


def test_soft_delete_gc_revive_and_fsck(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER, part_rows=10)
    assert s.soft_delete("d", {"temp": 1.0}) == {"subsets": 1, "parts": 2}
    assert s.data(s.meta("d")).rows.count() == 13
    s.append("d", rows(spark), KEYS, ORDER)  # the same content again revives what was marked
    assert s.data(s.meta("d")).rows.count() == 25
    s.soft_delete("d", {"temp": 1.0})
    assert s.delete("d") == {"parts": 2, "subsets": 1, "files": 2}
    assert s.delete("d") == {"parts": 0, "subsets": 0, "files": 0}
    assert s.verify_chain("d") == []
    gone = s.meta("d").parts.first()
    s.files.delete(f"{s.catalog.folder('d')}/{gone.file_relpath}")
    assert s.data(s.meta("d")).missing == [gone.file_relpath]
    report = s.fsck("d")
    assert report["missing_files"] == 1 and report["orphans"] == 0


def test_fsck_takes_up_orphans(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER, part_rows=10)
    lost = s.meta("d").parts.first()

    def forget(head):
        parts = s.catalog.table("d", head, "parts")
        return head.schema, {"parts": parts.filter(F.col("part_uuid") != lost.part_uuid)}, {"op": "test"}

    s.catalog.commit("d", forget)
    assert s.fsck("d", insert_orphans=False)["orphans"] == 1
    assert s.fsck("d")["inserted"] == 1
    assert s.meta("d").parts.filter(F.col("part_uuid") == lost.part_uuid).first().content_hash == lost.content_hash


def test_merge_twice_is_once(spark, tmp_path):
    a, b = store(spark, tmp_path, "a", producer_id="a"), store(spark, tmp_path, "b", producer_id="b")
    a.append("d", rows(spark), KEYS, ORDER, part_rows=10, bid="same")
    b.append("d", rows(spark, site="b"), KEYS, ORDER, part_rows=10, bid="same")
    plan = b.merge_from("d", a, dry_run=True)
    assert plan.dry_run and plan.new_parts == 4 and b.data(b.meta("d")).rows.count() == 25
    assert b.merge_from("d", a, verify_hash=True).new_parts == 4
    assert b.merge_from("d", a).batches == []
    assert b.data(b.meta("d")).rows.count() == 50 and b.verify_chain("d") == []
    a.append("e", rows(spark), KEYS, ORDER, quantization={"temp": 10})
    b.append("e", rows(spark), KEYS, ORDER, quantization={"temp": 100})
    with pytest.raises(IdentityConflict):
        b.merge_from("e", a)


def test_tampering_shows(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in range(3):
        s.append("d", rows(spark, start=100 * k), KEYS, ORDER, bid=f"b{k}")

    def edit(head):
        batches = s.catalog.table("d", head, "batches")
        return head.schema, {"batches": batches.withColumn("created_at", F.when(F.col("bid") == "b1", 1).otherwise(F.col("created_at")))}, {"op": "test"}

    s.catalog.commit("d", edit)
    assert s.verify_chain("d") == ["b1"]


def test_a_lost_race_is_built_again(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER)
    calls = []

    def build(head):
        calls.append(head.version)
        if len(calls) == 1:
            s.catalog.commit("d", lambda h: (h.schema, {}, {"op": "other"}))
        return head.schema, {}, {"op": "mine"}

    s.catalog.commit("d", build)
    assert len(calls) == 2 and [c["note"]["op"] for c in s.catalog.commits("d")][-2:] == ["other", "mine"]


def test_views_peek_rebuild_vacuum(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER, part_rows=10, bid="b")
    part = s.meta("d").parts.orderBy(F.desc("n_rows")).first()
    assert s.peek("d", part.part_uuid, ["seq"], 3).count() == 3
    assert s.list_nodes().count() == 1 and s.list_subsets("d").count() == 2
    assert s.list_parts("d", part.subset_uuid).count() == 2 and s.show_batch("d", "b").count() == 4
    assert s.tail_batches("d").count() == 1
    s.rebuild("d", "coarse", ORDER, {"temp": 0.1})
    assert s.meta("coarse").subsets.count() == 1 and s.data(s.meta("coarse")).rows.count() == 25
    s.catalog.vacuum("d", 0)
    assert s.data(s.meta("d")).rows.count() == 25 and s.audit("d")["missing_files"] == 0


def test_stream_and_compaction(spark, tmp_path):
    s = store(spark, tmp_path)
    source = f"{tmp_path}/in"
    for k in range(3):
        rows(spark, 10, start=10 * k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows(spark).schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_into(s, "d", stream, KEYS, ORDER, f"{tmp_path}/check", part_rows=8).awaitTermination()
    assert s.data(s.meta("d")).rows.count() == 30
    stream_into(s, "d", stream, KEYS, ORDER, f"{tmp_path}/check2", part_rows=8).awaitTermination()  # epochs again
    assert s.data(s.meta("d")).rows.count() == 30
    counts = s.compact("d")
    assert counts["after"] < counts["before"]
    assert s.data(s.meta("d")).rows.count() == 30 and sorted(r.n_rows for r in s.meta("d").parts.collect()) == [7, 7, 8, 8]


def test_ingest_of_worker_results(spark, tmp_path):
    s = store(spark, tmp_path)

    def worker(k, n):
        if n < 0:
            raise RuntimeError("no")
        return pd.DataFrame({"site": f"s{k}", "seq": range(n), "v": 0.5})

    tasks = spark.createDataFrame([(1, 3), (2, 4), (3, -1)], "k int, n int")
    report = ingest(s, "d", tasks, worker, "site string, seq long, v double", ["site"], ["seq"], raise_on_error=False)
    assert report == {"tasks": 3, "rows": 7, "errors": 1}
    assert s.meta("d", site="s2").subsets.first().total_rows == 4


def test_paths_stay_inside(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/x")
    for bad in ("/etc/x", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            files.exists(bad)
    assert files.create("a/b.json", "{}") and not files.create("a/b.json", "[]")
    assert load_json(files, "a/b.json", None) == {} and load_json(files, "none.json", 3) == 3
    files.create("bad.json", "{")
    assert load_json(files, "bad.json", []) == [] and nodes(spark, files, "none.json").count() == 0


def test_call_graph_checks(spark):
    ns = spark.createDataFrame([("m.f", "function", True, "m.py", 1, 2), ("m.C.__init__", "method", True, "m.py", 3, 4), ("m.g", "function", True, "m.py", 5, 6)], "fqid string, kind string, has_body boolean, source_path string, source_start long, source_end long")
    es = spark.createDataFrame([("m.f", "m.C"), ("m.f", "x"), ("y", "m.f"), ("m.g", "m.g")], "src string, dst string")
    assert {(r.src, r.reason) for r in graph.bad_calls(es, ns).collect()} == {("m.f", "unknown target"), ("y", "unknown source"), ("m.g", "calls itself")}
    assert {r.fqid for r in graph.without_calls(ns, es).collect()} == {"m.C.__init__"}
    delta = spark.createDataFrame([("m.h", "function", True, "m.py", 1, 2)], ns.schema)
    assert [r.fqid for r in graph.merge_nodes(ns, delta).collect()] == ["m.h"]
    mods = spark.createDataFrame([("a", "pending"), ("b", "done")], "path string, status string")
    ups = spark.createDataFrame([("a", "done"), ("b", "pending"), ("c", "pending")], "path string, status string")
    order = ["pending", "done"]
    assert {(r.path, r.status) for r in graph.advance_status(mods, ups, order).collect()} == {("a", "done"), ("b", "done"), ("c", "pending")}
    assert ("b", "pending") in {(r.path, r.status) for r in graph.advance_status(mods, ups, order, force=True).collect()}


def test_no_reader_sees_compacted_rows_twice(spark, tmp_path):
    """A reader looks at the store whenever anything is told, the time between any two commits included."""
    s = store(spark, tmp_path)
    for k in range(3):
        s.append("d", rows(spark, 4, start=10 * k), KEYS, ORDER, part_rows=8)
    seen, versions = [], s.catalog.head("d").version
    other = Store(spark, s.files.root)
    s.hooks.append(lambda event, what: seen.append((event, other.meta("d").subsets.agg(F.sum("live_rows")).first()[0])))
    assert s.compact("d") == {"before": 6, "after": 2}
    assert {n for _, n in seen} == {12} and "compact.committed" in {e for e, _ in seen}
    assert s.catalog.head("d").version == versions + 1  # one commit
    assert s.data(s.meta("d")).rows.count() == 12 and s.verify_chain("d") == []
    assert s.soft_delete("d", unmark=True) == {"subsets": 0, "parts": 0}  # what was joined does not come back
    report = s.fsck("d")
    assert (report["missing_files"], report["orphans"], report["garbage"]) == (0, 0, 0)


def test_compaction_starts_again_after_a_deletion(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in range(2):
        s.append("d", rows(spark, 4, start=10 * k), KEYS, ORDER, part_rows=8)
    other, done = Store(spark, s.files.root), []

    def interfere(event, what):
        if event == "ingest.parts_written" and not done:
            done.append(other.soft_delete("d", {"temp": 0.0}))

    s.hooks.append(interfere)
    s.compact("d")
    assert s.data(s.meta("d")).rows.count() == 4 and s.data(s.meta("d", exclude_marked_subsets=False, exclude_marked_parts=False)).rows.count() == 8


def test_append_survives_garbage_collection_of_the_same_content(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER, part_rows=10)
    s.soft_delete("d")
    other = Store(spark, s.files.root)
    s.hooks.append(lambda event, what: other.delete("d") if event == "ingest.parts_written" else None)
    s.append("d", rows(spark), KEYS, ORDER, part_rows=10)
    data = s.data(s.meta("d"))
    assert data.missing == [] and data.rows.count() == 25 and s.verify_content("d").count() == 0


def test_merge_survives_garbage_collection_of_the_same_content(spark, tmp_path):
    a, b = store(spark, tmp_path, "a", producer_id="a"), store(spark, tmp_path, "b", producer_id="b")
    a.append("d", rows(spark), KEYS, ORDER, part_rows=10)
    b.append("d", rows(spark), KEYS, ORDER, part_rows=10)
    b.soft_delete("d")
    other = Store(spark, b.files.root)
    b.hooks.append(lambda event, what: other.delete("d") if event == "merge.parts_copied" else None)
    b.merge_from("d", a)
    data = b.data(b.meta("d"))
    assert data.missing == [] and data.rows.count() == 25


def test_leftover_files_of_dropped_parts_are_garbage(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER, part_rows=10)
    s.soft_delete("d", {"temp": 1.0})
    unlink, s._unlink = s._unlink, lambda alias, paths: 0  # a crash between the commit and the files
    s.delete("d")
    s._unlink = unlink
    assert s.fsck("d", insert_orphans=False)["garbage"] == 2
    report = s.fsck("d")
    assert (report["garbage"], report["inserted"]) == (2, 0) and s.fsck("d")["garbage"] == 0
    s.append("d", rows(spark), KEYS, ORDER)
    assert s.data(s.meta("d")).rows.count() == 25


def test_errors_of_rows_have_names(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER, jagged=["jag"])
    with pytest.raises(InvalidKeyValue, match="key site is null"):
        s.append("d", rows(spark).withColumn("site", F.lit(None).cast("string")), KEYS, ORDER)
    with pytest.raises(InvalidKeyValue, match="too large"):
        s.append("d", rows(spark).withColumn("temp", F.lit(1e30)), KEYS, ORDER)
    with pytest.raises(SchemaMismatch, match="field seq"):
        s.append("d", rows(spark).withColumn("seq", F.lit(None).cast("long")), KEYS, ORDER)
    with pytest.raises(DataExceedsCanon, match="jag"):
        s.append("d", rows(spark).withColumn("jag", F.array_repeat(F.lit(1.0), 4)), KEYS, ORDER)
    assert s.data(s.meta("d")).rows.count() == 25
    s.rebuild("d", "wide", ORDER, canonical={"jag": [9]})
    s.append("wide", rows(spark, start=100).withColumn("jag", F.array_repeat(F.lit(1.0), 9)), KEYS, ORDER)
    assert s.data(s.meta("wide"), at_least={"jag": 4}).rows.count() == 25


def test_deltas_are_gathered_and_events_told(spark, tmp_path, monkeypatch):
    from keyloft.sources import catalog

    monkeypatch.setattr(catalog, "MAX_FOLDERS", 2)
    s, told = store(spark, tmp_path), []
    s.hooks.append(lambda event, what: told.append(event))
    for k in range(4):
        s.append("d", rows(spark, 2, start=10 * k), KEYS, ORDER)
    head = s.catalog.head("d")
    assert max(len(p) for p in head.paths.values()) <= 2 and s.tail_batches("d").count() == 4 and s.meta("d").parts.count() == 8
    assert {"ingest.begin", "ingest.parts_hashed", "ingest.parts_written", "commit.begin", "commit.done", "batch.committed"} <= set(told)
    counts = s.optimize("d")
    assert counts["parts"] == 8 and {len(p) for p in s.catalog.head("d").paths.values()} == {1}
    assert s.data(s.meta("d")).rows.count() == 8 and {r.marked_for_deletion: (r.rows, r.parts, r.subsets) for r in s.statistics("d").collect()} == {False: (8, 8, 2)}
