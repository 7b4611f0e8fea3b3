"""Staging with claims, encryption of part files, registration of foreign parts, commands."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyloft.cli import run
from keyloft.functions import jagged
from keyloft.sources.crypto import LocalKeys, decrypt_parts, encrypt_parts, reencrypt_parts
from keyloft.streaming.metrics import snapshot
from keyloft.streaming.staging import Staging
from tests.test_store import KEYS, ORDER, rows, store


def test_claims_and_crash_between_claim_and_seal(spark, tmp_path):
    s = store(spark, tmp_path)
    staging = Staging(s, "d", KEYS, ORDER)
    for k in range(3):
        staging.enqueue(rows(spark, 10, start=10 * k))
    assert snapshot(staging.table()) == {"subsets": 2, "rows": 30, "payloads": 6, "claimed_rows": 0, "streams": {}}
    assert staging.claim("w1", 10).count() == 4  # two payloads of five rows per subset
    staging.unclaim("w1")
    assert staging.table().filter("claimed_by is not null").count() == 0
    staging.claim("w2", 10)
    staging.reclaim_stale(3600)
    assert staging.table().filter("claimed_by = 'w2'").count() == 4
    staging.reclaim_stale(0)  # the writer is gone
    assert staging.table().filter("claimed_by is not null").count() == 0
    assert staging.drain("w3", 10) == 6
    assert s.data(s.meta("d")).rows.count() == 30 and staging.table().count() == 0
    assert sorted(r.n_rows for r in s.meta("d").parts.collect()) == [5, 5, 10, 10]


def test_encrypted_files_open_only_in_place(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER, part_rows=10)
    meta, keys = s.meta("d"), LocalKeys()
    ref = keys.generate_data_key()
    sealed = encrypt_parts(s, meta, keys, ref)
    plain = {r.part_uuid: bytes(r.content) for r in decrypt_parts(s, meta, sealed, keys, ref).collect()}
    assert len(plain) == 4 and all(x.startswith(b"PAR1") for x in plain.values())
    for r in sealed.collect():
        assert r.plaintext_size == len(plain[r.part_uuid]) and bytes(r.payload).endswith(bytes(r.tag))
    with pytest.raises(PySparkException):
        decrypt_parts(s, meta, sealed.withColumn("part_uuid", F.lit("other")), keys, ref).collect()
    key = keys.get_key(ref)
    for shown in (sealed._jdf.queryExecution().toString(), decrypt_parts(s, meta, sealed, keys, ref)._jdf.queryExecution().toString()):
        assert key.hex() not in shown.lower() and str(list(key))[1:20] not in shown
    new = keys.rotate(ref)
    kept = s._save(reencrypt_parts(meta, sealed, keys, ref, new), "moved")
    keys.revoke(ref)
    assert {r.part_uuid: bytes(r.content) for r in decrypt_parts(s, meta, kept, keys, new).collect()} == plain
    with pytest.raises(KeyError):
        keys.get_key(ref)


def test_foreign_parts_are_registered_once(spark, tmp_path):
    a, b = store(spark, tmp_path, "a"), store(spark, tmp_path, "b")
    a.append("d", rows(spark, 20), KEYS, ORDER, part_rows=5)
    b.append("d", rows(spark, 5), KEYS, ORDER, part_rows=5)
    uri = a.files.uri(f"{a.catalog.folder('d')}/data")
    first = b.register_existing("d", uri)
    assert first["inserted"] == a.meta("d").parts.count() and b.register_existing("d", uri)["inserted"] == 0


def test_commands(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append("d", rows(spark), KEYS, ORDER, bid="b")
    part = s.meta("d").parts.first()
    assert run(s, "ls").count() == 1 and run(s, "keys", "d") == {"site": "TEXT", "temp": "REAL"}
    assert run(s, "meta", "d").count() == 2 and run(s, "subsets", "d").count() == 2 and run(s, "parts", "d", part.subset_uuid).count() == 1
    assert run(s, "batches", "d").count() == 1 and run(s, "batch", "d", "b").count() == 2 and run(s, "peek", "d", part.part_uuid).count() > 0
    assert run(s, "audit", "d")["broken_batches"] == [] and "fields" in run(s, "schema", "d")


def test_arrays_of_unequal_length_fail(spark):
    with pytest.raises(PySparkException):
        jagged.rows_of_arrays(spark.createDataFrame([([1, 2], [3])], "a array<int>, b array<int>"), ["a", "b"]).collect()
