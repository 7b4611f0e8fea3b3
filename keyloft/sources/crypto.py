"""Part files under authenticated encryption, with keys from a key service."""

from __future__ import annotations

import hashlib
import os
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloft.functions import text
from keyloft.sources.store import Meta, Store


class KeyService(Protocol):
    def generate_data_key(self) -> str: ...

    def get_key(self, key_ref: str) -> bytes: ...

    def rotate(self, key_ref: str) -> str: ...

    def revoke(self, key_ref: str) -> None: ...


class LocalKeys:
    """A key service in memory, for tests and single machines."""

    def __init__(self):
        self._keys: dict[str, bytes] = {}
        self.rotations: list[tuple[str, str]] = []

    def generate_data_key(self) -> str:
        ref = os.urandom(8).hex()
        self._keys[ref] = os.urandom(32)
        return ref

    def get_key(self, key_ref: str) -> bytes:
        return self._keys[key_ref]

    def rotate(self, key_ref: str) -> str:
        new = self.generate_data_key()
        self.rotations.append((key_ref, new))
        return new

    def revoke(self, key_ref: str) -> None:
        del self._keys[key_ref]


def _bound(dataset_uuid: str):
    return text.aad(F.lit(dataset_uuid), F.col("subset_uuid"), F.col("part_uuid"), F.col("content_hash"), F.col("scheme_version").cast("string"), F.lit("1"), F.col("key_ref"))


def _nonce(mark: str):
    return F.unhex(F.substring(F.sha2(F.concat(F.lit(mark), "part_uuid", "content_hash"), 256), 1, 24))


def _with_key(rows: DataFrame, keys: KeyService, key_ref: str) -> DataFrame:
    """Rows with column key, joined from a table of one row by key_ref, so that no plan, log or page shows the key."""
    held = rows.sparkSession.createDataFrame([(key_ref, bytearray(keys.get_key(key_ref)))], "key_ref string, key binary")
    return rows.join(F.broadcast(held), "key_ref")


def encrypt_parts(store: Store, meta: Meta, keys: KeyService, key_ref: str) -> DataFrame:
    """part_uuid, key_ref, nonce, plaintext_size, tag, payload: the files of a selection, sealed and bound to their ids.

    The nonce follows from key and part, so a repeated run gives the same bytes and no nonce serves two parts.
    """
    folder = store.catalog.folder(meta.alias)
    paths = [store.files.uri(f"{folder}/{r.file_relpath}") for r in meta.parts.select("file_relpath").toLocalIterator()]
    files = store.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths).select(F.regexp_extract("path", "p=([^/]+)/", 1).alias("part_uuid"), "content")
    rows = files.join(meta.parts.select("part_uuid", "subset_uuid", "content_hash", "scheme_version"), "part_uuid").withColumn("key_ref", F.lit(key_ref))
    mark = hashlib.sha256(keys.get_key(key_ref)).hexdigest()
    rows = _with_key(rows, keys, key_ref).withColumn("nonce", _nonce(mark))
    sealed = text.sealed(F.col("content"), F.col("key"), F.col("nonce"), _bound(meta.info["dataset_uuid"]))
    rows = rows.withColumn("payload", sealed)
    return rows.select("part_uuid", "subset_uuid", "content_hash", "scheme_version", "key_ref", "nonce", F.octet_length("content").cast("long").alias("plaintext_size"), F.expr("substring(payload, -16, 16)").alias("tag"), "payload")


def decrypt_parts(store: Store, meta: Meta, sealed: DataFrame, keys: KeyService, key_ref: str) -> DataFrame:
    """part_uuid, content; payloads that were changed or moved to another part fail the job."""
    opened = text.opened(F.col("payload"), F.col("key"), _bound(meta.info["dataset_uuid"]))
    return _with_key(sealed, keys, key_ref).select("part_uuid", opened.alias("content"))


def reencrypt_parts(meta: Meta, sealed: DataFrame, keys: KeyService, old_ref: str, new_ref: str) -> DataFrame:
    """The rows of ``encrypt_parts`` under another key; the old key may be revoked once they are kept."""
    bound = _bound(meta.info["dataset_uuid"])
    opened = _with_key(sealed, keys, old_ref).withColumn("content", text.opened(F.col("payload"), F.col("key"), bound)).drop("key", "payload", "tag", "nonce")
    mark = hashlib.sha256(keys.get_key(new_ref)).hexdigest()
    rows = _with_key(opened.withColumn("key_ref", F.lit(new_ref)), keys, new_ref)
    rows = rows.withColumn("nonce", _nonce(mark)).withColumn("payload", text.sealed(F.col("content"), F.col("key"), F.col("nonce"), bound))
    return rows.withColumn("tag", F.expr("substring(payload, -16, 16)")).select(sealed.columns)
