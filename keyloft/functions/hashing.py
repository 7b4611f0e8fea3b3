"""Content hashes of parts and the tamper-evident chain."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def signature(fields: dict[str, T.DataType]) -> str:
    """Schema text that a content hash starts with: names and types, whatever the width of text."""
    return json.dumps([[k, v.simpleString()] for k, v in sorted(fields.items())], separators=(",", ":"))


def _update(digest, column: pa.Array) -> None:
    """Feeds one column: lengths of lists level by level, then values; texts are NFC with a 4-byte length before each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        digest.update(np.asarray(column.value_lengths().fill_null(0), dtype="<i4").tobytes())
        _update(digest, column.flatten())
    elif pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        for x in column.to_pylist():
            raw = unicodedata.normalize("NFC", x or "").encode()
            digest.update(len(raw).to_bytes(4, "little") + raw)
    elif pa.types.is_boolean(column.type):
        digest.update(np.asarray(column.fill_null(False).to_numpy(zero_copy_only=False), dtype="u1").tobytes())
    elif pa.types.is_integer(column.type):
        digest.update(np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), dtype="<i8").tobytes())
    else:
        digest.update(np.asarray(column.to_numpy(zero_copy_only=False), dtype="<f8").tobytes())


def content_hash(table: pa.Table, fields: dict[str, T.DataType]) -> str:
    """Hex BLAKE2b-128 over the schema signature and each field's values, field after field in name order."""
    digest = hashlib.blake2b(digest_size=16)
    digest.update(signature(fields).encode())
    for name in sorted(fields):
        _update(digest, table.column(name))
    return digest.hexdigest()


def row_fingerprint(fields: list[str]) -> Column:
    """SHA-256 of a row's fields in name order, for checks that SQL repeats."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(fields)]), 256)


def chain(entries: Column, salt: str = "") -> Column:
    """Fold of an ordered array of texts: each step is the SHA-256 of the hash so far and the next text."""
    return F.aggregate(entries, F.lit(salt), lambda acc, x: F.sha2(F.concat(acc, x), 256))


def chain_step(prev: str, bid: str, parts: list[tuple[str, str]], created_at: int, salt: str) -> str:
    """Entry of one batch: hash over the previous entry, the batch id, parts by part_uuid with their hashes, time and salt."""
    ordered = sorted(parts)
    text = "\x1f".join([prev, bid, ",".join(p for p, _ in ordered), ",".join(h for _, h in ordered), str(created_at), salt])
    return hashlib.sha256(text.encode()).hexdigest()


def chain_entry(prev: Column, bid: Column, parts: Column, created_at: Column, salt: str) -> Column:
    """chain_step of a sorted array of structs (part_uuid, content_hash), as a column."""
    parts = F.coalesce(parts, F.array().cast("array<struct<part_uuid:string,content_hash:string>>"))
    ids, hashes = F.array_join(parts["part_uuid"], ","), F.array_join(parts["content_hash"], ",")
    return F.sha2(F.concat_ws("\x1f", prev, bid, ids, hashes, created_at.cast("string"), F.lit(salt)), 256)
