"""Dataset schemas: names, allowed types, promotion, canonical JSON and fingerprint."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloft.errors import SchemaMismatch, named

NAME = re.compile(r"[A-Za-z0-9_]+")
#: Columns of the subset table that no key may be called.
RESERVED = ("subset_uuid", "created_at_epoch", "created_at_utc", "marked_for_deletion", "total_rows", "buffer_rows")
MAX_TEXT = 256
_KEY_TYPES = {T.BooleanType: "BOOLEAN", T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.FloatType: "REAL", T.DoubleType: "REAL", T.StringType: "TEXT"}
_SPARK = {"BOOLEAN": T.BooleanType(), "INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType()}


def safe_name(name: str) -> str:
    """The name itself if it is made of letters, digits and underscores."""
    if not NAME.fullmatch(name):
        raise ValueError(f"not a safe name: {name!r}")
    return name


def is_safe(name: Column) -> Column:
    """Whether a text would do as a name."""
    return name.rlike("^[A-Za-z0-9_]+$")


def key_type(kind: T.DataType) -> str:
    """BOOLEAN, INTEGER, REAL or TEXT."""
    found = _KEY_TYPES.get(type(kind))
    if not found:
        raise TypeError(f"a key can't be {kind.simpleString()}")
    return found


def spark_key_type(kind: str) -> T.DataType:
    return _SPARK[kind]


def normal_type(kind: T.DataType) -> T.DataType:
    """Stored type of a field: boolean, long, double or string, or nested arrays of one of them."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(normal_type(kind.elementType), True)
    if isinstance(kind, T.BooleanType | T.StringType):
        return kind
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return T.LongType()
    if isinstance(kind, T.FloatType | T.DoubleType):
        return T.DoubleType()
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return T.LongType()  # unsigned 64-bit input; values of 2**63 and more fail the ANSI cast
    raise TypeError(f"a field can't be {kind.simpleString()}")


def promote(stored: T.DataType, given: T.DataType) -> T.DataType:
    """The stored type if the given one widens to it without loss: boolean to long to double."""
    order = [T.BooleanType(), T.LongType(), T.DoubleType()]
    if isinstance(stored, T.ArrayType) and isinstance(given, T.ArrayType):
        return T.ArrayType(promote(stored.elementType, given.elementType), True)
    if stored == given or stored in order and given in order and order.index(given) <= order.index(stored):
        return stored
    raise SchemaMismatch(f"{given.simpleString()} does not widen to {stored.simpleString()}")


def structured(df: DataFrame, fields: list[str], stored: dict[str, T.DataType] | None = None) -> list[Column]:
    """Fields in name order, cast to their stored types; text over MAX_TEXT characters and nulls fail the job."""
    if stored is not None and set(fields) != set(stored):
        raise SchemaMismatch(f"fields {sorted(fields)} are not {sorted(stored)}")
    out = []
    for name in sorted(fields):
        given = normal_type(df.schema[name].dataType)
        kind = promote(stored[name], given) if stored else given
        col = F.col(name).cast(kind)
        bad = F.col(name).isNull()
        if isinstance(kind, T.StringType):
            bad |= F.length(col) > MAX_TEXT
        out.append(F.when(bad, F.raise_error(F.concat(F.lit(named(SchemaMismatch, f"field {name}: null, or longer than {MAX_TEXT}: ")), F.coalesce(F.substring(col.cast("string"), 1, 20), F.lit("null")))).cast(kind)).otherwise(col).alias(name))
    return out


def depth(kind: T.DataType) -> int:
    """Dimensions of a field: 0 for a plain one."""
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def canonical_json(schema: dict) -> str:
    return json.dumps(schema, sort_keys=True, separators=(",", ":"))


def fingerprint(schema: dict) -> str:
    """SHA-256 of the canonical JSON; the canonical extents of jagged fields, which grow by rebuilding, are left out."""
    return hashlib.sha256(canonical_json({k: v for k, v in schema.items() if k != "canonical"}).encode()).hexdigest()


def field_json(fields: dict[str, T.DataType]) -> list[dict]:
    return [{"name": k, "type": json.loads(v.json())} for k, v in sorted(fields.items())]


def field_types(described: list[dict]) -> dict[str, T.DataType]:
    return {d["name"]: T.StructType.fromJson({"type": "struct", "fields": [{"name": "x", "type": d["type"], "nullable": True, "metadata": {}}]})["x"].dataType for d in described}
