"""Identity of a subset: special codes and quantized values of real keys, and the id made from them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloft.errors import InvalidKeyValue, named

DEFAULT_SCALE = 1e3
#: Fixed codes: a normal number, NaN, +Inf, -Inf.
NORMAL, NAN, PLUS_INF, MINUS_INF = 0, 1, 2, 3


def special_code(k: Column) -> Column:
    k = k.cast("double")
    return F.when(F.isnan(k), NAN).when(k == float("inf"), PLUS_INF).when(k == float("-inf"), MINUS_INF).otherwise(NORMAL).cast("int")


def quantized(k: Column, scale: float) -> Column:
    """round(k * scale), halves to even; 0 for special values; values beyond 64 bits fail the job."""
    scaled = F.rint(k.cast("double") * F.lit(float(scale)))
    fits = F.abs(scaled) < F.lit(float(2**63))
    return F.when(special_code(k) == NORMAL, F.when(fits, scaled.cast("long")).otherwise(F.raise_error(F.lit(named(InvalidKeyValue, "a key is too large to quantize"))).cast("long"))).otherwise(F.lit(0).cast("long"))


def special_of(v: float, scale: float) -> tuple[int, int]:
    """The same two numbers of one Python value."""
    if v != v:
        return NAN, 0
    if v in (float("inf"), float("-inf")):
        return (PLUS_INF if v > 0 else MINUS_INF), 0
    return NORMAL, round(v * scale)


def identity_columns(keys: dict[str, str], scales: dict[str, float]) -> list[Column]:
    """Per REAL key <k>_s and <k>_q; other keys as they are."""
    out = []
    for k, kind in keys.items():
        out += [special_code(F.col(k)).alias(f"{k}_s"), quantized(F.col(k), scales.get(k, DEFAULT_SCALE)).alias(f"{k}_q")] if kind == "REAL" else []
    return out


def identity_text(keys: dict[str, str]) -> Column:
    """The identity tuple in key order, comma joined; commas and backslashes of text keys are escaped."""
    parts = []
    for k, kind in keys.items():
        if kind == "REAL":
            parts += [F.col(f"{k}_s").cast("string"), F.col(f"{k}_q").cast("string")]
        elif kind == "TEXT":
            parts.append(F.replace(F.replace(F.col(k), F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,")))
        elif kind == "BOOLEAN":
            parts.append(F.when(F.col(k), "True").otherwise("False"))
        else:
            parts.append(F.col(k).cast("string"))
    return F.concat_ws(",", *parts)


@F.pandas_udf(T.StringType())
def uuid_of(text: pd.Series) -> pd.Series:
    """UUID of the 16-byte BLAKE2b digest of each text."""
    return text.map(lambda x: None if x is None else str(uuid.UUID(bytes=hashlib.blake2b(x.encode(), digest_size=16).digest())))


def with_subset_uuid(df: DataFrame, keys: dict[str, str], scales: dict[str, float], save: Callable[[DataFrame], DataFrame] = lambda ids: ids) -> DataFrame:
    """Adds identity columns and subset_uuid. The id is computed once per distinct key, then joined back.

    With save, which writes and rereads the ids, the join knows their size and can split a hot subset.
    """
    rows = df.select("*", *identity_columns(keys, scales)).withColumn("_identity", identity_text(keys))
    ids = save(rows.select("_identity").distinct().withColumn("subset_uuid", uuid_of("_identity")))
    return rows.join(ids, "_identity").drop("_identity")


def display_key(keys: dict[str, str], decimals: int = 6) -> Column:
    """Sorted compact JSON of the keys, reals rounded half to even. For display, not for identity."""
    return F.to_json(F.struct(*[F.bround(F.col(k), decimals).alias(k) if keys[k] == "REAL" else F.col(k).alias(k) for k in sorted(keys)]))
