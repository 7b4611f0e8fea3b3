"""Small text and path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relpath(subset: Column, part: Column, version: int = 1, depth: int = 2, seglen: int = 2, algorithm: str = "sha256", suffix: str = ".parquet") -> Column:
    """subsets/<subset>/parts/v<version>/<hash slices>/<part><suffix>; slices of the hash of both ids spread the files."""
    both = F.concat(subset, part)
    digest = {"sha256": lambda: F.sha2(both, 256), "sha1": lambda: F.sha1(both), "md5": lambda: F.md5(both)}[algorithm]()
    slices = [F.substring(digest, 1 + i * seglen, seglen) for i in range(depth)]
    return F.concat_ws("/", F.lit("subsets"), subset, F.lit(f"parts/v{version}"), *slices, F.concat(part, F.lit(suffix)))


def redacted(secret: Column, shown: int = 4) -> Column:
    return F.when(secret.isNotNull(), F.concat(F.left(secret, F.lit(shown)), F.lit("…")))


def trimmed(code: Column, head: int, tail: int) -> Column:
    """Head and tail of a long text with a mark between."""
    return F.when(F.length(code) <= head + tail, code).otherwise(F.concat(F.left(code, F.lit(head)), F.lit("\n…\n"), F.right(code, F.lit(tail))))


def ellipsized(text: Column, n: int = 160) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n - 1)), F.lit("…")))


def table_cell(text: Column) -> Column:
    """Text with the column mark of a Markdown table escaped."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def aad(*ids: Column) -> Column:
    """Additional authenticated data: the ids in order, joined by bars."""
    return F.concat_ws("|", *ids)


def sealed(payload: Column, key: Column, iv: Column, bound_to: Column) -> Column:
    """AES-GCM of a payload, bound to the additional data; opening it with other data fails."""
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), iv, bound_to)


def opened(sealed_payload: Column, key: Column, bound_to: Column) -> Column:
    return F.aes_decrypt(sealed_payload, key, F.lit("GCM"), F.lit("DEFAULT"), bound_to)
