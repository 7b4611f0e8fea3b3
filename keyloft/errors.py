"""Errors that callers can tell apart."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException


class SchemaMismatch(ValueError):
    """Columns or types do not fit the dataset's locked schema."""


class InvalidKeyValue(ValueError):
    """A key value is null, or too large to quantize."""


class DataExceedsCanon(ValueError):
    """A jagged value is longer than the canonical length."""


class IdentityConflict(ValueError):
    """Two stores disagree about what identity or schema means."""


class CommitConflict(RuntimeError):
    """Another writer committed first, again and again."""


@contextmanager
def translated() -> Iterator[None]:
    """Raises an error that a row's check names (``named``) as that error instead of Spark's own."""
    try:
        yield
    except PySparkException as e:
        for kind in (InvalidKeyValue, DataExceedsCanon, SchemaMismatch):
            if f"[{kind.__name__}]" in str(e):
                raise kind(str(e).partition(f"[{kind.__name__}] ")[2].split("\n")[0]) from e
        raise


def named(kind: type, text: str) -> str:
    """Text of a check inside a job, from which ``translated`` knows the error."""
    return f"[{kind.__name__}] {text}"
