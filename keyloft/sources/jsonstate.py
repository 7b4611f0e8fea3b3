"""State kept as JSON: missing or broken files read as their defaults."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from keyloft.sources.files import Files

NODES = "fqid string, kind string, has_body boolean, source_path string, source_start long, source_end long"
EDGES = "src string, dst string"
PROGRESS = "path string, status string, notes array<string>, updated_at string"


def load_json(files: Files, rel: str, default):
    """The file's value, or the default if there is none or it does not parse."""
    try:
        return json.loads(files.read(rel)) if files.exists(rel) else default
    except ValueError:
        return default


def nodes(spark: SparkSession, files: Files, rel: str) -> DataFrame:
    rows = load_json(files, rel, [])
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in NODES.split(", ")) for r in rows], NODES)


def edges(spark: SparkSession, files: Files, rel: str) -> DataFrame:
    out = load_json(files, rel, {}).get("out", {})
    return spark.createDataFrame([(s, d) for s, ds in sorted(out.items()) for d in ds], EDGES)


def progress(spark: SparkSession, files: Files, rel: str) -> DataFrame:
    modules = load_json(files, rel, {}).get("modules", {})
    return spark.createDataFrame([(p, m.get("status", "pending"), [str(n) for n in m.get("notes", [])], m.get("updated_at")) for p, m in sorted(modules.items())], PROGRESS)
