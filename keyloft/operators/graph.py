"""Call-graph tables and progress state: small joins over nodes, edges and module rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_edges(edges: DataFrame) -> DataFrame:
    """Sorted distinct sources of every target."""
    return edges.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("srcs"))


def neighborhood(seeds: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """id: the seeds with everything one edge away in either direction, as far as it is known."""
    out = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return seeds.select("id").union(out).union(back).distinct().join(known.select("id"), "id", "left_semi")


def merge_nodes(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Delta nodes replace base nodes of the same fqid or the same source file."""
    kept = base.join(delta.select("fqid"), "fqid", "left_anti").join(delta.filter("source_path is not null").select("source_path").distinct(), "source_path", "left_anti")
    return kept.select(base.columns).unionByName(delta)


def merge_edges(base: DataFrame, delta: DataFrame) -> DataFrame:
    """All edges of a source are replaced by the delta's."""
    return base.join(delta.select("src").distinct(), "src", "left_anti").select("src", "dst").union(delta.select("src", "dst"))


def bad_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from or to nothing, or to themselves; a class stands for its constructor."""
    known = nodes.select(F.col("fqid").alias("_f"))
    targets = known.union(nodes.filter(F.col("fqid").endswith(".__init__")).select(F.regexp_replace("fqid", "\\.__init__$", "")))
    no_src = edges.join(known, edges.src == known._f, "left_anti").withColumn("reason", F.lit("unknown source"))
    no_dst = edges.join(targets, edges.dst == targets._f, "left_anti").withColumn("reason", F.lit("unknown target"))
    return no_src.union(no_dst).union(edges.filter("src = dst").withColumn("reason", F.lit("calls itself")))


def without_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with a body and no outgoing edge."""
    return nodes.filter("has_body").join(edges.select(F.col("src").alias("fqid")), "fqid", "left_anti")


def conflicting_keys(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that come with differing fields."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*fields)).alias("variants")).filter("variants > 1")


def status_histogram(rows: DataFrame, column: str, ordered: list[str]) -> DataFrame:
    """Count and percentage of each listed status, zeros included."""
    spark = rows.sparkSession
    listed = spark.createDataFrame(list(enumerate(ordered)), "place int, status string")
    counts = rows.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("_n"))
    out = F.broadcast(listed).join(counts, "status", "left").select("status", "place", F.coalesce("_n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return out.withColumn("pct", F.when(total > 0, F.round(100 * F.col("n") / total, 1)).otherwise(0.0))


def by_top_directory(paths: DataFrame, column: str = "path") -> DataFrame:
    return paths.groupBy(F.split_part(column, F.lit("/"), F.lit(1)).alias("top")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(column)).alias("paths"))


def latest_notes(modules: DataFrame, limit: int = 20) -> DataFrame:
    """Last note of each module, newest module first."""
    return modules.filter(F.size("notes") > 0).select("path", F.element_at("notes", -1).alias("note"), "updated_at").orderBy(F.desc("updated_at"), "path").limit(limit)


def upsert_stamps(base: DataFrame, delta: DataFrame, key: str = "path", stamp: str = "stamp") -> DataFrame:
    """Union of two keyed sets with the newest stamp."""
    return base.select(key, stamp).union(delta.select(key, stamp)).groupBy(key).agg(F.max(stamp).alias(stamp))


def advance_status(rows: DataFrame, updates: DataFrame, ordered: list[str], force: bool = False) -> DataFrame:
    """path, status after updates; a status only moves forward in the order unless forced."""
    place = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ordered]), F.col(c)).cast("int"), F.lit(0))
    joined = rows.select("path", "status").join(updates.select("path", F.col("status").alias("new")), "path", "full")
    forward = F.lit(force) | F.col("status").isNull() | (place("new") >= place("status"))
    return joined.select("path", F.when(F.col("new").isNotNull() & forward, F.col("new")).otherwise(F.col("status")).alias("status"))


def promote(queue: DataFrame, following: DataFrame) -> DataFrame:
    """owner, role, path after one step: current becomes previous, next becomes current, and following names the next ones.

    queue has owner, role (previous, current or next) and path; following has owner and path. An owner without a next keeps
    none as current.
    """
    moved = queue.filter("role in ('current', 'next')").withColumn("role", F.when(F.col("role") == "next", "current").otherwise("previous"))
    return moved.select("owner", "role", "path").unionByName(following.select("owner", F.lit("next").alias("role"), "path"))
