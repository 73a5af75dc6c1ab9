"""Changes of single files applied to a stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import location_file, location_line

#: Lines by which a renamed or moved symbol may lie apart.
NEAR_LINES = 3


def _placed(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.where("id is not null").select(location_file("location").alias("file"), "name", "kind", location_line("location").alias("line"), F.col("id")).select("file", *[F.col(c).alias(f"{side}_{c}") for c in ("name", "kind", "line", "id")])


def file_diff(old: DataFrame, new: DataFrame, near: int = NEAR_LINES) -> DataFrame:
    """``file, old_id, new_id, change`` between two states of the nodes (``id, name, kind, location``) of the same files.

    Nodes of one file meet first on (name, kind), the k-th with the k-th by
    line and id; the rest on kind within ``near`` lines, where each takes its
    nearest and only mutual choices count. What is left was added or removed.
    Both joins are equi-joins on the file, so no file meets another.
    """
    a, b = _placed(old, "old"), _placed(new, "new")
    ka = a.withColumn("k", F.row_number().over(Window.partitionBy("file", "old_name", "old_kind").orderBy("old_line", "old_id")))
    kb = b.withColumn("k", F.row_number().over(Window.partitionBy("file", "new_name", "new_kind").orderBy("new_line", "new_id")))
    same = ka.join(kb, (ka["file"] == kb["file"]) & (ka["old_name"] == kb["new_name"]) & (ka["old_kind"] == kb["new_kind"]) & (ka["k"] == kb["k"])).select(ka["file"], "old_id", "new_id", F.lit("updated").alias("change"))
    ra = a.join(same.select("file", "old_id"), ["file", "old_id"], "left_anti")
    rb = b.join(same.select("file", "new_id"), ["file", "new_id"], "left_anti")
    block = lambda c, d: F.floor(F.col(c) / (near + 1)) + d
    spread = ra.where("old_line is not null").select("*", F.explode(F.array(*[block("old_line", d) for d in (-1, 0, 1)])).alias("block"))
    close = spread.join(rb.where("new_line is not null").withColumn("block", block("new_line", 0)).withColumnRenamed("new_kind", "old_kind"), ["file", "old_kind", "block"])
    gap = F.abs(F.col("old_line") - F.col("new_line"))
    close = close.where(gap <= near).select("file", "old_id", "new_id", gap.alias("gap"))
    best_old = F.row_number().over(Window.partitionBy("file", "old_id").orderBy("gap", "new_id"))
    best_new = F.row_number().over(Window.partitionBy("file", "new_id").orderBy("gap", "old_id"))
    moved = close.withColumns({"o": best_old, "n": best_new}).where("o = 1 and n = 1").select("file", "old_id", "new_id", F.lit("updated").alias("change"))
    gone = ra.join(moved.select("file", "old_id"), ["file", "old_id"], "left_anti").select("file", "old_id", F.lit(None).cast("string").alias("new_id"), F.lit("removed").alias("change"))
    fresh = rb.join(moved.select("file", "new_id"), ["file", "new_id"], "left_anti").select("file", F.lit(None).cast("string").alias("old_id"), "new_id", F.lit("added").alias("change"))
    return same.unionByName(moved).unionByName(gone).unionByName(fresh)


def keep_attributes(new: DataFrame, old: DataFrame, diff: DataFrame) -> DataFrame:
    """New nodes with every column of ``old``: where they have no value, that of the node that they continue."""
    own = ("id", "name", "kind", "location")
    more = [c for c in old.columns if c not in own]
    was = old.select(F.col("id").alias("old_id"), F.struct(*more).alias("_was")) if more else old.select(F.col("id").alias("old_id"), F.lit(None).alias("_was"))
    was = diff.where("change = 'updated'").select(F.col("new_id").alias("id"), "old_id").join(was, "old_id").groupBy("id").agg(F.min_by("_was", "old_id").alias("_was"))
    value = lambda c: F.coalesce(F.col(c), F.col("_was")[c]) if c in new.columns else F.col("_was")[c]
    return new.join(was, "id", "left").select(*own, *[value(c).alias(c) for c in more])


def replace_files(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the files of ``changed`` (``file``) got other contents.

    Nodes of these files, and edges that begin at them, are replaced; edges of
    other files into them stay where their target is still a node.
    """
    files = changed.select("file").distinct()
    old_ids = nodes.where("location is not null").select("id", location_file("location").alias("file")).join(files, "file", "left_semi").select("id")
    n = nodes.join(old_ids, "id", "left_anti").unionByName(new_nodes, allowMissingColumns=True)
    kept = edges.join(old_ids.withColumnRenamed("id", "source"), "source", "left_anti")
    lost = old_ids.join(new_nodes.select("id"), "id", "left_anti").withColumnRenamed("id", "target")
    return n, kept.join(lost, "target", "left_anti").unionByName(new_edges, allowMissingColumns=True)
