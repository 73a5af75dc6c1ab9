"""Breadth-first operators.

The adjacency is written once to the shared folder, and so is every level, so
that no level plans or reads again what the ones before it made. A small
frontier (its rows are counted) goes to the edges where they lie, which moves
no edge and leaves no task with a hub's edges; a larger one is joined, hot
nodes apart. Seeds are DataFrames, so one walk can start from many nodes; with
a key column every key has a walk of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.durable import Workspace
from loomgraph.plans.skew import lookup_join

#: Rows of a frontier up to which it is sent to the edges.
SMALL_FRONTIER = 100_000


def layers(adj: DataFrame, seeds: DataFrame, depth: int, keys: tuple[str, ...] = (), small: int = SMALL_FRONTIER) -> DataFrame:
    """``*keys, id, depth`` of every node within ``depth`` steps of the seeds (``*keys, id``).

    A seed is at depth 0 whether it is a node or not. Null ids are no seeds.
    """
    by = [*keys, "id"]
    ws = Workspace(adj.sparkSession, "layers")
    frontier = seen = ws.keep(seeds.where("id is not null").select(*by).distinct().withColumn("depth", F.lit(0)))
    hops = ws.keep(adj.select("src", "dst").where("src <> dst")) if depth > 1 else adj.select("src", "dst").where("src <> dst")
    for level in range(1, depth + 1):
        n = frontier.count()
        if not n:
            break
        at = frontier.select(*keys, F.col("id").alias("src"))
        if n <= small:
            near = hops.join(F.broadcast(at), "src")
        elif keys:
            near = hops.join(at, "src")
        else:
            near = lookup_join(hops, at, "src", "inner")
        near = near.select(*keys, F.col("dst").alias("id")).distinct()
        frontier = ws.keep(near.join(seen.select(*by), by, "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
    ws.drop(hops)
    return seen


def impact(adj: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """The layers around the seeds; layer 0 is the seeds themselves."""
    return layers(adj, seeds, depth)


def neighbors(adj: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """``id, depth, parent``: nodes around the seeds with the least node of the layer before that leads there."""
    seen = layers(adj, seeds, depth)
    back = seen.select(F.col("id").alias("src"), (F.col("depth") + 1).alias("depth"))
    step = back.join(adj.select("src", F.col("dst").alias("id")), "src")
    return seen.where("depth > 0").join(step, ["id", "depth"]).groupBy("id", "depth").agg(F.min("src").alias("parent"))


def ego(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges among the seeds and their direct neighbours."""
    from loomgraph.operators.graph import adjacency

    near = layers(adjacency(edges), seeds, 1).select("id")
    return edges.join(near.withColumnRenamed("id", "source"), "source", "left_semi").join(near.withColumnRenamed("id", "target"), "target", "left_semi")


def blast_radius(adj: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """One row ``seeds, reached``: how many nodes the seeds reach besides themselves."""
    seen = layers(adj, seeds, depth)
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return seen.agg(one(F.col("depth") == 0).alias("seeds"), one(F.col("depth") > 0).alias("reached"))


def shortest_path(adj: DataFrame, source: str, target: str, max_depth: int = 20) -> DataFrame:
    """One row ``length, path`` of a shortest path, or none within ``max_depth``.

    Layers are walked from the source until the target appears; the path is
    read off backwards, the least parent per layer, so no row ever carries more
    than its own id, and the driver holds only the path.
    """
    spark = adj.sparkSession
    hops = adj.select("src", "dst").where("src <> dst").distinct()
    if source == target:
        return spark.range(1).select(F.lit(0).alias("length"), F.array(F.lit(source)).alias("path"))
    ws = Workspace(spark, "path")
    seen = ws.keep(spark.range(1).select(F.lit(source).alias("id"), F.lit(source).alias("parent"), F.lit(0).alias("depth")))
    frontier, length = seen, None
    for level in range(1, max_depth + 1):
        near = frontier.select(F.col("id").alias("src")).join(hops, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = ws.keep(near.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if not frontier.where(F.col("id") == target).isEmpty():
            length = level
            break
    if length is None:
        return spark.range(0).select(F.lit(0).alias("length"), F.array(F.lit("")).alias("path"))
    path = [target]
    for level in range(length, 0, -1):
        path.append(seen.where((F.col("depth") == level) & (F.col("id") == path[-1])).first()["parent"])
    path.reverse()
    return spark.range(1).select(F.lit(length).alias("length"), F.array(*[F.lit(p) for p in path]).alias("path"))
