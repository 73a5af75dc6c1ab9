"""Parent-child links to full hierarchies (problem 5).

Every node walks to its next splitter (a node chosen by a hash of its id, or a
root) by pointer doubling, so the rounds grow with the logarithm of the
distance between splitters. The splitters alone form a reduced pointer graph, a
fixed fraction of the nodes, which is solved in the same way; the results
expand to all nodes with one join. A walk longer than there are walkers left
has no root: cycles without a splitter are found in the first phase, those with
splitters in the second. A row holds an id, a pointer and a distance, however
deep the tree; only full paths, if asked for, grow with the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import edge_kind
from loomgraph.plans.durable import Workspace
from loomgraph.plans.skew import lookup_join

#: One id in so many is a splitter.
SPLIT_EVERY = 8


def containment(edges: DataFrame, kind: str = "defines") -> DataFrame:
    """``id, parent`` of every id on an edge of the kind; parent is null at a root.

    An edge without source or target links nothing. Repeated edges count once;
    an id with several parents (which the data should not have) keeps the least.
    """
    links = edges.where((edge_kind("kind") == kind) & F.col("source").isNotNull() & F.col("target").isNotNull())
    ends = links.select(F.explode(F.array(F.struct(F.col("target").alias("id"), F.col("source").alias("parent")), F.struct(F.col("source").alias("id"), F.lit(None).cast("string").alias("parent")))).alias("e"))
    return ends.select("e.id", "e.parent").groupBy("id").agg(F.min("parent").alias("parent"))


def _chase(ws: Workspace, state: DataFrame, paths: bool) -> DataFrame:
    """Double the pointers of ``state`` until every row stops or is known to run in a circle.

    Columns: id, ptr (an ancestor), dist (links to it), stop (ptr ends a walk),
    loop (the walk runs in a circle), and with ``paths`` seg (the ids from the
    parent up to ptr). After as many doublings all rows that still go have made
    the same number of steps; when that is more than there were going rows one
    doubling before, no walk without a repeated id is so long, and the rest
    runs in circles. So no row carries what it has passed.
    """
    seg = ["seg"] if paths else []
    state = ws.keep(state.select("id", "ptr", "dist", "stop", "loop", *seg))
    steps, before = 1, None
    while True:
        going = state.where("not stop and not loop")
        n = going.count()
        if not n:
            return state
        if before is not None and steps // 2 > before:
            return state.withColumn("loop", ~F.col("stop"))
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("stop").alias("stop2"), F.col("loop").alias("loop2"), *[F.col("seg").alias("seg2") for _ in seg])
        moved = lookup_join(going, ahead, "ptr", "inner")
        moved = moved.select("id", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("stop2").alias("stop"), F.col("loop2").alias("loop"), *[F.concat("seg", "seg2").alias("seg") for _ in seg])
        new = ws.keep(state.where("stop or loop").unionByName(moved))
        ws.drop(state)
        state, before, steps = new, n, 2 * steps


def hierarchy(links: DataFrame, split_every: int = SPLIT_EVERY, paths: bool = False) -> DataFrame:
    """``id, root, depth`` (and ``path`` from the root to the id) of each row of ``id, parent``.

    A root is its own root at depth 0. An id on a circle of links or below one
    has root ``''`` and depth -1 (and an empty path); a link to itself is a
    circle. A parent without a row of its own must not occur; ``containment``
    gives none. An empty input gives an empty result.
    """
    ws = Workspace(links.sparkSession, "hierarchy")
    nodes = ws.keep(links.select("id", "parent"))
    splits = F.pmod(F.xxhash64("id"), F.lit(split_every)) == 0
    marks = nodes.select(F.col("id").alias("parent"), (splits | F.col("parent").isNull()).alias("stop"), F.col("parent").isNull().alias("at_root"))
    first = lookup_join(nodes.where("parent is not null and parent <> id"), marks, "parent", "inner")
    self_loops = nodes.where("parent = id").select("id", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("dist"), F.lit(False).alias("stop"), F.lit(True).alias("loop"), *[F.array("parent").alias("seg") for _ in range(paths)])
    state = first.select("id", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("dist"), "stop", F.lit(False).alias("loop"), *[F.array("parent").alias("seg") for _ in range(paths)])
    walked = _chase(ws, state.unionByName(self_loops), paths)

    roots = nodes.where("parent is null").select("id")
    # The reduced graph: splitters that are no roots, pointing at the next splitter or root.
    reduced = walked.where(splits & F.col("stop")).join(roots.select(F.col("id").alias("ptr"), F.lit(True).alias("at_root")), "ptr", "left")
    seg = ["seg"] if paths else []
    reduced = reduced.select("id", "ptr", "dist", F.coalesce("at_root", F.lit(False)).alias("stop"), F.lit(False).alias("loop"), *seg)
    astray = walked.where(splits & F.col("loop")).select("id", "ptr", "dist", F.lit(False).alias("stop"), F.lit(True).alias("loop"), *seg)
    solved = _chase(ws, reduced.unionByName(astray), paths)

    # Expand: roots stand for themselves, every walk that stopped takes over its splitter's result.
    ends = solved.selectExpr("id as ptr", "case when loop then '' else ptr end as root", "case when loop then -1L else dist end as up", "seg as above" if paths else "cast(null as array<string>) as above")
    ends = ends.unionByName(roots.select(F.col("id").alias("ptr"), F.col("id").alias("root"), F.lit(0).cast("long").alias("up"), F.lit(None).cast("array<string>").alias("above")))
    stopped = lookup_join(walked.where("stop"), ends, "ptr", "inner")
    bad = F.col("up") < 0
    whole = F.reverse(F.concat(F.array("id"), "seg", F.coalesce("above", F.array().cast("array<string>")))) if paths else F.lit(None).cast("array<string>")
    out = stopped.select("id", "root", F.when(bad, -1).otherwise(F.col("dist") + F.col("up")).cast("int").alias("depth"), F.when(bad, F.array().cast("array<string>")).otherwise(whole).alias("path"))
    looped = walked.where("loop").select("id", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("path"))
    own = roots.select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    out = out.unionByName(looped).unionByName(own)
    out = ws.keep(out if paths else out.drop("path"))
    ws.keep_only(out)
    return out


def descendants(paths: DataFrame) -> DataFrame:
    """``id, descendant, distance`` for every node below every node, from the paths of ``hierarchy``.

    Nodes on or below a circle have no path and take no part.
    """
    steps = paths.select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "id"))
    return steps.where("at < depth").select("id", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
