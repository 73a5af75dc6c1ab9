"""Strongly connected components and what follows from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.durable import Workspace

#: Edges up to which one task finds the components.
ONE_TASK = 200_000


def _tarjan(pairs: pd.DataFrame) -> pd.DataFrame:
    """Components of more than one node, without recursion."""
    out: dict = {}
    for s, t in zip(pairs["src"], pairs["dst"]):
        out.setdefault(s, []).append(t)
    index: dict = {}
    low: dict = {}
    on: set = set()
    stack: list = []
    rows = []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1:
                        first = min(part)
                        rows += [(w, first) for w in part]
    return pd.DataFrame(rows, columns=["id", "scc"])


def _trim(ws: Workspace, pairs: DataFrame, enough: int) -> tuple[DataFrame, int]:
    """Drop edges that begin where none ends or end where none begins, and count what is left.

    Again and again, until ``enough`` are left or a round drops less than a
    tenth: long chains would take a round for each link, and what finds the
    components needs no trimmed graph.
    """
    left = ws.keep(pairs)
    n = left.count()
    while n > enough:
        heads, tails = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        less = ws.keep(left.join(heads, "src", "left_semi").join(tails, "dst", "left_semi"))
        ws.drop(left)
        left, was, n = less, n, less.count()
        if n > 0.9 * was:
            break
    return left, n


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``id, scc`` of nodes on cycles of at least two nodes; scc is the least id of the component.

    Edges outside cycles are trimmed away first if there are many. What is left
    goes to one task if it is small (its size is counted); otherwise the least ids spread along
    the edges as colours, the nodes of a colour that lead back to its origin
    are a component, and the rest is trimmed and coloured again.
    """
    spark = edges.sparkSession
    ws = Workspace(spark, "scc")
    left, n = _trim(ws, edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct(), one_task)
    found = None
    while True:
        if n <= one_task:
            rest = left.groupBy().applyInPandas(_tarjan, "id string, scc string")
            return rest if found is None else found.unionByName(rest)
        nodes = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colour = ws.keep(nodes.withColumn("colour", F.col("id")))
        while True:
            near = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("near"))
            new = ws.keep(colour.join(near, "id", "left").select("id", F.least("colour", F.coalesce("near", "colour")).alias("colour"), (F.col("near") < F.col("colour")).alias("moved")))
            ws.drop(colour)
            colour = new.select("id", "colour")
            if new.where("moved").isEmpty():
                break
        # Backwards from each origin, within its colour.
        same = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("colour"))
        same = ws.keep(same)
        reached = ws.keep(colour.where("id = colour"))
        frontier = reached
        while True:
            near = same.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "colour").distinct()
            frontier = ws.keep(near.join(reached.select("id"), "id", "left_anti"))
            if frontier.isEmpty():
                break
            reached = ws.keep(reached.unionByName(frontier))
        sizes = reached.groupBy("colour").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        part = reached.join(sizes.select("colour"), "colour", "left_semi")
        # The colour is the least id that reaches the component; its own least id names it.
        name = part.groupBy("colour").agg(F.min("id").alias("scc"))
        part = ws.keep(part.join(name, "colour").select("id", "scc"))
        found = part if found is None else found.unionByName(part)
        gone = reached.select("id")
        left, n = _trim(ws, left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), one_task)


def classify(nodes: DataFrame, sccs: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """``scc, size, kind`` of each component: llm_involved, data_persistent (holds a medium) or pure_code.

    ``properties`` (``id, properties``) may give JSON texts; a member with an
    ``llm`` entry involves a model. Invalid JSON has none.
    """
    n = sccs.join(nodes.select("id", F.col("kind").alias("node_kind")), "id", "left")
    if properties is not None:
        has = F.get_json_object("properties", "$.llm").isNotNull()
        n = n.join(properties.where("id is not null").groupBy("id").agg(F.max(has.cast("int")).alias("llm")), "id", "left")
    else:
        n = n.withColumn("llm", F.lit(0))
    per = n.groupBy("scc").agg(F.count(F.lit(1)).alias("size"), F.max(F.coalesce("llm", F.lit(0))).alias("l"), F.max((F.coalesce("node_kind", F.lit("")) == "medium").cast("int")).alias("m"))
    return per.select("scc", "size", F.when(F.col("l") == 1, "llm_involved").when(F.col("m") == 1, "data_persistent").otherwise("pure_code").alias("kind"))
