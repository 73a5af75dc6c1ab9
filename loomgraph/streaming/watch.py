"""A stored graph that follows a stream of file changes.

Changes arrive as rows ``path, action, source`` in files of a folder. Each
micro-batch keeps the first action per path, extracts the changed files,
replaces their part of the graph and saves a new version; batches that would
lose too many edges while files fail to parse are refused. The version pointer
moves last, and with it the number of the batch, so a batch that is repeated
after a failure or a restart changes nothing twice. A batch reads and writes the
whole graph once, as every version stands for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.columns import edge_key, location_file
from loomgraph.operators import extract as X
from loomgraph.operators import graph as G
from loomgraph.operators import incremental as I
from loomgraph.operators.store import GraphStore

CHANGES = "path string, action string, source string, at timestamp"
#: A version may not have less than this share of the edges of the last when files failed to parse.
LEAST_SHARE = 0.85


def first_actions(changes: DataFrame) -> DataFrame:
    """One row per path: the first action, with the latest text."""
    return changes.where("path is not null").groupBy("path").agg(F.min_by("action", "at").alias("action"), F.max_by("source", "at").alias("source"), F.max("at").alias("mtime"))


class Refused(RuntimeError):
    """An update that would damage the graph."""


def update(store: GraphStore, changes: DataFrame, number: int | None = None) -> str:
    """Apply one batch of changes; the name of the new version.

    Nodes that continue an earlier one keep its columns; edges of the changed
    files are resolved against the whole graph, and those that name no node are
    left out.
    """
    nodes, edges = store.load()
    batch = first_actions(changes)
    rec = X.records(batch.where("action <> 'removed'")).cache()
    try:
        files = batch.select(F.col("path").alias("file"))
        touched = nodes.withColumn("_file", location_file("location")).join(files.withColumnRenamed("file", "_file"), "_file", "left_semi").drop("_file")
        found = X.nodes(rec)
        new_nodes = I.keep_attributes(found, touched, I.file_diff(touched, found))
        every = nodes.select("id", "name").unionByName(new_nodes.select("id", "name")).distinct()
        new_edges = G.without_dangling(every, G.resolve(every, G.canonical_edges(X.edges(rec))))
        if "id" in edges.columns:
            new_edges = new_edges.withColumn("id", edge_key())
        n, e = I.replace_files(nodes, edges, files, new_nodes, new_edges)
        failed = X.errors(rec).count()
        if failed:
            was, now = edges.count(), e.count()
            if was and now < LEAST_SHARE * was:
                raise Refused(f"{failed} files failed and {was - now} of {was} edges would be lost")
        return store.save(n, e, number)
    finally:
        rec.unpersist()


def follow(spark: SparkSession, folder: str, store: GraphStore, checkpoint: str, log: list | None = None):
    """Start the stream; ``log`` gets (batch, version or reason) of each batch."""
    stream = spark.readStream.schema(CHANGES).json(folder)

    def apply(df: DataFrame, batch: int) -> None:
        last = store.batch()
        if last is not None and batch <= last:
            return
        if df.isEmpty():
            return
        try:
            result = update(store, df, batch)
        except Refused as x:
            result = str(x)
            store.skip(batch)
        if log is not None:
            log.append((batch, result))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
