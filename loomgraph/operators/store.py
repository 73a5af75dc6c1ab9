"""Stored graphs: keyed merges, versions behind a pointer, timeline and traces."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.durable import drop_path

#: Newest entries that a timeline keeps.
TIMELINE_KEEP = 10_000


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` does not have. Null keys never match."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """As ``upsert`` on (source, target, kind), but only depth and delay of an edge are replaced."""
    key = ["source", "target", "kind"]
    n = new.groupBy(*key).agg(F.min("coupling_depth").alias("d"), F.min("temporal_delay_sec").alias("t"), F.lit(True).alias("hit"))
    kept = old.join(n, key, "left").withColumns({"coupling_depth": F.when(F.col("hit"), F.col("d")).otherwise(F.col("coupling_depth")), "temporal_delay_sec": F.when(F.col("hit"), F.col("t")).otherwise(F.col("temporal_delay_sec"))}).drop("d", "t", "hit")
    fresh = new.join(old.select(*key), key, "left_anti").dropDuplicates(key)
    return kept.unionByName(fresh, allowMissingColumns=True)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of ``ids`` (``id``) and without edges at them."""
    gone = ids.select("id").distinct()
    e = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(gone, "id", "left_anti"), e


def rename(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """Nodes of the name ``old`` get the name ``new``; ids and edges stay."""
    return nodes.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))


def latest(events: DataFrame, limit: int | None = None, since: str | None = None, module: str | None = None) -> DataFrame:
    """Timeline entries newest first: repeated rows count once, an id keeps its latest row."""
    e = events.where("id is not null")
    if since is not None:
        e = e.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if module is not None:
        e = e.where(F.col("file").contains(module))
    cols = [c for c in e.columns if c not in ("id", "timestamp")]
    e = e.groupBy("id").agg(F.max(F.struct("timestamp", *cols)).alias("r")).select("id", "r.*")
    return e if limit is None else e.orderBy(F.desc("id")).limit(limit)


def prune(events: DataFrame, keep: int = TIMELINE_KEEP) -> DataFrame:
    """The ``keep`` entries with the largest ids."""
    return events.dropDuplicates(["id"]).orderBy(F.desc("id")).limit(keep)


def hotspots(events: DataFrame, days: int = 30, least: int = 3) -> DataFrame:
    """``file, n, last`` of files that changed at least ``least`` times in the ``days`` before the last entry."""
    e = latest(events).where("file is not null and file <> ''")
    end = events.agg(F.max("timestamp").alias("end"))
    recent = e.crossJoin(end).where(F.col("timestamp") >= F.col("end") - F.make_dt_interval(F.lit(days)))  # one row
    return recent.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last")).where(F.col("n") >= least)


def history(nodes: DataFrame, edges: DataFrame, events: DataFrame, per_node: int = 20) -> DataFrame:
    """``id, dependencies, dependents, entry``: each node with the latest timeline ids of its file."""
    from loomgraph.operators.graph import degrees

    e = latest(events).where("file <> ''").select("file", F.col("id").alias("entry"))
    r = e.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("entry")))).where(F.col("r") <= per_node).drop("r")
    d = degrees(nodes, edges).select("id", F.col("out_degree").alias("dependencies"), F.col("in_degree").alias("dependents"))
    return nodes.select("id", "file").join(r, "file").join(d, "id").select("id", "dependencies", "dependents", "entry")


def late_entries(events: DataFrame, hours: int = 24) -> DataFrame:
    """``id, timestamp, behind_s`` of entries that lie more than ``hours`` behind one with a smaller id.

    The largest time before each entry is found with one value per block of ids,
    one per block of blocks, and a window within each, so no task orders the
    whole timeline.
    """
    e = latest(events).select("id", "timestamp")
    block, upper = F.floor(F.col("id") / 4096), F.floor(F.col("block") / 4096)
    tops = e.groupBy(block.alias("block")).agg(F.max("timestamp").alias("top")).withColumn("upper", upper)
    # Blocks of blocks: a task orders 4,096 values, and the last one a value for every 16 million ids.
    whole = tops.groupBy("upper").agg(F.max("top").alias("top"))
    above = whole.select("upper", F.max("top").over(Window.orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    near = F.max("top").over(Window.partitionBy("upper").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = tops.withColumn("near", near).join(above, "upper").select("block", F.greatest("near", "far").alias("carried"))
    inside = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    j = e.withColumn("block", block).withColumn("own", F.max("timestamp").over(inside)).join(before, "block")
    behind = F.unix_seconds(F.greatest("own", "carried").cast("timestamp")) - F.unix_seconds(F.col("timestamp").cast("timestamp"))
    return j.select("id", "timestamp", behind.alias("behind_s")).where(F.col("behind_s") > hours * 3600)


def save_trace(old: DataFrame, new: DataFrame) -> DataFrame:
    """Traces merged on trace_id; a known trace keeps its created_at."""
    first = old.select("trace_id", F.col("created_at").alias("_c"))
    n = new.join(first, "trace_id", "left").withColumn("created_at", F.coalesce("_c", "created_at")).drop("_c")
    return upsert(old, n, "trace_id")


def drop_trace(traces: DataFrame, trace_id: str, hard: bool = False) -> DataFrame:
    """A trace marked deprecated, or gone if ``hard``."""
    if hard:
        return traces.where(~F.col("trace_id").eqNullSafe(F.lit(trace_id)))
    return traces.withColumn("status", F.when(F.col("trace_id") == trace_id, "deprecated").otherwise(F.col("status")))


def stale_traces(traces: DataFrame, changed: DataFrame) -> DataFrame:
    """Active traces of which an involved file (``files_involved``) ends like a changed one (``path``), marked stale.

    Suffixes meet on the file name first, so the comparison is an equi-join.
    """
    last = lambda c: F.substring_index(F.translate(c, "\\", "/"), "/", -1)
    f = traces.select("trace_id", F.explode("files_involved").alias("file")).withColumn("last", last("file"))
    c = changed.where("path is not null").select("path", last("path").alias("last")).distinct()
    hit = f.join(c, "last").where(F.col("file").endswith(F.col("path")) | F.col("path").endswith(F.col("file"))).select("trace_id", F.lit(True).alias("hit")).distinct()
    out = traces.join(hit, "trace_id", "left")
    return out.withColumn("status", F.when(F.col("hit") & (F.col("status") == "active"), "stale").otherwise(F.col("status"))).drop("hit")


def latest_trace(traces: DataFrame) -> DataFrame:
    """The newest trace of each resource (by id)."""
    w = Window.partitionBy("resource").orderBy(F.desc("id"))
    return traces.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class GraphStore:
    """Versions of a graph in one folder; a small pointer file names the current one.

    A version is complete before the pointer moves, and the pointer is replaced
    by a rename, so readers see the old version or the new one. ``keep`` older
    versions stay. The pointer also keeps the number of the last batch that was
    applied, so that a batch is not applied twice, whichever process does it.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _files(self, name: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(conf), conf

    def _pointer(self) -> dict:
        path, fs, _ = self._files("current")
        if not fs.exists(path):
            return {"version": None, "older": [], "batch": None}
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, to: dict) -> None:
        jvm = self.spark._jvm
        fresh, fs, conf = self._files(f"current.{time.time_ns()}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(json.dumps(to).encode()))
        stream.close()
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(self._files("current")[0]), how)

    def version(self) -> str | None:
        return self._pointer()["version"]

    def batch(self) -> int | None:
        """The number of the last batch that was applied or refused."""
        return self._pointer()["batch"]

    def skip(self, batch: int) -> None:
        """Note a batch as done without a new version."""
        self._point({**self._pointer(), "batch": batch})

    def save(self, nodes: DataFrame, edges: DataFrame, batch: int | None = None) -> str:
        """Write a new version and move the pointer to it."""
        at = self._pointer()
        name = f"v{time.time_ns()}"
        nodes.write.parquet(f"{self.folder}/{name}/nodes")
        edges.write.parquet(f"{self.folder}/{name}/edges")
        older = ([at["version"]] if at["version"] else []) + at["older"]
        self._point({"version": name, "older": older[: self.keep], "batch": at["batch"] if batch is None else batch})
        for gone in older[self.keep :]:
            drop_path(self.spark, f"{self.folder}/{gone}")
        return name

    def load(self, version: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of a version, the current one by default."""
        v = version or self.version()
        if v is None:
            raise FileNotFoundError(f"no graph in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{v}/nodes"), self.spark.read.parquet(f"{self.folder}/{v}/edges")


def snippet_anchors(snippets: DataFrame, sources: DataFrame, within: int = 5) -> DataFrame:
    """``trace_id, symbol, anchored``: whether the first line of a snippet's code stands within its place.

    ``snippets`` has trace_id, symbol, code, file and line; the place is the
    given line and those behind it, ``within`` in all. A file without a text
    anchors nothing.
    """
    s = sources.where("source is not null").groupBy("path").agg(F.max_by("source", F.struct("mtime", "source")).alias("source")).select(F.col("path").alias("file"), F.split("source", r"\r?\n").alias("lines"))
    first = F.trim(F.split("code", r"\r?\n")[0])
    j = snippets.join(s, "file", "left").withColumns({"first": first, "place": F.slice("lines", F.greatest(F.lit(1), F.col("line")), within)})
    hit = F.exists("place", lambda x: F.instr(x, F.col("first")) > 0) & (F.col("first") != "")
    return j.select("trace_id", "symbol", F.coalesce(hit, F.lit(False)).alias("anchored"))


def trace_matches(trace_edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges of traces (``trace_id, source, target, kind``) with ``matched``: whether the extracted facts have them."""
    f = facts.select("source", "target", "kind").distinct().withColumn("matched", F.lit(True))
    return trace_edges.join(f, ["source", "target", "kind"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
