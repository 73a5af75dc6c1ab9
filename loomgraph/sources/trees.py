"""Source trees: discovery of files below a folder, and graph documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold nothing written by hand.
SKIPPED = (".git", "__pycache__", "node_modules", "venv", ".venv", "env", ".tox", ".mypy_cache", ".pytest_cache", ".hg", ".svn", "dist", "build", "target", ".eggs", "*.egg-info", "htmlcov", ".ruff_cache", ".next", ".nuxt", "out", ".angular", ".cache", "coverage", "vendored", "generated", "tests")
MAX_BYTES = 1 << 20

NODE_SCHEMA = "id string, name string, kind string, location string, properties string, out_degree long, in_degree long, position array<float>, community_id int"
EDGE_SCHEMA = "id string, source string, target string, kind string, coupling_depth int, cross_file boolean, temporal_delay_sec double, lsp_resolved boolean"


#: Levels below the root at which .gitignore files are looked for.
IGNORE_DEPTH = 12


def ignored_names(spark: SparkSession, root: str) -> list[str]:
    """Names of folders that .gitignore files name plainly (no comment, negation, glob or dot).

    Spark's readers pass over files whose names begin with a dot, so these few
    configuration files are read through the file system itself.
    """
    jvm, names = spark._jvm, set()
    for depth in range(IGNORE_DEPTH):
        pattern = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * depth + "/.gitignore")
        fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(pattern) or ():
            stream = fs.open(status.getPath())
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            for line in map(str.strip, text.splitlines()):
                last = line.rstrip("/").rpartition("/")[2]
                if last and line[0] not in "#!" and not any(c in line for c in "*?[") and "." not in last:
                    names.add(last)
    return sorted(names)


def discover(spark: SparkSession, root: str, extensions: list[str], skipped: tuple[str, ...] = SKIPPED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, ext, size, mtime, source`` of the files with these extensions below ``root``.

    Folders of ``skipped`` and those that a .gitignore names are left out, as
    are larger files. Text that is no UTF-8 has a null source. path is relative.
    """
    glob = "*.{" + ",".join(sorted({e.lower() for e in extensions} | {e.upper() for e in extensions})) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    rel = F.substring_index("path", base, -1)
    f = files.where(F.col("length") <= max_bytes).select(rel.alias("path"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).alias("source"))
    above = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return f.where(~F.arrays_overlap(above, F.array(*[F.lit(s) for s in (*skipped, *ignored_names(spark, root))])))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents ``{meta, nodes[], edges[]}``; rows that do not fit are left out."""
    doc = spark.read.schema(f"nodes array<struct<{_fields(NODE_SCHEMA)}>>, edges array<struct<{_fields(EDGE_SCHEMA)}>>").option("multiLine", True).json(path)
    n = doc.select(F.explode("nodes").alias("x")).select("x.*").where("id is not null")
    e = doc.select(F.explode("edges").alias("x")).select("x.*").where("source is not null and target is not null")
    return n, e


def _fields(schema: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (f.split(" ", 1) for f in schema.split(", ")))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as lines of JSON below ``path`` (folders nodes and edges), written in parallel."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def stale(sources: DataFrame, since) -> DataFrame:
    """Paths of sources that are newer than a stored graph."""
    return sources.where(F.col("mtime") > F.lit(since)).select("path")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, action`` between two listings of ``path, mtime``: created, modified or removed."""
    b, a = before.select("path", F.col("mtime").alias("was"), F.lit(True).alias("b")), after.select("path", F.col("mtime").alias("now"), F.lit(True).alias("a"))
    action = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return b.join(a, "path", "full_outer").select("path", action.alias("action")).where("action is not null")
