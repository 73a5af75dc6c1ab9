"""Cutting lineage with tables in the folder that all executors share.

A cut is a Parquet table below ``spark.checkpoint.dir``: it survives the loss
of any executor, is columnar and compressed (a fraction of what a checkpoint of
rows takes) and can be dropped as soon as nothing reads it any more.
"""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.applicationId not in _OWN:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[sc.applicationId] = "file://" + path
    return _OWN[sc.applicationId]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the cluster's file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """The tables that one operator call writes; ``drop`` removes them one by one."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a frame that reads it back."""
        self._n += 1
        path = f"{self.root}/t{self._n:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete every table of this workspace but these, which a result still reads."""
        stay = {getattr(t, "_loom_path", None) for t in tables}
        for k in range(1, self._n + 1):
            path = f"{self.root}/t{k:03d}"
            if path not in stay:
                drop_path(self.spark, path)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            path = getattr(t, "_loom_path", None)
            if path:
                drop_path(self.spark, path)


def numbered(ws: Workspace, ids: DataFrame) -> tuple[DataFrame, int]:
    """``id, no`` with numbers from 0 on without gaps, in the order of the rows of ``ids``; and how many there are."""
    kept = ws.keep(ids.select("id", F.monotonically_increasing_id().alias("no")))
    part = F.shiftright("no", 33)
    sizes = dict(kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect())
    starts = list(itertools.accumulate((sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)), initial=0))
    no = F.get(F.array(*[F.lit(k) for k in starts]), part.cast("int")) + F.col("no").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.select("id", no.cast("int").alias("no")), starts[-1]
