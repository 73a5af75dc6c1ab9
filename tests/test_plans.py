import pytest
from pyspark.sql import functions as F

from loomgraph.functions import columns as C
from loomgraph.plans.durable import Workspace, shared_dir
from loomgraph.plans.skew import lookup_join


def test_lookup_of_hot_keys(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"))
    unique = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v")).unionByName(spark.sql("select 'hot' as key, -1L as v"))
    for how in ("left", "inner"):
        a = lookup_join(rows, unique, "key", how).select("id", "v").exceptAll(rows.join(unique, "key", how).select("id", "v"))
        assert a.isEmpty()
    assert lookup_join(rows, unique, "key").count() == 40_000
    assert lookup_join(rows.where("false"), unique, "key").count() == 0


def test_workspace(spark):
    ws = Workspace(spark, "t")
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark).startswith("file://")
    t = ws.keep(spark.range(3))
    assert t.count() == 3
    ws.drop(t, None)
    with pytest.raises(Exception):
        spark.read.parquet(t._loom_path).count()


def test_columns(spark):
    df = spark.createDataFrame([("a\\b.py:3:4",), ("c.py:9",), ("d.py",), (None,), ("C:\\x.py",)], "location string")
    got = [tuple(r) for r in df.select(C.location_file("location"), C.location_line("location")).collect()]
    assert got == [("a/b.py", 3), ("c.py", 9), ("d.py", None), (None, None), ("C:/x.py", None)]
    h = spark.sql("select * from values ('ab', 'c'), ('a', 'bc'), (null, 'c'), ('', 'c'), ('n', 'c') as t(x, y)").select(C.row_hash("x", "y").alias("h"))
    assert h.distinct().count() == 5
