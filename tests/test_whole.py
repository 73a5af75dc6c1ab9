"""Registered queries do their whole job on small tables that a cut would show in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import graph_queries as Q
from loomgraph.operators import checks as C
from loomgraph.operators import community as M
from loomgraph.operators import graph as G
from loomgraph.plans.durable import Workspace

NODES = "id string, name string, kind string, location string, properties string, out_degree long, in_degree long, community_id int"
EDGES = "source string, target string, kind string, coupling_depth int, temporal_delay_sec double"


def tables(spark, folder, pairs, files=None, **more):
    ids = sorted({x for e in pairs for x in e[:2]})
    n = [(i, i, "symbol", (files or {}).get(i, f"m/{i}.py") + ":3", "{}", 0, 0, None) for i in ids]
    spark.createDataFrame(n, NODES).write.parquet(f"{folder}/nodes.parquet")
    spark.createDataFrame([(a, b, k, 0, None) for a, b, k in pairs], EDGES).write.parquet(f"{folder}/edges.parquet")
    for name, df in more.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_cycles_of_every_kind(spark, tmp_path):
    d = tables(spark, tmp_path, [("a", "b", "calls"), ("b", "a", "reads"), ("x", "y", "imports"), ("y", "z", "triggers"), ("z", "x", "defines"), ("p", "q", "imports"), ("q", "p", "imports"), ("q", "a", "calls")])
    assert rows(Q.cycles(spark, d)) == {("a", "a"), ("b", "a"), ("x", "x"), ("y", "x"), ("z", "x"), ("p", "p"), ("q", "p")}
    assert rows(Q.classify_cycles(spark, d).select("scc", "size")) == {("a", 2), ("x", 3), ("p", 2)}
    assert {r["name"]: r["n"] for r in Q.blindspots(spark, d).collect()}["cycles"] == 3
    assert Q.health(spark, d).first()["cycles"] == 3


def test_preflight_of_all_changed_files(spark, tmp_path):
    chain = [(f"n{i}", f"n{i + 1}", "calls") for i in range(8)]
    files = {"n0": "m/ends.py", "n8": "m/ends.py", "n4": "m/middle.py"}
    log = spark.createDataFrame([("file_modified", "m/ends.py"), ("file_modified", "m/middle.py"), ("file_modified", "none.py"), ("analyze", "m/n1.py")], "event_type string, file string")
    d = tables(spark, tmp_path, chain, files, timeline=log)
    assert rows(Q.preflight_files(spark, d).select("file", "direct_nodes", "total_impact", "blast")) == {("m/ends.py", 2, 8, 6), ("m/middle.py", 1, 7, 6)}


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_preflight_in_memory_equals_joins(spark, depth):
    d = "/root/testdata/sf0.001"
    n, e = Q._n(spark, d), Q._e(spark, d)
    files = n.where("file is not null").select("file").distinct()
    lone = spark.createDataFrame([("lone", "lone", "symbol", "x/lone.py:1", "{}", 0, 0, None)], NODES)
    n = n.unionByName(G.canonical_nodes(lone))
    files = files.unionByName(spark.createDataFrame([("x/lone.py",)], "file string"))
    got = rows(C.preflight(n, e, files, depth))
    assert len(got) > 40 and got == rows(C.preflight(n, e, files, depth, 0))


@pytest.mark.parametrize("hubs", [2, 16])
@pytest.mark.parametrize("depth", [0, 1, 2, 3, 5])
def test_balls_are_whole_and_walks_end_at_hubs(monkeypatch, hubs, depth):
    monkeypatch.setattr(C, "HUBS", hubs)
    rng, n = np.random.default_rng(depth), 300
    linked = np.eye(n, dtype=bool)
    for a, b in [*((k, int(rng.integers(0, k))) for k in range(1, n)), *((h, int(k)) for h in (0, 7, 50) for k in rng.integers(0, n, 80)), *rng.integers(0, n, (60, 2)).tolist()]:
        linked[a, b] = linked[b, a] = True
    want = np.linalg.matrix_power(linked.astype(float), depth) > 0
    np.fill_diagonal(linked, False)
    balls = C.Balls(np.nonzero(linked)[1].astype(np.int32), linked.sum(1), depth)
    assert (balls.sizes(np.arange(n)) == want.sum(1)).all()
    if depth == 3 and hubs == 16:
        monkeypatch.setattr(C, "WALKED", 10)
        assert (balls.sizes(np.arange(n)) == want.sum(1)).all()
        degree = linked.sum(1)
        through = degree + linked @ degree + linked @ (linked @ degree)
        assert balls.cost.mean() < through.mean() / 20


def test_balls_of_three_times_the_tables():
    """As many pairs as about 1 GB of tables has are walked in memory; by joins their balls filled the disk."""
    n = 2_200_000
    other = np.arange(3, n, dtype=np.int32)
    ends = np.concatenate([other % 3, other[:-1], np.full(3, 3, np.int32)]), np.concatenate([other, other[1:], np.arange(3, 6, dtype=np.int32) - 3])
    code = np.unique(np.concatenate([ends[0].astype(np.int64) * n + ends[1], ends[1].astype(np.int64) * n + ends[0]]))
    assert 4_000_000 < len(code) // 2 < C.PAIRS_IN_MEMORY
    near = (code % n).astype(np.int32)
    balls = C.Balls(near, np.bincount(code // n, minlength=n), 3)
    assert (balls.sizes(np.array([0, 1, 2, n // 2])) == n).all()


def test_communities_of_defines_edges(spark, tmp_path):
    d = tables(spark, tmp_path, [(a, b, "defines") for t in ("abc", "xyz") for a, b in zip(t, t[1:] + t[0])])
    assert rows(Q.communities(spark, d).where("level = 0").select("id", "community")) == {(i, t[0]) for t in ("abc", "xyz") for i in t}
    assert rows(Q.community_labels(spark, d).select("community", "size")) == {("a", 3), ("x", 3)}


def test_communities_until_one_is_left(spark, tmp_path, monkeypatch):
    def halved(ws, pairs, sweeps):
        assert sweeps == 100
        units = sorted({u for r in pairs.collect() for u in (r["a"], r["b"])})
        return spark.createDataFrame([(u, units[k // 2 * 2]) for k, u in enumerate(units)], "id string, community string")

    monkeypatch.setattr(M, "_level", halved)
    d = tables(spark, tmp_path, [(f"n{i:02d}", f"n{i + 1:02d}", "calls") for i in range(31)])
    got = rows(Q.communities(spark, d).select("level", "community"))
    assert [sum(level == k for level, _ in got) for k in range(6)] == [16, 8, 4, 2, 1, 0]


def test_communities_in_memory_equal_joins(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    n, e = Q._n(spark, d), Q._e(spark, d)
    e = e.unionByName(e.limit(1).withColumn("target", F.col("source")))
    got = rows(M.communities(n, e, sweeps=5, levels=2))
    assert len({c for level, _, c in got if level == 0}) < n.count() / 2
    monkeypatch.setattr(M, "LOOKED_AT", 1)
    again = rows(M.communities(n, e, sweeps=5, levels=2))
    monkeypatch.setattr(M, "PAIRS_IN_MEMORY", -1)
    assert got == again == rows(M.communities(n, e, sweeps=5, levels=2))


def test_sweeps_of_a_level_are_no_jobs(spark):
    pairs = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}", 1.0) for k in range(200)], "a string, b string, w double")
    group = "sweeps-of-a-level"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = M._level(Workspace(spark, "test"), pairs, 100).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 201 and 0 < jobs < 20


def test_labels_need_few_jobs(spark, tmp_path):
    d = tables(spark, tmp_path, [(a, b, "calls") for t in ("abcd", "wxyz") for a in t for b in t if a < b], {i: f"m/{t}.py" for t in ("abcd", "wxyz") for i in t})
    group = "labels"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = rows(Q.community_labels(spark, d).select("community", "size", "label"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {("a", 4, "abcd"), ("w", 4, "wxyz")} and 0 < jobs < 45


@pytest.mark.parametrize("in_memory", [8_000_000, -1])
@pytest.mark.parametrize("heavy", [1e9, 1e11])
def test_a_community_forms_whatever_share_it_has(spark, monkeypatch, in_memory, heavy):
    monkeypatch.setattr(M, "PAIRS_IN_MEMORY", in_memory)
    pairs = spark.createDataFrame([("a", "b", 1.0), ("c", "d", heavy)], "a string, b string, w double")
    assert rows(M._level(Workspace(spark, "test"), pairs, 100).select("id", "community")) == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}


def test_shortest_path_beyond_six_steps(spark, tmp_path):
    d = tables(spark, tmp_path, [(f"n{i}", f"n{i + 1}", "inherits") for i in range(9)])
    assert rows(Q.shortest_path_length(spark, d)) == {(9,)}
