import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import checks as C
from loomgraph.operators import community as M
from loomgraph.operators import cycles as Y
from loomgraph.operators import graph as G
from loomgraph.operators import search as S
from loomgraph.operators import store as T
from loomgraph.operators import traverse as V

NODES = "id string, name string, kind string, location string, properties string, out_degree long, in_degree long, community_id int"
EDGES = "source string, target string, kind string, coupling_depth int, temporal_delay_sec double"


def graph(spark, pairs, kinds=None, nodes=None):
    ids = nodes or sorted({x for e in pairs for x in e[:2]})
    n = [(i, i.split(".")[-1], (kinds or {}).get(i, "symbol"), f"m/{i}.py:3", "{}", 0, 0, None) for i in ids]
    e = [(p[0], p[1], p[2] if len(p) > 2 else "calls", p[3] if len(p) > 3 else 0, None) for p in pairs]
    return G.canonical_nodes(spark.createDataFrame(n, NODES)), G.canonical_edges(spark.createDataFrame(e, EDGES))


def rows(df):
    return {tuple(r) for r in df.collect()}


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_chain(spark):
    n, e = graph(spark, [("a", "b"), ("b", "c")])
    adj = G.adjacency(e)
    assert rows(V.impact(adj, seed(spark, "a"), 2)) == {("a", 0), ("b", 1), ("c", 2)}
    assert rows(V.neighbors(adj, seed(spark, "b"), 1)) == {("a", 1, "b"), ("c", 1, "b")}
    assert V.shortest_path(adj, "a", "c").collect()[0]["path"] == ["a", "b", "c"]
    assert V.shortest_path(adj, "a", "zz").collect() == []
    assert V.shortest_path(adj, "a", "a").collect()[0]["length"] == 0
    assert rows(S.substring(n, "B").select("id")) == {("b",)}
    assert rows(G.degrees(n, e)) == {("a", 1, 0), ("b", 1, 1), ("c", 0, 1)}
    assert Y.components(e).collect() == []


def test_deep_walk_equals_unrolled(spark):
    _, e = graph(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)])
    assert len(V.layers(G.adjacency(e), seed(spark, "n00"), 9).collect()) == 10


def test_kinds_and_repeats(spark):
    _, e = graph(spark, [("a", "b", " CALLS"), ("a", "b", "calls", 3), ("a", "b", "odd"), ("a", None, "calls"), (None, "b", "reads")], nodes=["a", "b"])
    assert rows(e.select("source", "target", "kind", "coupling_depth")) == {("a", "b", "calls", 0)}


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_against_brute_force(spark, one_task):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)] + [("a", "b"), ("b", "a"), ("s", "s")]
    reach = {}
    for x in {p for e in pairs for p in e}:
        seen, todo = set(), [x]
        while todo:
            y = todo.pop()
            for s, t in pairs:
                if s == y and t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[x] = seen
    want = {(x, min(y for y in reach if y == x or y in reach[x] and x in reach[y])) for x in reach if any(y != x and y in reach[x] and x in reach[y] for y in reach)}
    _, e = graph(spark, pairs)
    assert rows(Y.components(e, one_task)) == want


def test_cycle_kinds(spark):
    n, e = graph(spark, [("a", "m", "writes"), ("m", "a", "reads"), ("x", "y"), ("y", "x")], {"m": "medium"})
    assert rows(Y.classify(n, Y.components(e))) == {("a", 2, "data_persistent"), ("x", 2, "pure_code")}


def test_fragile_star(spark):
    n, e = graph(spark, [("a", f"t{i}", "calls", 4) for i in range(10)] + [("b", "a", "calls", 1)])
    assert G.fragile(n, e, 1).collect()[0]["id"] == "a"


def test_threads_and_blindspots(spark):
    n, e = graph(spark, [("p", "c", "reads"), ("q", "c", "writes"), ("q", "d", "reads")], {"c": "medium", "d": "medium"})
    assert rows(C.thread_report(n, e)) == {("c", 2, False, "medium")}
    assert C.blindspots(0, 0, 0) == []
    assert [x[2] for x in C.blindspots(3, 10, 10)] == ["medium", "high", "high"]
    assert C.blindspots(0, 3, 2) == [("cycles", 3, "medium"), ("thread_conflicts", 2, "low")]


def test_names_resolve(spark):
    n, e = graph(spark, [("v.index", "User"), ("v.index", "models.Post"), ("v.index", "gone")], nodes=["v.index", "models.User", "auth.models.Post", "shop.models.Post"])
    assert rows(G.resolve_targets(n, e).select("target", "resolved")) == {("User", "models.User"), ("models.Post", "auth.models.Post")}
    assert rows(G.without_dangling(n, G.resolve(n, e)).select("target")) == {("models.User",), ("auth.models.Post",)}
    assert G.dangling(n, e).count() == 3


def test_both_ends_resolve(spark):
    n, e = graph(spark, [("fn_a", "fn_b"), ("fn_a", "nowhere")], nodes=["lib.fn_a", "lib.fn_b"])
    got = G.resolve(n, e)
    assert rows(got.select("source", "target")) == {("lib.fn_a", "lib.fn_b"), ("fn_a", "nowhere")}
    assert rows(G.without_dangling(n, got).select("source", "target")) == {("lib.fn_a", "lib.fn_b")}


def test_signals_of_a_changed_graph(spark):
    f = spark.createDataFrame([("m",), ("config.yaml",), ("001/0001_x.sql",), ("x.thrift",), ("src/dto/settings.js",)], "file string")
    n, before = graph(spark, [("a", "b"), ("b", "c")])
    _, after = graph(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    after = after.withColumn("coupling_depth", F.when(F.col("target") == "c", 4).otherwise(1))
    got = rows(C.signals(f, n, after, before).select("level", "reason", "file", "source", "target", "n"))
    assert {x for x in got if x[0] == 5} == {(5, "configuration", "config.yaml", "", "", 1), (5, "migration", "001/0001_x.sql", "", "", 1), (5, "serialization", "x.thrift", "", "", 1)}
    assert {x for x in got if x[0] != 5} == {(4, "temporal", "", "", "", 1), (3, "shared", "", "b", "c", 1), (2, "cycles", "", "", "", 1)}
    assert rows(C.signals(f.where("file = 'm'"), n, before, before)) == set()
    flows = spark.createDataFrame([("a.py", "f", "writes", ["x", "y"]), ("a.py", "g", "reads", ["x"]), ("a.py", "g", "triggers", ["start", "start"])], "file string, scope string, what string, names array<string>")
    assert {x[:2] + x[5:] for x in rows(C.signals(f.where("file = 'm'"), n, after, before, flows, cycles=False).select("level", "reason", "file", "source", "target", "n"))} == {(4, "temporal", 2), (3, "shared", 1)}


def test_policy(spark):
    n, e = graph(spark, [("a", "b", "imports"), ("a", "c", "imports"), ("a", "b", "calls")])
    rule = {"name": "r", "source": "m/a*", "target": "**/b.py"}
    assert rows(C.policy_violations(n, e, [rule])) == {("r", "m/a.py", "m/b.py", 1)}
    assert rows(C.policy_rules(n, e, [rule, {**rule, "name": "ok", "target": "z*"}])) == {("r", 1, False), ("ok", 0, True)}
    with pytest.raises(ValueError):
        C.pattern_to_regex("(?=x)")


def test_signals(spark):
    f = spark.createDataFrame([("db/migrations/1.py",), ("config.yaml",), ("src/a.py",), (None,)], "file string")
    got = rows(C.signals(f).select("file", "reason"))
    assert ("db/migrations/1.py", "migration") in got and ("config.yaml", "configuration") in got and not any(x[0] == "src/a.py" for x in got)
    assert C.constraints(C.signals(f), {}).collect()[0]["violations"] == C.signals(f).count()


def test_communities(spark):
    tri = [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n3", "n4"), ("n4", "n5"), ("n5", "n3"), ("n2", "n3")]
    n, e = graph(spark, tri, nodes=[f"n{i}" for i in range(6)] + ["lone"])
    got = M.communities(n, e).where("level = 0").cache()
    parts = {}
    for r in got.collect():
        parts.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, parts.values())) == [["lone"], ["n0", "n1", "n2"], ["n3", "n4", "n5"]]
    assert M.modularity(e, got).collect()[0][0] > 0.3
    n, e = graph(spark, [], nodes=list("abcde"))
    assert M.communities(n, e).select("community").distinct().count() == 5


def test_diff_and_merge(spark):
    a, _ = graph(spark, [], nodes=["a", "x"])
    b, _ = graph(spark, [], {"x": "class"}, nodes=["a", "b", "x"])
    assert rows(G.diff_nodes(a, b)) == {("b", "added"), ("x", "modified")}
    assert rows(G.diff_nodes(b, a)) == {("b", "removed"), ("x", "modified")}
    two = spark.createDataFrame([("i1", "f", "function", "p.py"), ("i2", "f", "function", "p.py"), ("i3", "g", "function", "p.py")], "id string, name string, kind string, location string")
    assert rows(G.merge_nodes(two).select("id", "merged")) == {("i1", 2), ("i3", 1)}


def test_store(spark, tmp_path):
    n, e = graph(spark, [("a", "b")])
    store = T.GraphStore(spark, f"file://{tmp_path}/g", keep=1)
    with pytest.raises(FileNotFoundError):
        store.load()
    first = store.save(n, e)
    n2, e2 = T.remove_nodes(n, e, seed(spark, "b"))
    store.save(n2, e2)
    assert [x.count() for x in store.load()] == [1, 0]
    assert [x.count() for x in store.load(first)] == [2, 1]
    assert rows(T.rename(n, "b", "z").select("id", "name")) == {("a", "a"), ("b", "z")}
    new = spark.createDataFrame([("a", "b", "calls", 4, 2.0), ("b", "a", "calls", 1, None)], EDGES)
    assert rows(T.upsert_edges(e, new)) == {("a", "b", "calls", 4, 2.0), ("b", "a", "calls", 1, None)}


def test_traces(spark):
    s = "id long, trace_id string, resource string, files_involved array<string>, created_at string, status string"
    old = spark.createDataFrame([(1, "t", "r", ["src/a.py"], "c0", "active"), (2, "u", "r", ["b.py"], "c1", "active")], s)
    new = spark.createDataFrame([(3, "t", "r", ["src/a.py"], "c9", "active")], s)
    saved = T.save_trace(old, new)
    assert rows(saved.select("trace_id", "created_at")) == {("t", "c0"), ("u", "c1")}
    changed = spark.createDataFrame([("/root/src/a.py",)], "path string")
    assert rows(T.stale_traces(saved, changed).select("trace_id", "status")) == {("t", "stale"), ("u", "active")}
    assert rows(T.latest_trace(saved).select("trace_id")) == {("t",)}
    assert T.drop_trace(saved, "t", hard=True).count() == 1


def test_search(spark):
    n, _ = graph(spark, [], nodes=["pkg.graph_store.load", "pkg.other"])
    assert rows(S.phrase(n, "graph store")) == {("pkg.graph_store.load", 2)}
    assert S.phrase(n, "!!").collect() == []
    assert S.question_names("how does DataRequest.task, fooBar and main.py work") [0] == ("how", "simple")
    assert ("DataRequest.task", "qualified") in S.question_names("see DataRequest.task")
    src = spark.createDataFrame([("a.py", "x\r\nTODO y\nz"), ("b.py", None), ("c.py", "")], "path string, source string")
    assert rows(S.grep(src, "todo")) == {("a.py", 2, "TODO y")}
    assert S.grep(src, "todo", context=1).count() == 3
