from datetime import datetime

import pytest

from loomgraph.engine import Engine
from loomgraph.operators import store as T


def test_project(spark, tmp_path):
    for p, text in {
        "main.py": "from lib.db import connect\n\ndef run():\n    work()\n    return connect()\n\ndef work():\n    pass\n",
        "lib/db.py": "class Store:\n    pass\n\nclass Cache(Store):\n    def get(self):\n        return self.put()\n    def put(self):\n        return self.get()\n\ndef connect():\n    return Cache()\n",
        "web/app.js": "import { x } from './util.js';\nfunction load() { render(); }\nfunction render() {}\napp.get('/u', load);\n",
    }.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(text)
    log = spark.createDataFrame([(1, datetime(2026, 1, 1), "file_modified", "main.py", "s", "{}"), (2, datetime(2026, 1, 2), "analyze", "", "s", "x")], "id long, timestamp timestamp, event_type string, file string, summary string, properties string")
    g = Engine.analyze(spark, f"file://{tmp_path}", timeline=log)
    g.nodes, g.edges = g.nodes.cache(), g.edges.cache()
    ids = {r["id"] for r in g.nodes.collect()}
    assert {"main.run", "lib.db.Cache.get", "web.app.load"} <= ids
    kinds = {r["kind"] for r in g.edges.select("kind").distinct().collect()}
    assert {"calls", "imports", "defines", "inherits"} <= kinds
    assert "lib.db.connect" in {r["other"] for r in g.node("run").collect()}
    assert [r["path"] for r in g.path("main.run", "lib.db.Store").collect()][0][0] == "main.run"
    assert {r["scc"] for r in g.cycle().collect()} == {"lib.db.Cache.get"}
    assert g.history("main.run").collect()[0]["entry"] == 1
    assert [r["id"] for r in g.timeline(1).collect()] == [2]
    assert g.run_preflight(["main.py"]).collect()[0]["direct_nodes"] == 3
    assert g.search("cache get").first()["id"] == "lib.db.Cache.get"
    assert g.search("ender").first()["id"] == "web.app.render"
    assert "main.work" in {r["id"] for r in g.impact("main.run", 1).collect()}
    assert g.run_health().first()["cycles"] == 1
    assert g.policy_check([{"name": "r", "source": "main.py", "target": "lib/**", "edge_kinds": ["calls"]}])["rules"].first()["violations"] == 1
    x = g.explore(symbols=["run", "connect"], include_source=True)
    assert {r["id"] for r in x["nodes"].collect()} == {"main.run", "lib.db.connect"}
    assert x["flow"].first()["length"] == 1 and x["source"].count() == 2
    assert g.community("main.run").count() >= 1
    assert g.rename("work", "toil").count() == 1 and g.rename("work", "toil", dry_run=False).where("name = 'toil'").count() == 1
    later = Engine(spark, g.nodes.where("id <> 'main.work'"), g.edges, before=(g.nodes, g.edges))
    assert {(r["id"], r["change"]) for r in later.graph_diff()["nodes"].collect()} == {("main.work", "removed")}
    assert later.run_check(["main.py"])["new_cycles"].collect() == []
    assert g.call("status").first()["nodes_total"] == len(ids)
    with pytest.raises(KeyError):
        g.call("drop")
    with pytest.raises(ValueError):
        g.graph_diff()


def test_traces_against_sources(spark):
    src = spark.createDataFrame([("a.py", "x\n  def f():\n    pass\n", datetime(2026, 1, 1))], "path string, source string, mtime timestamp")
    snip = spark.createDataFrame([("t", "f", "def f():\n  y", "a.py", 2), ("t", "g", "def g():", "a.py", 1), ("t", "h", "def f():", "none.py", 1)], "trace_id string, symbol string, code string, file string, line int")
    assert {(r["symbol"], r["anchored"]) for r in T.snippet_anchors(snip, src).collect()} == {("f", True), ("g", False), ("h", False)}
    e = spark.createDataFrame([("t", "a", "b", "calls"), ("t", "a", "c", "calls")], "trace_id string, source string, target string, kind string")
    f = spark.createDataFrame([("a", "b", "calls")], "source string, target string, kind string")
    assert {(r["target"], r["matched"]) for r in T.trace_matches(e, f).collect()} == {("b", True), ("c", False)}
