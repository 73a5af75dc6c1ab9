import json
from datetime import datetime

import pytest

from loomgraph.operators import extract as X
from loomgraph.operators import incremental as I
from loomgraph.operators.store import GraphStore
from loomgraph.sources import trees
from loomgraph.streaming import watch

PY = '''
import os
from .db import connect as c, Store
CONFIG = 1

class Base:
    def save(self): pass

class Job(Base):
    def run(self, bus):
        self.save()
        s = Store()
        s.put(CONFIG)
        bus.subscribe(handle)
        return os.getcwd()

def handle(x):
    global total
    total = x
    c(total)

@app.get("/items/{id}")
async def read(id):
    await fetch(id)
'''
JS = '''
import { a } from './util.js';
// call(me)
class View extends Panel { }
function load(x) { render(x); bus.on('x', handler); }
app.get('/user', load);
'''
T = datetime(2026, 1, 1)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_records(spark):
    src = spark.createDataFrame([("p/m.py", PY, T, 1), ("p/m.py", "old(", datetime(2025, 1, 1), 1), ("w/v.js", JS, T, 1), ("x/bad.py", "def (", T, 1), ("x/null.go", None, T, 1), ("x/a.unknown", "", T, 1), (None, "x", T, 1)], "path string, source string, mtime timestamp, id int")
    rec = X.records(src).cache()
    n = {r["id"]: r["kind"] for r in X.nodes(rec).collect()}
    assert n["p.m.Job.run"] == "function" and n["p.m.Base"] == "class" and n["p.m"] == "file" and n["w.v.load"] == "function"
    e = rows(X.edges(rec).select("source", "target", "kind"))
    assert {("p.m", "p.m.Job", "defines"), ("p.m.Job", "p.m.Base", "inherits"), ("p.m", "p.db.connect", "imports"), ("p.m.Job.run", "p.m.Job.save", "calls"), ("p.m.Job.run", "p.db.Store.put", "calls"), ("p.m.handle", "p.db.connect", "calls"), ("p.m.Job.run", "os.getcwd", "calls")} <= e
    assert {("w.v", "w.util", "imports"), ("w.v.View", "w.v.Panel", "inherits"), ("w.v.load", "render", "calls"), ("w.v.load", "handler", "calls")} <= e
    assert not any("me" == x[1] for x in e)
    assert {("fastapi", "GET", "/items/{id}", "read"), ("express", "GET", "/user", "load")} == rows(X.routes(rec).select("framework", "method", "url", "handler"))
    assert ("p.m.Job.run", "subscribe", "p.m.handle") in rows(X.callbacks(rec).select("source", "method", "handler"))
    assert rows(X.errors(rec).select("file")) == {("x/bad.py",), ("x/null.go",), ("x/a.unknown",)}
    shared = {r["var"]: (list(r["readers"]), list(r["writers"])) for r in X.shared_variables(rec).collect()}
    assert shared == {"total": (["handle"], ["handle"])}
    got = rows(X.inherited_methods(X.nodes(rec), X.edges(rec), X.resolved_calls(rec)).where("callee = 'p.m.Job.save'").select("found"))
    assert got == {("p.m.Base.save",)}
    assert ("/user" and "w.v.load") in {r["id"] for r in X.handlers(rec).collect()}
    assert X.records(src.where("false")).collect() == []


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("u.py", "urlpatterns = [path('a/', views.index), re_path(r'^b$', v)]", [("django", "ALL", "a/", "views.index"), ("django", "ALL", "^b$", "v")]),
        ("f.py", "@bp.route('/user', methods=['GET', 'POST'])\ndef user():\n    pass\n", [("flask", "GET,POST", "/user", "user")]),
        ("c.ts", "@Controller('cats')\nclass C {\n  @Get(':id')\n  one() {}\n}", [("nest", "GET", "/cats/:id", "one")]),
        ("m.go", 'r.GET("/x", h.List)\nr.Group("/v1")', [("gin", "GET", "/x", "h.List")]),
        ("A.java", '@GetMapping("/x")\npublic String x() {', [("spring", "GET", "/x", "x")]),
        ("r.rb", "get '/a', to: 'home#index'\nresources :posts\nnamespace :x", [("rails", "GET", "/a", "home#index"), ("rails", "RESOURCES", "posts", "PostsController")]),
        ("s.js", "app.use('/x', (q, r) => 1)", [("express", "USE", "/x", "<inline@1>")]),
    ],
)
def test_routes(path, text, want):
    lang = X.LANGUAGES[path.rpartition(".")[2]]
    assert [r[:4] for r in X.find_routes(path, text, lang)] == want


def test_file_diff(spark):
    s = "id string, name string, kind string, location string"
    old = spark.createDataFrame([("1", "n1", "function", "a.py:10"), ("2", "n2", "function", "a.py:20"), ("3", "old", "function", "b.py:10"), ("4", "same", "class", None)], s)
    new = spark.createDataFrame([("5", "n1", "function", "a.py:30"), ("6", "new", "function", "b.py:12"), ("7", "more", "function", "b.py:90")], s)
    assert rows(I.file_diff(old, new).where("file is not null").select("old_id", "new_id", "change")) == {("1", "5", "updated"), ("2", None, "removed"), ("3", "6", "updated"), (None, "7", "added")}


def test_discovery(spark, tmp_path):
    for p, text in {"a.py": "x", "sub/b.PY": "y", "tests/c.py": "z", "gone/d.py": "w", "e.txt": "v", ".gitignore": "# c\n/gone/\n*.log\n!x\n", "big.py": "x" * 100}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(text)
    (tmp_path / "raw.py").write_bytes(b"\xff\xfe")
    got = {r["path"]: r["source"] for r in trees.discover(spark, f"file://{tmp_path}", ["py"], max_bytes=50).collect()}
    assert got == {"a.py": "x", "sub/b.PY": "y", "raw.py": None}


def test_graph_document(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"meta": {}, "nodes": [{"id": "a", "name": "a"}, {"name": "no id"}], "edges": [{"id": "e", "source": "a", "target": "b", "kind": "calls"}, {"id": "f"}]}))
    n, e = trees.read_graph_json(spark, str(tmp_path / "g.json"))
    assert n.count() == 1 and rows(e.select("source", "target")) == {("a", "b")}


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([("p/m.py", "def f():\n    g()\ndef g(): pass\n", T), ("p/n.py", "from p.m import f\nf()\n", T)], "path string, source string, mtime timestamp")
    rec = X.records(src).cache()
    store = GraphStore(spark, f"file://{tmp_path}/store")
    from pyspark.sql import functions as F

    store.save(X.nodes(rec).withColumn("community_id", F.lit(7)), X.edges(rec))
    (tmp_path / "in").mkdir()
    change = {"path": "p/m.py", "action": "modified", "source": "def f():\n    h()\ndef h(): pass\n", "at": "2026-02-01T00:00:00"}
    (tmp_path / "in" / "1.json").write_text(json.dumps(change) + "\n" + json.dumps({**change, "action": "removed", "source": None, "at": "2026-01-31T00:00:00"}).replace("p/m.py", "p/zz.py"))
    log = []
    watch.follow(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/ck", log).awaitTermination()
    n, e = store.load()
    ids = {r["id"]: r["community_id"] for r in n.collect()}
    assert "p.m.h" in ids and "p.m.g" not in ids and ids["p.m.f"] == 7 and ids["p.n"] == 7
    assert ("p.n", "p.m.f", "calls") in rows(e.select("source", "target", "kind"))
    (tmp_path / "in" / "2.json").write_text(json.dumps({**change, "source": "def ("}))
    watch.follow(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/ck", log).awaitTermination()
    assert len(log) == 2 and "would be lost" in log[1][1]
    assert store.load()[1].count() == e.count()
