import random

from loomgraph.operators import hierarchy as H


def brute(parent):
    out = {}
    for x in parent:
        path, seen = [x], {x}
        while parent[path[-1]] is not None:
            p = parent[path[-1]]
            if p in seen:
                path = None
                break
            seen.add(p)
            path.append(p)
        out[x] = ("", -1, []) if path is None else (path[-1], len(path) - 1, path[::-1])
    return out


def check(spark, parent, every):
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    got = {r["id"]: (r["root"], r["depth"], list(r["path"])) for r in H.hierarchy(df, every, paths=True).collect()}
    assert got == brute(parent)
    assert {r["id"]: (r["root"], r["depth"]) for r in H.hierarchy(df, every).collect()} == {k: v[:2] for k, v in brute(parent).items()}


def test_random_forests_with_circles(spark):
    rng = random.Random(3)
    parent = {}
    for i in range(300):
        parent[f"n{i}"] = rng.choice([None, f"n{rng.randrange(300)}", f"n{max(0, i - 1)}", f"n{i // 2}"])
    parent |= {f"c{i}": f"c{(i + 1) % 40}" for i in range(40)} | {"self": "self", "below": "self"}
    check(spark, parent, 8)
    check(spark, parent, 10**6)  # no splitters: circles are found without them


def test_long_chain_and_star(spark):
    parent = {"r": None} | {f"x{i}": "r" if i == 0 else f"x{i - 1}" for i in range(700)} | {f"s{i}": "r" for i in range(500)}
    check(spark, parent, 8)


def test_containment_and_descendants(spark):
    rows = [("a", "b", " Defines"), ("a", "b", "defines"), ("b", "c", "DEFINES"), ("c", None, "defines"), (None, "d", "defines"), ("q", "a", "calls"), ("z", "z", "defines")]
    edges = spark.createDataFrame(rows, "source string, target string, kind string")
    paths = H.hierarchy(H.containment(edges), paths=True).cache()
    assert {(r["id"], r["root"], r["depth"]) for r in paths.collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("z", "", -1)}
    assert {tuple(r) for r in H.descendants(paths).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert H.hierarchy(H.containment(edges.where("false"))).collect() == []


def test_a_very_deep_chain_keeps_small_rows(spark, monkeypatch):
    n = 50_000
    kept = []
    keep = H.Workspace.keep
    monkeypatch.setattr(H.Workspace, "keep", lambda ws, df: kept.append(keep(ws, df)) or kept[-1])
    links = spark.range(n).selectExpr("cast(id as string) as id", "case when id > 0 then cast(id - 1 as string) end as parent")
    got = H.hierarchy(links)
    assert got.where("root <> '0' or depth <> cast(id as int)").isEmpty() and got.count() == n
    assert all(f.dataType.simpleString() in ("string", "bigint", "int", "boolean") for df in kept for f in df.schema.fields)
