import random
from collections import defaultdict

from loomgraph.operators import keyed as K

EDGES = "id string, source string, target string, kind string, key string, n long"


def brute(rows):
    out = defaultdict(set)
    for _, s, t, k, *_ in rows:
        if t is not None:
            out[t].add((s, None if k is None else k.strip(" ").lower()))
    return {t: len(v) for t, v in out.items()}


def made(spark, rows, parts=5):
    return spark.createDataFrame(rows, EDGES).repartition(parts)


def test_counts_with_a_hot_key_nulls_and_repeats(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        t = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "", f"t{rng.randrange(300)}"])
        rows.append((f"e{i}", rng.choice([None, "", f"s{rng.randrange(60)}"]), t, rng.choice(["calls", " Calls", "READS", None]), "clash", i))
    rows += [rows[7]] * 900  # one row again and again
    df = made(spark, rows)
    for chunk in (7, 1 << 16):
        got = {r["target"]: r["n_distinct"] for r in K.distinct_per_key(df, "target", ["source", K.edge_kind("kind")], chunk).collect()}
        assert got == brute(rows)
    n = {r["target"]: r["n_rows"] for r in K.in_degrees(df).collect()}
    assert sum(n.values()) == sum(r[2] is not None for r in rows)


def test_states_of_small_chunks_merge_across_partitions(spark):
    rows = [(str(i), f"s{i % 11}", "one", "calls", "", 0) for i in range(5000)]
    got = K.distinct_per_key(made(spark, rows, 8), "target", ["source", "kind"], 3).collect()
    assert [(r["target"], r["n_rows"], r["n_distinct"]) for r in got] == [("one", 5000, 11)]


def test_results_come_through_the_offsets(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    rng = random.Random(2)
    rows = [(str(i), f"s{rng.randrange(400)}", rng.choice(["one", "one", "two"]), "calls", "", 0) for i in range(6000)]
    want = brute(rows)
    got = {r["target"]: r["n_distinct"] for r in K.distinct_per_key(made(spark, rows, 8), "target", ["source", K.edge_kind("kind")], 50, 4).collect()}
    assert got == want
    whole = K._states
    monkeypatch.setattr(K, "_states", lambda offsets, n: whole(type("Shifted", (), {"value": {k: (0, b) for k, (_, b) in offsets.value.items()}})(), n))
    lost = {r["target"]: r["n_distinct"] for r in K.distinct_per_key(made(spark, rows, 8), "target", ["source", K.edge_kind("kind")], 50, 4).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert lost != want


def test_states_of_a_key_are_one_per_chunk(spark):
    df = made(spark, [(str(i), f"s{i}", "one", "calls", "", 0) for i in range(1000)], 3)
    seen = []
    whole = K._merged
    try:
        K._merged = lambda states, *by: seen.append(whole(states, *by)) or seen[-1]
        K.distinct_per_key(df, "target", ["source"], 10, 8).collect()
    finally:
        K._merged = whole
    assert len(seen) == 4  # 100 chunks, then 13, 2 and 1 groups of at most eight


def test_empty(spark):
    assert K.in_degrees(made(spark, [])).collect() == []


def test_stale_degrees(spark):
    nodes = spark.createDataFrame([("a", 2), ("a", 2), ("b", 0), ("c", 5), ("d", None), (None, 1), ("e", 0)], "id string, in_degree long")
    edges = made(spark, [("1", "x", "a", "calls", "", 0), ("2", "x", "a", " CALLS ", "", 0), ("3", "y", "a", "calls", "", 0), ("4", "x", "e", "reads", "", 0)])
    got = {r["id"]: (r["stored"], r["counted"]) for r in K.stale_in_degrees(nodes, edges).collect()}
    assert got == {"c": (5, 0), "e": (0, 1)}
