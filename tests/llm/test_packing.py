from collections import defaultdict

import numpy as np
import pytest

from loomgraph.llm import packing as P


@pytest.mark.parametrize("capacity", [1, 7, 512, 8192])
def test_pack_fits(capacity):
    rng = np.random.default_rng(1)
    lengths = np.minimum(capacity, rng.geometric(8 / (capacity + 8), 3000) - 1)
    bins = P.pack(lengths, capacity)
    assert (bins >= 0).all()
    fill = np.bincount(bins, lengths)
    assert fill.max() <= capacity
    if capacity > 500:
        assert lengths.sum() / capacity / len(fill) > 0.9


def test_classes_hold_a_fixed_count():
    bins = P.pack(np.full(9, 250), 1000)
    assert sorted(np.bincount(bins)) == [1, 4, 4]
    assert len(P.pack(np.zeros(0, int), 10)) == 0


def test_documents(spark):
    sizes = spark.createDataFrame([(1, 0, "x"), (2, None, "x"), (3, 25, "x"), (4, 10, "x"), (5, 3, "x"), (5, 3, "x"), (6, 20, "x")], "doc_id long, n_tokens long, piece string")
    packs = spark.createDataFrame([("ten", 10), ("ten", 10), (None, 5), ("none", None), ("zero", 0)], "pack_name string, capacity long")
    rows = P.pack_sizes(sizes, packs).collect()
    assert {r["pack_name"] for r in rows} == {"ten"}
    assert sorted((r["piece"], r["start"], r["n_tokens"]) for r in rows if r["doc_id"] == 3) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert sorted((r["piece"], r["n_tokens"]) for r in rows if r["doc_id"] == 6) == [(0, 10), (1, 10)]
    fill = defaultdict(int)
    for r in rows:
        fill[r["container"]] += r["n_tokens"]
    assert max(fill.values()) <= 10 and sum(fill.values()) == 61
    assert len(rows) == 3 + 2 + 5
    assert P.pack_sizes(sizes.where("false"), packs).collect() == []
    assert P.pack_sizes(sizes, packs.where("false")).collect() == []


def test_fill_report(spark):
    packs = spark.createDataFrame([("a", 10), ("b", 4), ("none", None)], "pack_name string, capacity long")
    sizes = spark.createDataFrame([(1, 10), (2, 3), (3, 7), (4, 0), (5, 21)], "doc_id long, n_tokens long")
    got = {r["pack_name"]: r.asDict() for r in P.fill_report(P.pack_sizes(sizes.coalesce(1), packs), sizes, packs).collect()}
    assert set(got) == {"a", "b"}
    for r in got.values():
        assert (r["documents"], r["over_capacity"], r["needless_splits"], r["lost_tokens"]) == (5, 0, 0, 0) and 0 < r["fill"] <= 1
    bad = spark.createDataFrame([("a", 1, 0, 0, 6, 1), ("a", 1, 1, 6, 4, 2), ("a", 2, 0, 0, 3, 3), ("a", 3, 0, 0, 9, 3)], P.SCHEMA)
    r = {r["pack_name"]: r for r in P.fill_report(bad, sizes, packs).collect()}
    assert (r["a"]["over_capacity"], r["a"]["needless_splits"], r["a"]["lost_tokens"], r["b"]["containers"], r["b"]["fill"]) == (1, 1, 19, 0, None)
