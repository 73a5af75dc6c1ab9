from datetime import datetime

from loomgraph.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_id int, loaded_at timestamp, id string, name string, kind string, location string, out_degree long, in_degree long, properties string"


def day(n):
    return datetime(2026, 1, n)


def test_changes(spark):
    rows = [
        (1, day(1), "a", "n", "k", None, 1, 1, "x"), (1, day(1), "b", "n", "k", "l", 1, 1, ""), (1, day(1), "c", "n", "k", "l", 1, 1, ""),
        (1, day(1), "e", "ab", "c", None, None, None, ""),
        (4, day(2), "a", "n", "k", None, 1, 1, "y"), (4, day(2), "b", "n", "k", "l", 1, 9, ""), (4, day(9), "b", "n", "k", "l", 1, 1, ""), (4, None, "b", "n", "k", "l", 1, 7, ""),
        (4, day(2), "d", "n", "k", "l", 1, 1, ""), (4, day(2), "d", "n", "k", "l", 1, 1, ""), (4, day(2), "e", "a", "bc", None, None, None, ""),
        (9, day(3), "a", "n", "k", "", 1, 1, ""), (9, day(3), "b", "n", "k", "l", 1, 1, ""), (9, day(3), "d", "n", "k", "l", None, 1, ""), (9, day(3), "e", "a", "bc", None, None, None, ""),
        (None, day(3), "z", "n", "k", "l", 1, 1, ""), (9, day(3), None, "n", "k", "l", 1, 1, ""),
    ]
    got = {(r["snapshot_id"], r["id"], r["change_type"]) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(4, "c", "removed"), (4, "d", "added"), (4, "e", "changed"), (9, "a", "changed"), (9, "d", "changed")}


def test_one_or_no_snapshot(spark):
    one = spark.createDataFrame([(1, day(1), "a", "n", "k", "l", 1, 1, "")], SCHEMA)
    assert snapshot_changes(one).collect() == []
    assert snapshot_changes(one.where("false")).collect() == []
