"""Per-key results when a few keys hold most of the rows (problem 1).

Exact offset chunking. The rows are put into one total order (key, item,
arrival) by range partitioning, which cuts even a single key, or a single
repeated row, into equal parts. Keys are counted per partition; prefix sums of
the counts give the offset of each key's rows in each partition, and with it
the exact number of every row within its key. A key is worked on in chunks of
equal size, cut by these numbers; a chunk leaves a small ordered state (its runs
of equal items, the first and the last item), and states that follow each other
are merged as a tree, a bounded number at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import edge_kind, tagged
from loomgraph.plans.durable import Workspace

#: Rows of one key that make up a chunk, at least; more when there would be too many chunks for one broadcast.
CHUNK_ROWS = 1 << 16
MAX_CHUNKS = 1_000_000
#: Neighbouring states of one key that are merged at a time.
FAN_IN = 1024
#: monotonically_increasing_id keeps the row's place in the partition in so many bits.
_PLACE_BITS = 33

_STATE = "key string, large boolean, chunk long, seq long, runs long, rows long, first string, last string"


def _states(offsets, chunk_rows: int):
    """A function over Arrow batches: one state for each chunk of each key that a task holds a part of."""

    def run(batches):
        known = offsets.value
        held = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            seq = b.column("seq").to_numpy(zero_copy_only=False)
            key, item = b.column("key"), b.column("item")
            cut = np.ones(n, bool)
            fresh = np.ones(n, bool)
            if n > 1:
                cut[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                cut[1:] |= np.diff(seq) != 1
                fresh[1:] = pc.not_equal(item.slice(1), item.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], n)
            chunk, large = np.zeros(n, np.int64), np.zeros(n, bool)
            parts = (seq[starts] >> _PLACE_BITS).tolist()
            for s, e, p, k in zip(starts.tolist(), ends.tolist(), parts, key.take(pa.array(starts)).to_pylist()):
                at = known.get((p, k))
                if at is not None:
                    # The number of a row within its key: what lies before this partition, and its place in it.
                    chunk[s:e] = (at[0] + seq[s:e] - at[1]) // chunk_rows
                    large[s:e] = True
            cut[1:] |= chunk[1:] != chunk[:-1]
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], n)
            fresh |= cut
            runs = np.add.reduceat(fresh.astype(np.int64), starts)
            rows = ends - starts
            seqs, chunks, larges = seq[starts].copy(), chunk[starts], large[starts]
            keys, firsts, lasts = key.take(pa.array(starts)), item.take(pa.array(starts)), item.take(pa.array(ends - 1))
            if held is not None:
                same = held["key"] == keys[0].as_py() and held["chunk"] == chunks[0] and held["next"] == seqs[0]
                if same:
                    runs[0] += held["runs"] - (held["last"] == firsts[0].as_py())
                    rows[0] += held["rows"]
                    seqs[0] = held["seq"]
                    firsts = pa.concat_arrays([pa.array([held["first"]], pa.string()), firsts.slice(1).cast(pa.string())])
                else:
                    yield one(held)
            m = len(starts) - 1
            held = {"key": keys[m].as_py(), "large": bool(larges[m]), "chunk": int(chunks[m]), "seq": int(seqs[m]), "runs": int(runs[m]), "rows": int(rows[m]), "first": firsts[m].as_py(), "last": lasts[m].as_py(), "next": int(seq[-1]) + 1}
            if m:
                yield pa.RecordBatch.from_arrays([keys.slice(0, m).cast(pa.string()), pa.array(larges[:m]), pa.array(chunks[:m]), pa.array(seqs[:m]), pa.array(runs[:m]), pa.array(rows[:m]), firsts.slice(0, m).cast(pa.string()), lasts.slice(0, m).cast(pa.string())], names=_NAMES)
        if held is not None:
            yield one(held)

    def one(x):
        return pa.RecordBatch.from_arrays([pa.array([x[c]], t) for c, t in zip(_NAMES, (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=_NAMES)

    return run


_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _merged(states: DataFrame, *by: Column) -> DataFrame:
    """States of the same key and ``by`` merged in order of chunk and sequence: equal items on both sides of a border are one run."""
    row = F.struct("chunk", "seq", "runs", "rows", "first", "last")
    grouped = states.groupBy("key", "large", *by).agg(F.array_sort(F.collect_list(row)).alias("s"))
    n = F.size("s")
    border = F.zip_with(F.slice("s", 1, n - 1), F.slice("s", 2, n - 1), lambda a, b: F.when(a["last"] == b["first"], 1).otherwise(0).cast("long"))
    zero = F.lit(0).cast("long")
    add = lambda x, f=lambda v: v: F.aggregate(x, zero, lambda t, v: t + f(v))
    first = F.col("s")[0]
    return grouped.select(
        "key", "large", first["chunk"].alias("chunk"), first["seq"].alias("seq"), (add("s", lambda v: v["runs"]) - add(border)).alias("runs"), add("s", lambda v: v["rows"]).alias("rows"), first["first"].alias("first"), F.element_at("s", -1)["last"].alias("last")
    )


def distinct_per_key(rows: DataFrame, key: str, items: list[str | Column], chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """For each value of ``key``: ``n_rows`` and the exact number ``n_distinct`` of its item tuples.

    No task gets more than its share of the rows, whatever the distribution of
    the keys, and none merges more than ``fan_in`` chunks. Rows whose key is
    null are left out; a null among the items is a value of its own. Rows may
    repeat. An empty input gives an empty result, and columns of the input that
    are not named are not read. The order of the result is undefined.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "keyed")
    item = F.concat_ws("\x00", *[tagged(i) for i in items]) if len(items) > 1 else tagged(items[0])
    flat = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), item.alias("item"), F.monotonically_increasing_id().alias("arrival"))
    order = ["key", "item", "arrival"]
    ordered = flat.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ws.keep(ordered.select("key", "item", F.monotonically_increasing_id().alias("seq")))

    # Count keys per partition; prefix sums over the partitions give offsets.
    counts = ws.keep(ordered.groupBy(F.shiftright("seq", _PLACE_BITS).alias("part"), "key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("begin")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    chunk_rows = max(chunk_rows, -(-total // MAX_CHUNKS))
    by_key = Window.partitionBy("key")
    before = by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Ranges follow each other, so a partition shares at most its first and its last key with others, and there are
    # at most MAX_CHUNKS keys of more than one chunk: that is all that comes to the driver.
    spread = counts.withColumns({"offset": F.coalesce(F.sum("n").over(before), F.lit(0)), "parts": F.count(F.lit(1)).over(by_key), "all": F.sum("n").over(by_key)}).where((F.col("parts") > 1) | (F.col("all") > chunk_rows))
    found = spread.select("part", "key", "offset", "begin", "all").collect()
    offsets = spark.sparkContext.broadcast({(r["part"], r["key"]): (r["offset"], r["begin"]) for r in found})

    states = _merged(ordered.select("seq", "key", "item").mapInArrow(_states(offsets, chunk_rows), _STATE), F.col("chunk").alias("group"))
    chunks = max((-(-r["all"] // chunk_rows) for r in found), default=1)
    states = ws.keep(states)
    if chunks > 1:
        # Keys of one chunk are done; the states of the others are merged as a tree.
        large = states.where("large")
        width = 1
        while width < chunks:
            width *= fan_in
            large = _merged(large, F.floor(F.col("chunk") / width).alias("group"))
        states = states.where("not large").unionByName(large)
    ws.drop(ordered, counts)
    return states.select(F.col("key").alias(key), F.col("rows").alias("n_rows"), F.col("runs").alias("n_distinct"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """``target, n_rows, n_distinct``: distinct incoming (source, kind) pairs of every target."""
    return distinct_per_key(edges, "target", [F.col("source"), edge_kind("kind")])


def stale_in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, stored, counted`` of nodes whose stored in_degree is not null and not the counted one.

    Nodes delivered twice count once; a node that no edge points to has 0; a
    null id is no node.
    """
    stored = nodes.where("id is not null and in_degree is not null").groupBy("id").agg(F.max("in_degree").alias("stored"))
    counted = in_degrees(edges).select(F.col("target").alias("id"), F.col("n_distinct").alias("counted"))
    both = stored.join(counted, "id", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return both.where("stored <> counted")
