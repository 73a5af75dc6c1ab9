"""Communities by modularity, level by level.

A half of the nodes (by a hash of id and sweep, so another half each time) look at their
neighbours' communities at the same time and move to the one of the largest
gain; ties go to the least community. Every sweep is a fixed number of joins
and aggregates over the edges; a lone node moves to another lone node only
downwards, so two of them never swap.

Gains are compared as whole numbers: (2m)^2 / 2 times the gain in modularity.
So no order of sums and no rounding decides. Up to ``PAIRS_IN_MEMORY`` pairs one task
has the graph as numbers and makes all sweeps of a level; beyond it they are
joins, with the same result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.durable import Workspace, numbered

#: Sweeps of a level at most, as in the reference.
SWEEPS = 100
#: A level ends when three sweeps in a row move no more than this share of the nodes: none.
SETTLED = 0.0
#: Pairs up to which one task makes the sweeps of a level.
PAIRS_IN_MEMORY = 8_000_000
#: Ends of edges up to which products of two strengths fit into 64 bits.
ENDS_IN_LONG = 3_000_000_000
#: Neighbours that a sweep in memory looks at together.
LOOKED_AT = 1_000_000


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """``a, b, w`` with a <= b: how many edges run between two nodes, in either direction."""
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _level(ws: Workspace, pairs: DataFrame, sweeps: int) -> DataFrame:
    """``id, community`` of one round of local moving over ``a, b, w``."""
    n, ends = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(2 * F.col("w")), F.lit(0)).cast("long")).first()
    if n <= PAIRS_IN_MEMORY and ends <= ENDS_IN_LONG:
        return _level_in_memory(ws, pairs, sweeps)
    return _level_by_joins(ws, pairs, sweeps, ends)


def _level_in_memory(ws: Workspace, pairs: DataFrame, sweeps: int) -> DataFrame:
    numbers, n = numbered(ws, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().orderBy("id"))
    no = lambda end, name: numbers.select(F.col("id").alias(end), F.col("no").alias(name))
    coded = pairs.join(no("a", "x"), "a").join(no("b", "y"), "b").select("x", "y", F.col("w").cast("long").alias("w"))
    # A node comes as a row without y, with the hash of its id.
    rows = coded.unionByName(numbers.select(F.col("no").alias("x"), F.lit(None).cast("int").alias("y"), F.xxhash64("id").alias("w")))

    def run(batches):
        cols: list = [[], [], []]
        hashes = np.zeros(n, np.uint64)
        for b in batches:
            x, y, w = b.columns
            node = y.is_null().to_numpy(zero_copy_only=False)
            x, w = x.to_numpy(), w.to_numpy()
            hashes[x[node]] = w[node].view(np.uint64)
            for c, v in zip(cols, (x[~node], y.drop_null().to_numpy(), w[~node])):
                c.append(v)
        x, y, w = (np.concatenate([np.empty(0, t), *c]) for c, t in zip(cols, (np.int32, np.int32, np.int64)))
        cols.clear()
        found = _moved(x, y, w, hashes, sweeps)
        for k in range(0, n, 100_000):
            part = found[k : k + 100_000].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array(part)], names=["no", "to"])

    found = ws.keep(rows.repartition(1).mapInArrow(run, "no int, to int"))
    return ws.keep(found.join(no("id", "no"), "no").join(no("community", "to"), "to").select("id", "community"))


def _turns(hashes: np.ndarray, sweep: int) -> np.ndarray:
    """Whose turn it is: those with an even xxhash64(id, sweep), from the hashes of the ids."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    u = np.uint64
    with np.errstate(over="ignore"):
        h = (hashes + p5 + u(4)) ^ (u(sweep) * p1)
        h = ((h << u(23)) | (h >> u(41))) * p2 + p3
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
    return ((h ^ (h >> u(32))) & u(1)) == 0


def _moved(x: np.ndarray, y: np.ndarray, w: np.ndarray, hashes: np.ndarray, sweeps: int) -> np.ndarray:
    """The community of each node by local moving over the pairs ``x, y, w``; numbers are in the order of the ids."""
    n, ends = len(hashes), int(2 * w.sum())
    k = np.zeros(n, np.int64)
    np.add.at(k, x, w)
    np.add.at(k, y, w)
    link = x != y
    x, y, w = x[link], y[link], w[link]
    bits = int(w.max(initial=0)).bit_length()
    packed = bits + 2 * n.bit_length() < 63  # a weight fits behind node and community
    head = np.concatenate([x, y])
    order = np.argsort(head, kind="stable")
    head, near, w = head[order], np.concatenate([y, x])[order], np.concatenate([w, w])[order]
    del x, y, link, order
    begin = np.searchsorted(head, np.arange(n + 1))
    blocks, at = [0], 0
    while at < n:
        at = max(at + 1, int(np.searchsorted(begin, begin[at] + LOOKED_AT, "right")) - 1)
        blocks.append(at)
    own, quiet = np.arange(n), 0
    for sweep in range(sweeps):
        turn = _turns(hashes, sweep)
        total = np.zeros(n, np.int64)
        np.add.at(total, own, k)
        size = np.bincount(own, minlength=n)
        base = -k * (total[own] - k)
        new = own.copy()
        for lo, hi in zip(blocks, blocks[1:]):
            i = begin[lo] + np.flatnonzero(turn[head[begin[lo] : begin[hi]]])
            if not len(i):
                continue
            key = head[i].astype(np.int64) * n + own[near[i]]
            if packed:
                key = np.sort((key << bits) | w[i])
                weight, key = key & ((1 << bits) - 1), key >> bits
            else:
                place = np.argsort(key)
                weight, key = w[i][place], key[place]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            inside = np.add.reduceat(weight, first)
            who, to = np.divmod(key[first], n)
            here = own[who]
            stay = to == here
            gain = ends * inside - k[who] * (total[to] - np.where(stay, k[who], 0))
            base[who[stay]] = gain[stay]
            free = ~stay & ~((size[here] == 1) & (size[to] == 1) & (to > here)) & (gain > base[who])
            who, to, gain = who[free], to[free], gain[free]
            if len(who):
                first = np.flatnonzero(np.diff(who, prepend=-1))
                best = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, first), np.diff(first, append=len(who))))
                best = best[np.diff(who[best], prepend=-1) > 0]  # the least community of the largest gain
                new[who[best]] = to[best]
        moved = np.count_nonzero(new != own)
        own = new
        quiet = quiet + 1 if moved <= SETTLED * n else 0
        if quiet == 3:
            break
    return own


def _level_by_joins(ws: Workspace, pairs: DataFrame, sweeps: int, ends: int) -> DataFrame:
    whole = "long" if ends <= ENDS_IN_LONG else "decimal(38,0)"
    pairs = pairs.select("a", "b", F.col("w").cast(whole).alias("w"))
    both = ws.keep(pairs.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("near"), "w").unionByName(pairs.where("a <> b").select(F.col("b").alias("id"), F.col("a").alias("near"), "w")))
    loops = pairs.where("a = b").select(F.col("a").alias("id"), (2 * F.col("w")).cast(whole).alias("w"))
    strength = both.select("id", "w").unionByName(loops).groupBy("id").agg(F.sum("w").cast(whole).alias("k"))
    state = ws.keep(strength.select("id", "k", F.col("id").alias("community")))
    quiet = 0
    for sweep in range(sweeps):
        totals = state.groupBy("community").agg(F.sum("k").cast(whole).alias("total"), F.count(F.lit(1)).alias("size"))
        into = both.join(state.select(F.col("id").alias("near"), "community"), "near").groupBy("id", "community").agg(F.sum("w").cast(whole).alias("inside"))
        turn = F.pmod(F.xxhash64("id", F.lit(sweep)), F.lit(2)) == 0
        mine = state.where(turn).select("id", "k", F.col("community").alias("own"))
        offers = mine.join(into, "id").join(totals, "community")
        others = F.when(F.col("community") == F.col("own"), F.col("total") - F.col("k")).otherwise(F.col("total"))
        gain = F.lit(ends).cast(whole) * F.col("inside") - F.col("k") * others
        stay = totals.select(F.col("community").alias("own"), F.col("total").alias("own_total"), F.col("size").alias("own_size"))
        offers = offers.join(stay, "own").select("id", "k", "own", "community", "size", "own_size", "own_total", gain.alias("gain"))
        base = F.coalesce(F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))), -F.first("k") * (F.first("own_total") - F.first("k")))
        free = (F.col("community") != F.col("own")) & ~((F.col("own_size") == 1) & (F.col("size") == 1) & (F.col("community") > F.col("own")))
        top = F.max(F.when(free, F.col("gain")))
        best = offers.groupBy("id").agg(base.alias("base"), top.alias("top"))
        pick = offers.where(free).join(best, "id").where((F.col("gain") == F.col("top")) & (F.col("top") > F.col("base"))).groupBy("id").agg(F.min("community").alias("new"))
        new = ws.keep(state.join(pick, "id", "left").select("id", "k", F.coalesce("new", "community").alias("community"), F.col("new").isNotNull().alias("moved")))
        ws.drop(state)
        state = new.select("id", "k", "community")
        state._loom_path = new._loom_path
        n, moved = new.agg(F.count(F.lit(1)), F.sum(F.col("moved").cast("int"))).first()
        quiet = quiet + 1 if moved <= SETTLED * n else 0
        if quiet == 3:
            break
    return ws.keep(state.select("id", "community"))


def communities(nodes: DataFrame, edges: DataFrame, sweeps: int = SWEEPS, levels: int | None = None) -> DataFrame:
    """``level, id, community``: the communities of every node on each level, the finest being 0.

    A community is named by the least id of its members. A node without edges
    is one of its own. Levels end when nothing merges or one community is left, or after
    ``levels`` if given. An empty graph has none.
    """
    ws = Workspace(edges.sparkSession, "community")
    inside = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    pairs = ws.keep(weighted_pairs(inside))
    current = ws.keep(nodes.select("id", F.col("id").alias("unit")))
    out = None
    for level in itertools.count() if levels is None else range(levels):
        moved = _level(ws, pairs, sweeps)
        joined = current.join(moved.select(F.col("id").alias("unit"), "community"), "unit", "left").select("id", F.coalesce("community", "unit").alias("raw"))
        names = joined.groupBy("raw").agg(F.min("id").alias("unit"))
        new = ws.keep(joined.join(names, "raw").select("id", "unit"))
        left = new.select("unit").distinct().count()
        fewer = left < current.select("unit").distinct().count()
        if not fewer and out is not None:
            break
        rows = new.select(F.lit(level).alias("level"), "id", F.col("unit").alias("community"))
        out = rows if out is None else out.unionByName(rows)
        if not fewer or left == 1:
            break
        to = current.select("unit", "id").join(new.select("id", F.col("unit").alias("to")), "id").select(F.col("unit").alias("u"), "to").distinct()
        pairs = ws.keep(
            pairs.join(to.select(F.col("u").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("u").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"))
        )
        current = new
    return out


def modularity(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row ``modularity`` of ``id, community`` over the edges, taken as undirected."""
    pairs = weighted_pairs(edges)
    a = assigned.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    b = assigned.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    e = pairs.join(a, "a").join(b, "b")
    ends = e.select(F.explode(F.array("ca", "cb")).alias("community"), "w").groupBy("community").agg(F.sum("w").alias("k"))
    inside = e.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("m"))
    squares = ends.agg(F.sum(F.col("k") * F.col("k")).alias("s"))
    return inside.crossJoin(squares).select((F.col("inside") / F.col("m") - F.col("s") / (4 * F.col("m") * F.col("m"))).alias("modularity"))  # single rows


def parents(levels: DataFrame) -> DataFrame:
    """``level, community, parent``: links from each community to the one that holds it on the next level."""
    up = levels.select((F.col("level") - 1).alias("level"), "id", F.col("community").alias("parent"))
    return levels.join(up, ["level", "id"]).select("level", "community", "parent").distinct()


def labels(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """``community, size, label``: the file stem that most members share, ties by name."""
    stem = F.coalesce(F.regexp_extract("file", r"([^/.]+)[^/]*$", 1), F.lit(""))
    n = assigned.join(nodes.select("id", stem.alias("label")), "id")
    counts = n.groupBy("community", "label").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("community")
    ranked = counts.withColumns({"r": F.row_number().over(w.orderBy(F.desc("k"), "label")), "size": F.sum("k").over(w)})
    return ranked.where("r = 1").select("community", "size", "label")
