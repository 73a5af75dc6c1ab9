"""Rules, signals, risks and scores over a graph."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import DATA, TEMPORAL
from loomgraph.operators.graph import adjacency, degrees, with_ends
from loomgraph.operators.traverse import layers
from loomgraph.plans.durable import Workspace, numbered

# Paths of migrations, of formats that others read, and of configuration.
MIGRATION = (r"migrations?/", r"alembic/", r"\b\d{4,}_.*\.(py|sql)$", r"\.sql$", r".*schema.*\.(py|sql)$", r"\bschema\.sql\b", r"\bmigrate\b.*\.(py|sql)$")
SERIALIZATION = (r"\.proto$", r"\.fbs$", r"\.avsc$", r"\.thrift$", r"\.capnp$")
CONFIGURATION = (r"\.yaml$", r"\.yml$", r"\.toml$", r"\.json$", r"\.ini$", r"\.cfg$", r"\.env$", r"\.env\.", r"settings\.py$", r"config\.py$", r"\.conf$")
#: Signal levels that are violations besides 5, which always is.
DEFAULT_ROUTING = {4: True, 3: False, 2: False}
#: Linked pairs up to which preflight sends the graph to every task.
PAIRS_IN_MEMORY = 16_000_000
#: Nodes at which its walks end; as many as a set of 16 bits holds.
HUBS = 16
#: Neighbours that walks look at together.
WALKED = 1_000_000


def pattern_to_regex(pattern: str) -> str:
    """A rule's path pattern as a regular expression.

    Text with any of ``^ $ [ ( \\ + {`` is one already; otherwise ``**`` stands
    for anything, ``*`` and ``?`` for anything within a path part, and the
    whole path must match. Look-around is refused, so that every engine agrees.
    """
    if re.search(r"\(\?[=!<]", pattern):
        raise ValueError(f"look-around in the pattern {pattern!r}")
    if any(c in pattern for c in "^$[(\\+{"):
        re.compile(pattern)
        return pattern
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return "^" + "".join({"**": ".*", "*": r"[^/\\]*", "?": r"[^/\\]"}.get(p, re.escape(p)) for p in parts) + "$"


def policy_violations(nodes: DataFrame, edges: DataFrame, rules: list[dict]) -> DataFrame:
    """``rule, source_file, target_file, edges`` of file pairs that a rule forbids.

    A rule has name, source, target and edge_kinds (imports by default). Rules
    are a configuration: they become one column of rule names per edge, so the
    edges are read once and never joined with the rules. Edges of nodes without
    a location take no part.
    """
    e = with_ends(edges, nodes, "file").where("source_file is not null and target_file is not null").select("kind", "source_file", "target_file")
    e = e.groupBy("kind", "source_file", "target_file").agg(F.count(F.lit(1)).alias("n"))
    hits = [F.when(F.col("kind").isin(r.get("edge_kinds") or ["imports"]) & F.col("source_file").rlike(pattern_to_regex(r["source"])) & F.col("target_file").rlike(pattern_to_regex(r["target"])), F.lit(r["name"])) for r in rules]
    hit = e.select("source_file", "target_file", "n", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("rule"))
    return hit.groupBy("rule", "source_file", "target_file").agg(F.sum("n").alias("edges"))


def policy_rules(nodes: DataFrame, edges: DataFrame, rules: list[dict]) -> DataFrame:
    """``rule, violations, passed`` of every rule."""
    spark = nodes.sparkSession
    every = spark.createDataFrame([(r["name"],) for r in rules], "rule string")
    n = policy_violations(nodes, edges, rules).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    return every.join(n, "rule", "left").select("rule", F.coalesce("violations", F.lit(0).cast("long")).alias("violations")).withColumn("passed", F.col("violations") == 0)


def preflight(nodes: DataFrame, edges: DataFrame, files: DataFrame, depth: int = 3, in_memory: int = PAIRS_IN_MEMORY) -> DataFrame:
    """``file, direct_nodes, total_impact, blast, risk`` of each file of ``files`` (``file``).

    total_impact sums, over the nodes of the file, how many nodes are within
    ``depth`` steps, the node itself included; risk is high above 100 further
    nodes, medium above 20. Up to ``in_memory`` linked pairs (counted) every
    task has the whole graph and walks no further than its hubs; beyond it the
    walk is by joins.
    """
    ws = Workspace(nodes.sparkSession, "preflight")
    seeds = ws.keep(nodes.join(files.select("file").distinct(), "file", "left_semi").select("file", F.col("id").alias("seed")))
    pairs = ws.keep(edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct())
    if pairs.count() <= in_memory:
        per = _ball_totals(ws, pairs, seeds, depth)
    else:
        walk = layers(adjacency(edges).select("src", "dst").distinct(), seeds.withColumn("id", F.col("seed")), depth, ("file", "seed"))
        per = walk.groupBy("file").agg(F.count_distinct("seed").alias("direct_nodes"), F.count(F.lit(1)).alias("total_impact"))
    blast = F.col("total_impact") - F.col("direct_nodes")
    return per.select("file", "direct_nodes", "total_impact", blast.alias("blast"), F.when(blast > 100, "high").when(blast > 20, "medium").otherwise("low").alias("risk"))


def _ball_totals(ws: Workspace, pairs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``file, direct_nodes, total_impact`` of ``file, seed``, with the pairs ``a, b`` sent to every task as numbers."""
    spark = pairs.sparkSession
    numbers, n = numbered(ws, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    coded = ws.keep(pairs.join(numbers.select(F.col("id").alias("a"), F.col("no").alias("x")), "a").join(numbers.select(F.col("id").alias("b"), F.col("no").alias("y")), "b").select("x", "y"))
    ways = coded.unionByName(coded.select(F.col("y").alias("x"), F.col("x").alias("y")))
    degrees = ways.groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("k")).toArrow()
    degree = np.zeros(n, np.int64)
    degree[degrees["x"].to_numpy()] = degrees["k"].to_numpy()
    graph = Balls(ways.orderBy("x").select("y").toArrow()["y"].to_numpy(), degree, depth)
    sent = spark.sparkContext.broadcast(graph)

    def run(batches):
        for b in batches:
            no = b.column("no")
            linked = ~no.is_null().to_numpy(zero_copy_only=False)
            total = np.ones(len(linked), np.int64)
            total[linked] = sent.value.sizes(no.drop_null().to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(total)], names=["file", "total"])

    # Seeds beside the same hubs go to the same task: what these cover is counted once.
    bits = F.coalesce(*[F.when(F.col("y") == int(h), F.lit(1 << k)) for k, h in enumerate(graph.hubs)], F.lit(0))
    beside = ways.groupBy(F.col("x").alias("no")).agg(F.bit_or(bits).alias("beside"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    placed = ws.keep(seeds.join(numbers.withColumnRenamed("id", "seed"), "seed", "left").join(beside, "no", "left").select("file", "no", "beside"))
    placed = placed.repartitionByRange(tasks, "beside", "no").sortWithinPartitions("beside", "no").select("file", "no")
    return placed.mapInArrow(run, "file string, total long").groupBy("file").agg(F.count(F.lit(1)).alias("direct_nodes"), F.sum("total").alias("total_impact"))


class Balls:
    """How many nodes are within ``depth`` steps of a node, the node included, in a graph of numbered nodes.

    Most of a ball lies behind a few hubs. Walks end at the ``HUBS`` nodes of most neighbours, and every node has, for
    each number of steps, the set of hubs within it as bits. So a ball is what is near the hubs that the walk met (counted
    over classes of nodes with equal bits, once for all seeds beside the same hubs) and what only the walk met.
    """

    def __init__(self, near: np.ndarray, degree: np.ndarray, depth: int) -> None:
        """``near``: the neighbours of node 0, of node 1 and so on; ``degree``: how many each has, at least one."""
        self.near, self.degree, self.depth, n = near, degree.astype(np.int32), depth, len(degree)
        self.begin = np.cumsum(degree) - degree
        self.hubs = np.argsort(-degree, kind="stable")[:HUBS]
        self.within = [np.zeros(n, np.uint16)]
        self.within[0][self.hubs] = np.left_shift(np.uint16(1), np.arange(len(self.hubs), dtype=np.uint16))
        for _ in range(depth if n else 0):
            last = self.within[-1]
            self.within.append(np.bitwise_or.reduceat(last[near], self.begin) | last)
        of_hub = self.within.pop() if depth and n else self.within[0]
        self.hub_sizes = np.array([np.count_nonzero(of_hub & np.uint16(1 << k)) for k in range(len(self.hubs))], np.int64)
        if depth > 1:
            self.classes, self.counts = np.unique(np.stack(self.within[1:], 1), axis=0, return_counts=True)
        if depth > 2:
            self.rest, self.rest_of = np.unique(self.classes[:, :-1], axis=0, return_inverse=True)
        # How many neighbours the walk from a node looks at; decides how many walks are made at a time.
        self.cost = last = np.where(self.within[0] > 0, 0, degree).astype(np.float32)
        for _ in range(depth - 1 if n else 0):
            last = np.where(self.within[0] > 0, np.float32(0), np.add.reduceat(last[near], self.begin))
            self.cost = self.cost + last
        self.known: dict = {}

    def sizes(self, at: np.ndarray) -> np.ndarray:
        """The size of the ball around each of ``at``."""
        bit = self.within[0][at]
        out = np.ones(len(at), np.int64)
        out[bit > 0] = self.hub_sizes[np.log2(bit[bit > 0]).astype(int)]
        rest = np.flatnonzero(bit == 0)
        if not self.depth or not len(rest):
            return out
        group = (np.cumsum(self.cost[at[rest]], dtype=np.float64) // WALKED).astype(np.int64)
        for some in np.split(rest, np.flatnonzero(np.diff(group)) + 1):
            out[some] = self._walk(at[some].astype(np.int64))
        return out

    def _walk(self, at: np.ndarray) -> np.ndarray:
        n, depth = len(self.degree), self.depth
        met = np.zeros((depth, len(at)), np.uint16)  # hubs by the step that met them
        s, x = np.arange(len(at)), at
        seen = s * n + x
        layers = [(s, x)]
        for step in range(1, depth + 1):
            many = self.degree[x]
            y = self.near[np.repeat(self.begin[x] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            s = np.repeat(s, many)
            if step == depth:
                open_ = ~self._covered(met, s, y)
                s, y = s[open_], y[open_]
            new = np.sort(s * n + y)
            new = new[np.diff(new, prepend=-1) > 0]
            new = new[seen[np.minimum(np.searchsorted(seen, new), len(seen) - 1)] != new]
            s, x = np.divmod(new, n)
            layers.append((s, x))
            if step < depth:
                seen = np.sort(np.concatenate([seen, new]))
                bit = self.within[0][x]
                np.bitwise_or.at(met[step], s[bit > 0], bit[bit > 0])
                s, x = s[bit == 0], x[bit == 0]
        total = np.bincount(layers[-1][0], minlength=len(at))
        for s, x in layers[:-1]:
            total += np.bincount(s[~self._covered(met, s, x)], minlength=len(at))
        if depth > 1:
            for first in np.unique(met[1]):
                own = np.flatnonzero(met[1] == first)
                total[own] += self._behind(first, met[2:, own])
        return total

    def _covered(self, met: np.ndarray, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether node ``x`` is near enough to a hub that walk ``s`` met."""
        out = np.zeros(len(x), bool)
        for step in range(1, self.depth):
            out |= (self.within[self.depth - step][x] & met[step][s]) != 0
        return out

    def _behind(self, first: np.uint16, later: np.ndarray) -> np.ndarray:
        """How many nodes are near the hubs that walks met, ``first`` by the first step, a row of ``later`` by each other."""
        if first not in self.known:
            free = (self.classes[:, -1] & first) == 0
            counts = np.bincount(self.rest_of.ravel()[free], self.counts[free], len(self.rest)) if self.depth > 2 else np.empty(0)
            some = np.flatnonzero(counts)
            if len(self.known) == 256:
                self.known.clear()
            self.known[first] = len(self.degree) - int(self.counts[free].sum()), some, counts[some]
        base, some, counts = self.known[first]
        if not len(some):
            return np.full(later.shape[1], base)
        rest = self.rest[some]
        keys, where = np.unique(later, axis=1, return_inverse=True)
        found = np.empty(keys.shape[1])
        block = max(1, WALKED // max(1, len(rest)))
        for k in range(0, keys.shape[1], block):
            hit = np.zeros((min(block, keys.shape[1] - k), len(rest)), bool)
            for j, row in enumerate(keys[:, k : k + block]):
                hit |= (row[:, None] & rest[:, -1 - j]) != 0
            found[k : k + block] = hit @ counts
        return base + found[where.ravel()].astype(np.int64)


def fan_in_risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``file, fan_in, max_fan_in, risk`` of every file: high from 10 or 50, medium from 5 or 20."""
    d = degrees(nodes, edges).join(nodes.where("file is not null").select("id", "file"), "id")
    per = d.groupBy("file").agg(F.sum("in_degree").alias("fan_in"), F.max("in_degree").alias("max_fan_in"))
    risk = F.when((F.col("max_fan_in") >= 10) | (F.col("fan_in") >= 50), "high").when((F.col("max_fan_in") >= 5) | (F.col("fan_in") >= 20), "medium").otherwise("low")
    return per.withColumn("risk", risk)


def touched(files: DataFrame, paths: DataFrame) -> DataFrame:
    """``path`` of each path of ``paths`` that is a changed one of ``files`` (``file``), ends in one or lies below one.

    Whole parts are compared: each path meets the changed ones by its heads and
    tails, so the comparison is an equi-join.
    """
    parts = F.split("path", "/")
    steps = F.sequence(F.lit(1), F.size(parts))
    ends = F.array_distinct(F.concat(F.transform(steps, lambda k: F.array_join(F.slice(parts, 1, k), "/")), F.transform(steps, lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))))
    runs = paths.where("path is not null").select("path").distinct().select("path", F.explode(ends).alias("file"))
    changed = files.select(F.regexp_replace("file", "/+$", "").alias("file")).where("file <> ''").distinct()
    return runs.join(changed, "file", "left_semi").select("path").distinct()


def signals(files: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, before: DataFrame | None = None, flows: DataFrame | None = None, cycles: bool = True) -> DataFrame:
    """``level, reason, file, source, target, n`` of what changed files (``file``) and a changed graph raise.

    5: a migration, a format or configuration among the files. 4: more edges of
    depth 4 than ``before`` (earlier edges; n is how many more), or with
    ``flows`` (``what, names`` of data flow) triggers, awaits and sequences in
    it. 3: every edge of depth 3 or more that begins in a changed file, or with
    ``flows`` (which have columns file, scope) the variables that one scope
    writes and another reads. 2: more circles than ``before``. Without a graph,
    only 5; without an earlier one neither 4 nor 2 is raised. Fields that a
    level does not have are empty texts.
    """
    f = files.select("file").where("file is not null").distinct()
    any_of = lambda ps: F.col("file").rlike("|".join(f"(?:{p})" for p in ps))
    reasons = F.array(F.when(any_of(MIGRATION), "migration"), F.when(any_of(SERIALIZATION), "serialization"), F.when(any_of(CONFIGURATION), "configuration"))
    none, one = F.lit(""), F.lit(1).cast("long")
    out = f.select(F.lit(5).alias("level"), F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("reason"), "file", none.alias("source"), none.alias("target"), one.alias("n"))
    if edges is None or nodes is None:
        return out
    row = lambda level, reason: (F.lit(level).alias("level"), F.lit(reason).alias("reason"), none.alias("file"))
    deep = lambda e: e.agg(F.coalesce(F.sum(F.when(F.col("coupling_depth") >= 4, 1).otherwise(0)), F.lit(0)).cast("long").alias("k"))
    if flows is not None:
        timed = flows.where("what in ('triggers', 'awaits', 'sequences')").agg(F.coalesce(F.sum(F.size("names")), F.lit(0)).cast("long").alias("n"))
        used = flows.where("what in ('reads', 'writes')").select("file", "scope", "what", F.explode("names").alias("var")).groupBy("file", "var").agg(F.count_distinct("scope").alias("scopes"), F.max((F.col("what") == "writes").cast("int")).alias("w"), F.max((F.col("what") == "reads").cast("int")).alias("r"))
        shared = used.where("scopes > 1 and w = 1 and r = 1").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(timed.where("n > 0").select(*row(4, "temporal"), none.alias("source"), none.alias("target"), "n"))
        out = out.unionByName(shared.where("n > 0").select(*row(3, "shared"), none.alias("source"), none.alias("target"), "n"))
    else:
        if before is not None:
            more = deep(edges).crossJoin(deep(before).withColumnRenamed("k", "was"))  # single rows
            out = out.unionByName(more.where("k > was").select(*row(4, "temporal"), none.alias("source"), none.alias("target"), (F.col("k") - F.col("was")).alias("n")))
        near = nodes.join(touched(f, nodes.select(F.col("file").alias("path"))).withColumnRenamed("path", "file"), "file", "left_semi").select(F.col("id").alias("source"))
        out = out.unionByName(edges.where("coupling_depth >= 3").join(near, "source", "left_semi").select(*row(3, "shared"), "source", "target", one.alias("n")))
    if before is not None and cycles:
        from loomgraph.operators.cycles import components

        count = lambda e, name: components(e).agg(F.count_distinct("scc").alias(name))
        more = count(edges, "k").crossJoin(count(before, "was"))  # single rows
        out = out.unionByName(more.where("k > was").select(*row(2, "cycles"), none.alias("source"), none.alias("target"), (F.col("k") - F.col("was")).alias("n")))
    return out


def constraints(found: DataFrame, routing: dict[int, bool] | None = None) -> DataFrame:
    """One row ``violations, passed`` of signals: level 5 always violates, the others by the routing."""
    on = [5] + [k for k, v in (DEFAULT_ROUTING if routing is None else routing).items() if v and k != 5]
    bad = F.col("level").isin(on)
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return found.agg(one(bad).alias("violations"), one(~bad).alias("passed"))


def thread_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, accessors, concurrent_write, risk`` of each medium that more than one node reads, writes or shares."""
    e = edges.where(F.col("kind").isin(*DATA)).join(nodes.where("kind = 'medium'").select(F.col("id").alias("target")), "target", "left_semi")
    per = e.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("accessors"), F.count_distinct(F.when(F.col("kind") == "writes", F.col("source"))).alias("writers")).where("accessors > 1")
    return per.select("id", "accessors", (F.col("writers") > 1).alias("concurrent_write"), F.when(F.col("accessors") > 3, "high").otherwise("medium").alias("risk"))


def blindspots(l4: int, cycles: int, conflicts: int) -> list[tuple[str, int, str]]:
    """(name, count, severity) of what the three counts hide."""
    out = []
    if l4 > 0:
        out.append(("encapsulation", l4, "medium"))
    if cycles > 0:
        out.append(("cycles", cycles, "high" if cycles > 5 else "medium"))
    if conflicts > 0:
        out.append(("thread_conflicts", conflicts, "high" if conflicts > 3 else "low"))
    return out


def blindspot_rows(edges: DataFrame, sccs: DataFrame, threads: DataFrame) -> DataFrame:
    """``name, n, severity`` as a DataFrame of at most three rows, from one plan."""
    l4 = edges.where("coupling_depth >= 4").agg(F.count(F.lit(1)).alias("l4"))
    c = sccs.agg(F.count_distinct("scc").alias("c"))
    t = threads.agg(F.count(F.lit(1)).alias("t"))
    one = l4.crossJoin(c).crossJoin(t)  # single rows
    rows = F.array(
        F.struct(F.lit("encapsulation").alias("name"), F.col("l4").alias("n"), F.lit("medium").alias("severity")),
        F.struct(F.lit("cycles").alias("name"), F.col("c").alias("n"), F.when(F.col("c") > 5, "high").otherwise("medium").alias("severity")),
        F.struct(F.lit("thread_conflicts").alias("name"), F.col("t").alias("n"), F.when(F.col("t") > 3, "high").otherwise("low").alias("severity")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def health(nodes: DataFrame, edges: DataFrame, sccs: DataFrame) -> DataFrame:
    """One row ``nodes, edges, cycles, l4, score, trend``; an empty graph scores what its ratios leave."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum(F.when(F.col("coupling_depth") >= 4, 1).otherwise(0)), F.lit(0)).cast("long").alias("l4"))
    c = sccs.agg(F.count_distinct("scc").alias("cycles"))
    one = n.crossJoin(e).crossJoin(c)  # single rows
    ratio = F.when(F.col("nodes") > 0, F.col("edges") / F.col("nodes")).otherwise(0.0)
    deep = F.when(F.col("edges") > 0, F.col("l4") / F.col("edges")).otherwise(0.0)
    frail = F.least(F.col("nodes"), F.lit(20))
    score = F.least(ratio, F.lit(5.0)) / 5 * 40 + F.greatest(1 - F.col("cycles") / 20, F.lit(0.0)) * 10 + F.greatest(1 - frail / 20, F.lit(0.0)) * 20 + F.greatest(1 - deep, F.lit(0.0)) * 30
    return one.select("nodes", "edges", "cycles", "l4", F.least(score, F.lit(100.0)).alias("score"), F.when(ratio > 2, "healthy").when(F.col("edges") > 0, "stable").otherwise("empty").alias("trend"))


def density_health(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row ``density, score``: depth-4 edges per hundred nodes, and 40 plus 0.6 of what is left."""
    l4 = edges.where("coupling_depth >= 4").agg(F.count(F.lit(1)).alias("l4"))
    one = l4.crossJoin(nodes.agg(F.count(F.lit(1)).alias("n")))  # single rows
    density = F.when(F.col("n") > 0, F.least(100 * F.col("l4") / F.col("n"), F.lit(100.0))).otherwise(0.0)
    return one.select(density.alias("density"), ((100 - density) * 0.6 + 40).alias("score"))


def is_test():
    """Whether a node (columns file, name) belongs to tests."""
    return F.coalesce(F.lower("file").contains("test") | F.lower("file").contains("spec"), F.lit(False)) | F.coalesce(F.lower("name").rlike(r"^(test|it_|should_)|_test"), F.lit(False))


def dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, dependents, tests``: direct predecessors of each node, those of tests apart."""
    n = nodes.select(F.col("id").alias("source"), is_test().alias("test"))
    e = edges.select("source", "target").distinct().join(n, "source")
    per = e.groupBy(F.col("target").alias("id")).agg(F.sum(F.when(~F.col("test"), 1).otherwise(0)).alias("dependents"), F.sum(F.when(F.col("test"), 1).otherwise(0)).alias("tests"))
    return per.join(nodes.select("id"), "id", "left_semi")


def relationships(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``source_name, target_name, kind``: distinct named relations among the seeds (``id``)."""
    near = seeds.select("id").distinct()
    e = edges.join(near.withColumnRenamed("id", "source"), "source", "left_semi").join(near.withColumnRenamed("id", "target"), "target", "left_semi")
    return with_ends(e, nodes, "name").select("source_name", "target_name", "kind").distinct()


def temporal_share(edges: DataFrame) -> DataFrame:
    """``kind, n, with_delay, mean_delay, max_delay`` of the temporal edges."""
    t = edges.where(F.col("kind").isin(*TEMPORAL))
    return t.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("temporal_delay_sec").alias("with_delay"), F.avg("temporal_delay_sec").alias("mean_delay"), F.max("temporal_delay_sec").alias("max_delay"))
