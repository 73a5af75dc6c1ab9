"""One object with all graph queries by name.

An engine holds canonical nodes and edges and, where they are there, sources,
timeline and an earlier graph. Every query returns DataFrames (or a dict of
them), so results can be joined, filtered and written like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import checks as C
from loomgraph.operators import community as M
from loomgraph.operators import cycles as Y
from loomgraph.operators import extract as X
from loomgraph.operators import graph as G
from loomgraph.operators import search as S
from loomgraph.operators import store as T
from loomgraph.operators import traverse as V
from loomgraph.sources import trees


class Engine:
    """Queries over one graph."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, timeline: DataFrame | None = None, before: tuple[DataFrame, DataFrame] | None = None) -> None:
        self.spark, self.raw_nodes, self.sources, self.timeline_rows, self.before = spark, nodes, sources, timeline, before
        self.nodes, self.edges = G.canonical_nodes(nodes), G.canonical_edges(edges)
        self._records: DataFrame | None = None

    @classmethod
    def analyze(cls, spark: SparkSession, root: str, extensions: list[str] | None = None, **more) -> "Engine":
        """Discover, extract and resolve the files below ``root``; depths and communities are assigned."""
        sources = trees.discover(spark, root, extensions or sorted(X.LANGUAGES))
        rec = X.records(sources).cache()
        n = X.nodes(rec).withColumns({"out_degree": F.lit(None).cast("long"), "in_degree": F.lit(None).cast("long"), "community_id": F.lit(None).cast("int")})
        nodes = G.canonical_nodes(n)
        e = G.resolve(nodes, G.canonical_edges(X.edges(rec)))
        e = G.without_dangling(nodes, e)
        level = G.coupling_levels(nodes, e).select("source", "target", "kind", F.when(F.col("coupling_depth") > 0, F.col("coupling_depth")).otherwise(F.col("level")).alias("coupling_depth"), "temporal_delay_sec")
        engine = cls(spark, n, level, sources, **more)
        engine._records = rec
        return engine

    # references
    def ids(self, reference: str) -> DataFrame:
        """``id`` of the node that a reference means: the exact id, else the least id of the exact name."""
        exact = self.nodes.where(F.col("id") == reference).select("id", F.lit(0).alias("c"))
        named = self.nodes.where(F.col("name") == reference).select("id", F.lit(1).alias("c"))
        return exact.unionByName(named).orderBy("c", "id").limit(1).select("id")

    def one(self, reference: str) -> str:
        r = self.ids(reference).first()
        if r is None:
            raise KeyError(reference)
        return r["id"]

    def records(self) -> DataFrame:
        if self._records is None:
            if self.sources is None:
                raise ValueError("the engine has no sources")
            self._records = X.records(self.sources)
        return self._records

    # graph
    def node(self, node_id: str) -> DataFrame:
        """``kind, direction, other`` of the edges at a node."""
        i = self.one(node_id)
        out = self.edges.where(F.col("source") == i).select("kind", F.lit("out").alias("direction"), F.col("target").alias("other"))
        return out.unionByName(self.edges.where(F.col("target") == i).select("kind", F.lit("in").alias("direction"), F.col("source").alias("other")))

    def neighbors(self, node_id: str, depth: int = 1, kinds: list[str] | None = None) -> DataFrame:
        return V.neighbors(G.adjacency(self.edges, kinds), self.ids(node_id), depth)

    def impact(self, node_id: str, depth: int = 3) -> DataFrame:
        return V.impact(G.adjacency(self.edges), self.ids(node_id), depth)

    def path(self, from_id: str, to_id: str, depth: int = 20) -> DataFrame:
        return V.shortest_path(G.adjacency(self.edges), self.one(from_id), self.one(to_id), depth)

    def history(self, node_id: str) -> DataFrame:
        return T.history(self.nodes.join(self.ids(node_id), "id", "left_semi"), self.edges, self._timeline())

    def community(self, node_id: str) -> DataFrame:
        """Members of the node's stored community; without one, of the community that is found."""
        i = self.one(node_id)
        own = self.nodes.where((F.col("id") == i) & F.col("community_id").isNotNull()).select("community_id")
        if not own.isEmpty():
            return self.nodes.join(own, "community_id", "left_semi").select("id")
        found = M.communities(self.nodes, self.edges, levels=1).select("id", "community")
        return found.join(found.where(F.col("id") == i).select("community"), "community", "left_semi").select("id")

    def clusters(self, min_size: int = 2, max_nodes: int = 200) -> DataFrame:
        return G.clusters(self.nodes, min_size, max_nodes)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Phrase hits first; if there are none, nodes whose name or id holds the text."""
        hits = S.phrase(self.nodes, query, limit)
        if hits.isEmpty():
            return S.substring(self.nodes, query).select("id", F.lit(0).alias("hits")).orderBy("id").limit(limit)
        return hits

    def graph_summary(self) -> DataFrame:
        return G.summary(self.nodes, self.edges)

    def explore(self, query: str | None = None, symbols: list[str] | None = None, include_source: bool = False) -> dict[str, DataFrame]:
        """What belongs to some symbols: resolved ids, the flow between them, dependents, relations, alerts, source."""
        names = list(symbols or []) or [n for n, _ in S.question_names(query or "")]
        found = S.resolve_names(self.nodes, names, G.degrees(self.nodes, self.edges)).cache()
        ids = found.select("id").distinct()
        calls = G.adjacency(self.edges, ["calls"])
        some = [r["id"] for r in ids.orderBy("id").limit(4).collect()]
        flows = [V.shortest_path(calls, a, b, 7) for k, a in enumerate(some) for b in some[k + 1 :]]
        flow = None
        for f in flows:
            flow = f if flow is None else flow.unionByName(f)
        out = {
            "nodes": found,
            "flow": (flow if flow is not None else V.shortest_path(calls, "", "", 0).where("false")).orderBy(F.desc("length")).limit(1),
            "dependents": C.dependents(self.nodes, self.edges).join(ids, "id", "left_semi"),
            "relationships": C.relationships(self.nodes, self.edges, ids),
            "cycles": Y.components(self.edges).join(ids, "id", "left_semi"),
            "fragile": G.fragile(self.nodes, self.edges, 20).join(ids, "id", "left_semi"),
            "coupling": G.coupling_report(self.nodes, self.edges).join(self.nodes.join(ids, "id", "left_semi").select(F.col("file").alias("module")), "module", "left_semi").where("l4 > 0"),
        }
        if include_source and self.sources is not None:
            out["source"] = S.source_windows(self.nodes.join(ids, "id", "left_semi"), self.sources)
        return out

    # analysis
    def delayed(self) -> DataFrame:
        return G.delayed(self.edges)

    def fragile(self, limit: int = 10) -> DataFrame:
        return G.fragile(self.nodes, self.edges, limit)

    def cycle(self, mode: str = "all") -> DataFrame:
        """``scc, size, kind``; mode data or llm keeps the components of that kind."""
        kinds = Y.classify(self.nodes, Y.components(self.edges), self.raw_nodes.select("id", "properties") if "properties" in self.raw_nodes.columns else None)
        return kinds if mode == "all" else kinds.where(F.col("kind") == {"data": "data_persistent", "llm": "llm_involved"}.get(mode, mode))

    def thread_conflicts(self, node_id: str | None = None) -> DataFrame:
        r = C.thread_report(self.nodes, self.edges)
        return r if node_id is None else r.where(F.col("id") == self.one(node_id))

    def coupling_report(self, module_name: str | None = None) -> DataFrame:
        r = G.coupling_report(self.nodes, self.edges)
        return r if module_name is None else r.where(F.lower("module").startswith(module_name.lower()))

    def timeline(self, limit: int = 50, since: str | None = None) -> DataFrame:
        return T.latest(self._timeline(), limit, since)

    def blindspots(self) -> DataFrame:
        return C.blindspot_rows(self.edges, Y.components(self.edges), C.thread_report(self.nodes, self.edges))

    def policy_check(self, rules: list[dict]) -> dict[str, DataFrame]:
        return {"rules": C.policy_rules(self.nodes, self.edges, rules), "violations": C.policy_violations(self.nodes, self.edges, rules)}

    def unused(self, limit: int = 50, kind_filter: str = "function,class") -> DataFrame:
        return G.unused(self.nodes, self.edges, tuple(k.strip() for k in kind_filter.split(",")), min(limit, 200))

    def dataflow(self, files: list[str] | None = None) -> DataFrame:
        f = X.flows(self.records())
        return f if files is None else f.where(F.col("file").isin(files))

    # changes
    def run_preflight(self, files: list[str], depth: int = 3) -> DataFrame:
        return C.preflight(self.nodes, self.edges, self._files(files), depth)

    def graph_diff(self) -> dict[str, DataFrame]:
        """Nodes and edges that differ from the earlier graph."""
        b = self._before()
        key = ["source", "target", "kind"]
        gone = b.edges.select(*key).join(self.edges, key, "left_anti").withColumn("change", F.lit("removed"))
        fresh = self.edges.select(*key).join(b.edges, key, "left_anti").withColumn("change", F.lit("added"))
        return {"nodes": G.diff_nodes(b.nodes, self.nodes), "edges": gone.unionByName(fresh)}

    def run_check(self, files: list[str]) -> dict[str, DataFrame]:
        """Everything that a change of ``files`` since the earlier graph raises."""
        b, f = self._before(), self._files(files)
        found = C.signals(f, self.nodes, self.edges, b.edges)
        seeds = self.nodes.join(f, "file", "left_semi").select("id")
        now, was = Y.components(self.edges), Y.components(b.edges)
        return {
            "signals": found,
            "constraints": C.constraints(found),
            "summary": found.groupBy("level").agg(F.count(F.lit(1)).alias("n")),
            "blast_radius": V.blast_radius(G.adjacency(self.edges), seeds, 3),
            "cross_community": G.cross_community(self.nodes, self.edges),
            "new_cycles": now.join(was.select("id"), "id", "left_anti"),
            "thread_conflicts": C.thread_report(self.nodes, self.edges),
            "api_changes": G.signature_changes(b.nodes, self.nodes),
        }

    def run_health(self) -> DataFrame:
        return C.health(self.nodes, self.edges, Y.components(self.edges))

    def rename(self, old_name: str, new_name: str, dry_run: bool = True) -> DataFrame:
        """Nodes of the old name; or, unless ``dry_run``, all nodes after the renaming, which this engine then has."""
        if dry_run:
            return self.nodes.where(F.col("name") == old_name)
        self.nodes = T.rename(self.nodes, old_name, new_name)
        return self.nodes

    def status(self) -> DataFrame:
        return G.summary(self.nodes, self.edges).select("nodes_total", "edges_total")

    # plumbing
    QUERIES = tuple(
        "neighbors impact path history community delayed fragile cycle thread_conflicts coupling_report timeline blindspots run_preflight search explore graph_summary clusters graph_diff run_check run_health rename status policy_check node unused dataflow".split()
    )

    def call(self, query: str, **parameters):
        """A query by its name."""
        if query not in self.QUERIES:
            raise KeyError(query)
        return getattr(self, query)(**parameters)

    def _files(self, files: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(f,) for f in files], "file string")

    def _timeline(self) -> DataFrame:
        if self.timeline_rows is None:
            raise ValueError("the engine has no timeline")
        return self.timeline_rows

    def _before(self) -> "Engine":
        if self.before is None:
            raise ValueError("the engine has no earlier graph")
        return Engine(self.spark, *self.before)
