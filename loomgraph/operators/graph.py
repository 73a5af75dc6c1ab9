"""Canonical graphs and relational operators over nodes and edges.

Everything here is a plan of built-in expressions, joins and aggregates: the
optimizer prunes columns, combines on the map side and picks join strategies.
A null source or target makes no edge; a null id makes no node; empty inputs
give empty results (or zero counts); columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import DATA, STRUCTURAL, TEMPORAL, edge_kind, location_file, short_name

#: Node kinds that count as symbols in a summary.
SYMBOLS = ("symbol", "function", "class", "module", "file", "interface")


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id with ``id, name, kind, location, file, out_degree, in_degree, community_id``.

    Repeated deliveries of a node agree in these columns (the least non-null
    value is taken); an unknown kind is a symbol.
    """
    known = F.col("kind").isin(*SYMBOLS, "medium", "temporal")
    rows = nodes.where("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("name", "kind", "location", "out_degree", "in_degree", "community_id")])
    return rows.withColumns({"kind": F.when(known, F.col("kind")).otherwise("symbol"), "file": location_file("location")})


def canonical_edges(edges: DataFrame) -> DataFrame:
    """One row per (source, target, kind): the least depth and delay; an unknown kind is a call."""
    kind = edge_kind("kind")
    kind = F.when(kind.isin(*STRUCTURAL, *DATA, *TEMPORAL), kind).otherwise("calls")
    rows = edges.where("source is not null and target is not null").select("source", "target", kind.alias("kind"), F.coalesce("coupling_depth", F.lit(0)).alias("coupling_depth"), "temporal_delay_sec")
    return rows.groupBy("source", "target", "kind").agg(F.min("coupling_depth").alias("coupling_depth"), F.min("temporal_delay_sec").alias("temporal_delay_sec"))


def adjacency(edges: DataFrame, kinds: list[str] | None = None, direction: str = "all") -> DataFrame:
    """``src, dst, kind, coupling_depth`` along the edges, against them, or both."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    out = e.select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind", "coupling_depth")
    back = e.select(F.col("target").alias("src"), F.col("source").alias("dst"), "kind", "coupling_depth")
    return {"outbound": out, "inbound": back, "all": out.unionByName(back)}[direction]


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree`` of each canonical node, over canonical edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = F.lit(0).cast("long")
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes_total, symbols, media, temporals, edges_total."""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    n = nodes.agg(F.count(F.lit(1)).alias("nodes_total"), one(F.col("kind").isin(*SYMBOLS)).alias("symbols"), one(F.col("kind") == "medium").alias("media"), one(F.col("kind") == "temporal").alias("temporals"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges_total")))  # one row by one row


def edge_types(edges: DataFrame) -> DataFrame:
    """``kind, n`` over canonical edges."""
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def package_of(file: Column) -> Column:
    """What stands before the first slash of a relative path; empty without one."""
    return F.when(F.instr(file, "/") > 0, F.substring_index(file, "/", 1)).otherwise("")


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with ``source_<c>`` and ``target_<c>`` of their end nodes (null where a node is missing)."""
    a = nodes.select(F.col("id").alias("source"), *[F.col(c).alias(f"source_{c}") for c in columns])
    b = nodes.select(F.col("id").alias("target"), *[F.col(c).alias(f"target_{c}") for c in columns])
    return edges.join(a, "source", "left").join(b, "target", "left")


def coupling_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with ``level``: 1 within a package, 2 across, 3 for data, 4 for temporal edges."""
    e = with_ends(edges, nodes, "file")
    a, b = package_of(F.coalesce("source_file", F.lit(""))), package_of(F.coalesce("target_file", F.lit("")))
    level = F.when(F.col("kind").isin(*DATA), 3).when(F.col("kind").isin(*TEMPORAL), 4).when((a == b) & (a != ""), 1).otherwise(2)
    return e.withColumn("level", level)


def coupling_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``module, l1..l4, total, fragility`` of each file: distinct edges that touch it, by depth.

    fragility is (4 l4 + 3 l3) / total. An edge within a file counts once there.
    """
    e = with_ends(edges, nodes, "file").where("coupling_depth between 1 and 4")
    touched = e.select(F.explode(F.array_distinct(F.filter(F.array("source_file", "target_file"), lambda x: x.isNotNull()))).alias("module"), "coupling_depth")
    lv = lambda k: F.sum(F.when(F.col("coupling_depth") == k, 1).otherwise(0))
    out = touched.groupBy("module").agg(*[lv(k).alias(f"l{k}") for k in (1, 2, 3, 4)], F.count(F.lit(1)).alias("total"))
    return out.withColumn("fragility", (4 * F.col("l4") + 3 * F.col("l3")) / F.col("total"))


def fragile(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """``id, fan, score``: fan is the number of edge ends, score fan plus the sum of squared depths; the largest first."""
    adj = adjacency(edges)
    s = adj.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan"), (F.count(F.lit(1)) + F.sum(F.col("coupling_depth") * F.col("coupling_depth"))).alias("score"))
    s = s.join(nodes.select("id"), "id", "left_semi")
    return s if limit is None else s.orderBy(F.desc("score"), "id").limit(limit)


def unused(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("function", "class"), limit: int | None = None) -> DataFrame:
    """``id, kind, out_degree`` of nodes of the kinds that no edge points to, the busiest first."""
    d = degrees(nodes, edges).where("in_degree = 0").join(nodes.where(F.col("kind").isin(*kinds)).select("id", "kind"), "id").select("id", "kind", "out_degree")
    return d if limit is None else d.orderBy(F.desc("out_degree"), "id").limit(limit)


def edges_by_kind(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, direction, kind, n``: the edges of every node, grouped."""
    e = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit("out").alias("direction")), F.struct(F.col("target").alias("id"), F.lit("in").alias("direction")))).alias("x"), "kind").select("x.*", "kind")
    return e.join(nodes.select("id"), "id", "left_semi").groupBy("id", "direction", "kind").agg(F.count(F.lit(1)).alias("n"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select("id")
    lost = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return lost.unionByName(kept.join(ids.withColumnRenamed("id", "target"), "target", "left_anti"))


def without_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def resolve_references(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """``target, resolved, candidates`` of each raw name of ``references`` (``target``) that some node answers to.

    Candidates are the nodes whose name ends in the same last part. A single
    one is taken; of several, those whose dotted id has the raw name, of at
    least two parts, as its tail, the one with the most parts, then the least
    id. Raw names are made distinct first, so a frequent name costs no more
    than a rare one; candidates are ranked by an aggregate with a map-side
    combine. Node ids and nulls are no raw names.
    """
    raw = references.select("target").where("target is not null").distinct().join(nodes.select(F.col("id").alias("target")), "target", "left_anti")
    named = nodes.select("id", short_name(F.coalesce("name", "id")).alias("short"))
    single = named.groupBy("short").agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("only"))
    raw = raw.withColumn("short", short_name("target")).join(single, "short")
    one = raw.where("candidates = 1").select("target", F.col("only").alias("resolved"), "candidates")
    # A name without a dot cannot be the tail of two parts, so only qualified names meet several candidates.
    many = raw.where("candidates > 1 and instr(target, '.') > 0").select("target", "short", "candidates").join(named, "short")
    many = many.where(F.col("id").endswith(F.concat(F.lit("."), F.col("target"))))
    # The most parts, then the least id: negative, so that both are a minimum.
    best = many.groupBy("target").agg(F.min(F.struct((-F.size(F.split("id", r"\."))).alias("parts"), "id")).alias("best"), F.first("candidates").alias("candidates"))
    return one.unionByName(best.select("target", F.col("best.id").alias("resolved"), "candidates"))


def resolve_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``target, resolved, candidates`` of each raw target name, by the rules of ``resolve_references``."""
    return resolve_references(nodes, edges.select("target"))


def resolve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Canonical edges with raw names at either end replaced by the nodes that they name, made distinct again.

    As soon as one end of an edge names nothing, the edge stays as it is.
    """
    found = resolve_references(nodes, edges.select(F.explode(F.array("source", "target")).alias("target")))
    found = found.select("target", "resolved").unionByName(nodes.select(F.col("id").alias("target"), F.col("id").alias("resolved")))
    e = edges.join(found.select(F.col("target").alias("source"), F.col("resolved").alias("s")), "source", "left").join(found.withColumnRenamed("resolved", "t"), "target", "left")
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    e = e.withColumns({"source": F.when(both, F.col("s")).otherwise(F.col("source")), "target": F.when(both, F.col("t")).otherwise(F.col("target"))})
    return e.groupBy("source", "target", "kind").agg(F.min("coupling_depth").alias("coupling_depth"), F.min("temporal_delay_sec").alias("temporal_delay_sec"))


def merge_nodes(*batches: DataFrame) -> DataFrame:
    """Union of node batches, one row per (location or id, name, kind): the least id stands for it."""
    rows = batches[0]
    for b in batches[1:]:
        rows = rows.unionByName(b)
    return rows.where("id is not null").groupBy(F.coalesce("location", "id").alias("place"), "name", "kind").agg(F.min("id").alias("id"), F.count_distinct("id").alias("merged"))


def file_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``source_file, target_file, weight``: edges between different files."""
    e = with_ends(edges, nodes, "file").where("source_file is not null and target_file is not null and source_file <> target_file")
    return e.groupBy("source_file", "target_file").agg(F.count(F.lit(1)).alias("weight"))


def file_nodes(nodes: DataFrame) -> DataFrame:
    """``file, nodes``: how many nodes each file holds."""
    return nodes.where("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("nodes"))


def top_symbols(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """``file, id, in_degree, place``: the k most referred-to nodes of each file, ties by id."""
    d = degrees(nodes, edges).join(nodes.where("file is not null").select("id", "file"), "id")
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("in_degree"), "id"))
    return d.select("file", "id", "in_degree", rank.alias("place")).where(F.col("place") <= k)


def delayed(edges: DataFrame) -> DataFrame:
    """Temporal edges with their delays."""
    return edges.where(F.col("kind").isin(*TEMPORAL)).select("source", "target", "kind", "temporal_delay_sec")


def clusters(nodes: DataFrame, min_size: int = 2, max_nodes: int = 5) -> DataFrame:
    """``community_id, size, members, label``: stored communities, with their first ids and most frequent file stem.

    The members shown are the least ids; the label is the stem that most of the
    community's files share, ties by name.
    """
    n = nodes.where("community_id is not null")
    place = F.row_number().over(Window.partitionBy("community_id").orderBy("id"))
    ranked = n.select("community_id", "id", place.alias("place"))
    shown = ranked.where(F.col("place") <= max_nodes).groupBy("community_id").agg(F.array_sort(F.collect_list("id")).alias("members"))
    size = n.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    stem = F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)
    stems = n.where("file is not null").groupBy("community_id", stem.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = stems.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("n"), "label"))).where("r = 1").select("community_id", "label")
    return size.join(shown, "community_id").join(best, "community_id", "left").select("community_id", "size", F.array_join("members", ",").alias("members"), "label")


def cross_community(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``source_community, target_community, n``: edges whose ends are in different communities; none (-1) differs from every one."""
    e = with_ends(edges, nodes, "community_id")
    a, b = F.coalesce("source_community_id", F.lit(-1)), F.coalesce("target_community_id", F.lit(-1))
    e = e.select(a.alias("source_community"), b.alias("target_community")).where("source_community <> target_community or source_community = -1")
    return e.groupBy("source_community", "target_community").agg(F.count(F.lit(1)).alias("n"))


def quotient(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``source_community, target_community, kind``: distinct links between stored communities."""
    e = with_ends(edges, nodes, "community_id").where("source_community_id is not null and target_community_id is not null and source_community_id <> target_community_id")
    return e.select(F.col("source_community_id").alias("source_community"), F.col("target_community_id").alias("target_community"), "kind").distinct()


def diff_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id, change``: added, removed or modified (name or kind differs, null being a value)."""
    b = before.select("id", F.struct("name", "kind").alias("old"), F.lit(True).alias("was"))
    a = after.select("id", F.struct("name", "kind").alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return b.join(a, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def signature_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id`` of symbols that are new or whose stored degrees changed."""
    a = after.where("kind = 'symbol'").select("id", "in_degree", "out_degree")
    b = before.select("id", F.col("in_degree").alias("i"), F.col("out_degree").alias("o"), F.lit(True).alias("was"))
    return a.join(b, "id", "left").where("was is null or not (in_degree <=> i and out_degree <=> o)").select("id")
