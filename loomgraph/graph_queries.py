"""Queries of the graph operators over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import checks as C
from loomgraph.operators import community as M
from loomgraph.operators import cycles as Y
from loomgraph.operators import graph as G
from loomgraph.operators import search as S
from loomgraph.operators import store as T
from loomgraph.operators import traverse as V
from loomgraph.sources.tables import table

QUERIES, SQL = {}, {}

_ALL = "'imports','calls','inherits','defines','reads','writes','shares','triggers','awaits','sequences'"
#: Canonical nodes n and edges e, the adjacency a.
_G = f"""n as (select id, min(name) as name, case when min(kind) in ('symbol','function','class','module','file','interface','medium','temporal') then min(kind) else 'symbol' end as kind, min(location) as location,
 min(out_degree) as out_degree, min(in_degree) as in_degree, min(community_id) as community_id, regexp_replace(replace(min(location), '\\', '/'), '(:[0-9]+){{1,2}}$', '') as file from nodes where id is not null group by id),
e as (select source, target, case when lower(trim(kind)) in ({_ALL}) then lower(trim(kind)) else 'calls' end as kind, min(coalesce(coupling_depth, 0)) as coupling_depth, min(temporal_delay_sec) as temporal_delay_sec
 from edges where source is not null and target is not null group by 1, 2, 3),
a as (select source as src, target as dst, kind, coupling_depth from e union all select target, source, kind, coupling_depth from e),
h as (select distinct src, dst from a)"""


def _g(rest: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{_G}{', ' if not rest.lstrip().startswith('select') else ' '}{rest}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _n(spark, d):
    return G.canonical_nodes(table(spark, d, "nodes"))


def _e(spark, d):
    return G.canonical_edges(table(spark, d, "edges"))


@query(_g("select id, kind, file from n"))
def nodes_canonical(spark, d):
    return _n(spark, d).select("id", "kind", "file")


@query(_g("select source, target, kind, coupling_depth from e"))
def edges_canonical(spark, d):
    return _e(spark, d).select("source", "target", "kind", "coupling_depth")


@query(_g("select n.id, count(*) filter (where x.o = 1) as out_degree, count(*) filter (where x.o = 0) as in_degree from n left join (select source as id, 1 as o from e union all select target, 0 from e) x on x.id = n.id group by n.id"))
def degrees(spark, d):
    return G.degrees(_n(spark, d), _e(spark, d))


@query(_g("select (select count(*) from n) as nodes_total, (select count(*) from n where kind not in ('medium','temporal')) as symbols, (select count(*) from n where kind = 'medium') as media, (select count(*) from n where kind = 'temporal') as temporals, (select count(*) from e) as edges_total"))
def graph_summary(spark, d):
    return G.summary(_n(spark, d), _e(spark, d))


@query(_g("select kind, count(*) as n from e group by 1"))
def edge_types(spark, d):
    return G.edge_types(_e(spark, d))


_ENDS = "x as (select e.*, s.file as sf, t.file as tf, s.community_id as sc, t.community_id as tc, s.name as sn, t.name as tn from e left join n s on s.id = e.source left join n t on t.id = e.target)"


@query(_g(_ENDS + """ select level, kind, count(*) as n from (select kind, case when kind in ('reads','writes','shares') then 3 when kind in ('triggers','awaits','sequences') then 4
 when contains(coalesce(sf, ''), '/') and contains(coalesce(tf, ''), '/') and split_part(sf, '/', 1) = split_part(tf, '/', 1) and split_part(sf, '/', 1) <> '' then 1 else 2 end as level from x) group by 1, 2"""))
def coupling_levels(spark, d):
    return G.coupling_levels(_n(spark, d), _e(spark, d)).groupBy("level", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(_g(_ENDS + """, y as (select sf as module, coupling_depth as d from x where sf is not null union all select tf, coupling_depth from x where tf is not null and tf is distinct from sf)
select module, count(*) filter (where d = 1) as l1, count(*) filter (where d = 2) as l2, count(*) filter (where d = 3) as l3, count(*) filter (where d = 4) as l4, count(*) as total,
 (4 * count(*) filter (where d = 4) + 3 * count(*) filter (where d = 3)) / count(*) as fragility from y where d between 1 and 4 group by 1"""))
def coupling_report(spark, d):
    return G.coupling_report(_n(spark, d), _e(spark, d))


@query(_g("select count(*) as n from e where coupling_depth >= 4"))
def l4_count(spark, d):
    return _e(spark, d).where("coupling_depth >= 4").agg(F.count(F.lit(1)).alias("n"))


_SCORES = "s as (select src as id, count(*) as fan, count(*) + sum(coupling_depth * coupling_depth) as score from a where src in (select id from n) group by 1)"


@query(_g(_SCORES + " select * from s"))
def fragile_scores(spark, d):
    return G.fragile(_n(spark, d), _e(spark, d))


@query(_g(_SCORES + " select * from s order by score desc, id limit 20"))
def fragile_top(spark, d):
    return G.fragile(_n(spark, d), _e(spark, d), 20)


@query(_g("select id, kind, (select count(*) from e where source = n.id) as out_degree from n where kind in ('function','class') and id not in (select target from e)"))
def unused(spark, d):
    return G.unused(_n(spark, d), _e(spark, d))


@query(_g("select id, direction, kind, count(*) as n from (select source as id, 'out' as direction, kind from e union all select target, 'in', kind from e) where id in (select id from n) group by 1, 2, 3"))
def node_edges_by_kind(spark, d):
    return G.edges_by_kind(_n(spark, d), _e(spark, d))


@query(_g("select source, target, kind from e where source not in (select id from n) or target not in (select id from n)"))
def dangling_edges(spark, d):
    return G.dangling(_n(spark, d), _e(spark, d)).select("source", "target", "kind")


@query(_g("select kind, count(*) as n from e where source in (select id from n) and target in (select id from n) group by 1"))
def attached_edges(spark, d):
    return G.without_dangling(_n(spark, d), _e(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_g("""r as (select target, split_part(target, '.', -1) as short from (select source as target from e union select target from e) where target not in (select id from n)),
k as (select id, split_part(coalesce(name, id), '.', -1) as short from n), c as (select short, count(*) as candidates, min(id) as sole from k group by 1),
m as (select r.target, k.id, c.candidates, len(string_split(k.id, '.')) as parts from r join c using (short) join k using (short) where c.candidates > 1 and contains(r.target, '.') and ends_with(k.id, '.' || r.target)),
w as (select target, id, candidates, row_number() over (partition by target order by parts desc, id) as rn from m)
select target, sole as resolved, candidates from r join c using (short) where candidates = 1 union all select target, id, candidates from w where rn = 1"""))
def resolve_names(spark, d):
    return G.resolve_references(_n(spark, d), _e(spark, d).select(F.explode(F.array("source", "target")).alias("target")))


@query("""select coalesce(location, id) as place, name, kind, min(id) as id, count(distinct id) as merged from (select id, name, kind, location from nodes union all select id, name, kind, location from node_snapshots) where id is not null group by 1, 2, 3""")
def merge_nodes(spark, d):
    cols = ("id", "name", "kind", "location")
    return G.merge_nodes(table(spark, d, "nodes").select(*cols), table(spark, d, "node_snapshots").select(*cols))


@query(_g(_ENDS + " select sf as source_file, tf as target_file, count(*) as weight from x where sf <> tf group by 1, 2"))
def file_rollup(spark, d):
    return G.file_rollup(_n(spark, d), _e(spark, d))


@query(_g("select file, count(*) as nodes from n where file is not null group by 1"))
def file_nodes(spark, d):
    return G.file_nodes(_n(spark, d))


@query(_g("""k as (select n.file, n.id, (select count(*) from e where e.target = n.id) as in_degree from n where file is not null)
select * from (select file, id, in_degree, row_number() over (partition by file order by in_degree desc, id) as place from k) where place <= 5"""))
def top_symbols(spark, d):
    return G.top_symbols(_n(spark, d), _e(spark, d))


@query(_g("select source, target, kind, temporal_delay_sec from e where kind in ('triggers','awaits','sequences')"))
def delayed_edges(spark, d):
    return G.delayed(_e(spark, d))


@query(_g("select kind, count(*) as n, count(temporal_delay_sec) as with_delay, max(temporal_delay_sec) as max_delay from e where kind in ('triggers','awaits','sequences') group by 1"))
def temporal_delays(spark, d):
    return C.temporal_share(_e(spark, d)).drop("mean_delay")


@query(_g("""k as (select *, row_number() over (partition by community_id order by id) as r from n where community_id is not null),
l as (select community_id, regexp_extract(file, '([^/.]+)[^/]*$', 1) as label, count(*) as c from k where file is not null group by 1, 2),
b as (select community_id, label from (select *, row_number() over (partition by community_id order by c desc, label) as r from l) where r = 1)
select community_id, count(*) as size, string_agg(id, ',' order by id) filter (where r <= 5) as members, any_value(b.label) as label from k left join b using (community_id) group by 1 having count(*) >= 2"""))
def clusters(spark, d):
    return G.clusters(_n(spark, d))


@query(_g(_ENDS + " select coalesce(sc, -1) as source_community, coalesce(tc, -1) as target_community, count(*) as n from x where coalesce(sc, -1) <> coalesce(tc, -1) or sc is null group by 1, 2"))
def cross_community(spark, d):
    return G.cross_community(_n(spark, d), _e(spark, d))


@query(_g(_ENDS + " select distinct sc as source_community, tc as target_community, kind from x where sc <> tc"))
def quotient_edges(spark, d):
    return G.quotient(_n(spark, d), _e(spark, d))


def _first(spark, d):
    """The least source of an import: one row, as a seed."""
    return _e(spark, d).where("kind = 'imports'").agg(F.min("source").alias("id"))


_SEED = "s0 as (select min(source) as id from e where kind = 'imports')"
_LAYERS = """, s1 as (select distinct dst as id from h join s0 on src = s0.id where dst not in (select id from s0)),
s2 as (select distinct dst as id from h join s1 on src = s1.id where dst not in (select id from s0 union all select id from s1)),
s3 as (select distinct dst as id from h join s2 on src = s2.id where dst not in (select id from s0 union all select id from s1 union all select id from s2)),
l as (select id, 0 as depth from s0 union all select id, 1 from s1 union all select id, 2 from s2 union all select id, 3 from s3)"""


@query(_g(_SEED + _LAYERS + " select id, depth from l"))
def impact(spark, d):
    return V.impact(G.adjacency(_e(spark, d)), _first(spark, d), 3)


@query(_g(_SEED + _LAYERS + " select l.id, l.depth, min(p.id) as parent from l join h on h.dst = l.id join l p on p.id = h.src and p.depth = l.depth - 1 where l.depth between 1 and 2 group by 1, 2"))
def neighbors(spark, d):
    return V.neighbors(G.adjacency(_e(spark, d)), _first(spark, d), 2)


@query(_g("s0 as (select id from n where file = (select min(file) from n))" + _LAYERS + " select id, depth from l"))
def impact_multi_seed(spark, d):
    n = _n(spark, d)
    seeds = n.join(n.agg(F.min("file").alias("file")), "file", "left_semi").select("id")
    return V.impact(G.adjacency(_e(spark, d)), seeds, 3)


@query(_g("s0 as (select id from n where file = (select min(file) from n))" + _LAYERS + " select (select count(*) from s0) as seeds, (select count(*) from l where depth > 0) as reached"))
def blast_radius(spark, d):
    n = _n(spark, d)
    seeds = n.join(n.agg(F.min("file").alias("file")), "file", "left_semi").select("id")
    return V.blast_radius(G.adjacency(_e(spark, d)), seeds, 3)


@query(_g(_SEED + _LAYERS.replace("from h join", "from (select distinct source as src, target as dst from e where kind in ('calls','imports')) h join") + " select id, depth from l"))
def blast_by_kind_direction(spark, d):
    return V.layers(G.adjacency(_e(spark, d), ["calls", "imports"], "outbound"), _first(spark, d), 3)


@query(_g(_SEED + ", s1 as (select id from s0 union select dst from h join s0 on src = s0.id) select source, target, kind from e where source in (select id from s1) and target in (select id from s1)"))
def ego_subgraph(spark, d):
    return V.ego(_e(spark, d), _first(spark, d)).select("source", "target", "kind")


@query(_g("""f as (select min(source) as a, max(target) as b from e where kind = 'inherits'),
w(id, depth) as (select a, 0 from f union select h.dst, w.depth + 1 from w join h on h.src = w.id where w.depth < 6)
select cast(min(depth) as int) as length from w, f where w.id = f.b""", recursive=True))
def shortest_path_length(spark, d):
    e = _e(spark, d)
    r = e.where("kind = 'inherits'").agg(F.min("source").alias("a"), F.max("target").alias("b")).first()
    return V.shortest_path(G.adjacency(e), r["a"], r["b"]).agg(F.min("length").alias("length"))


_PAIR = """u as (select max(snapshot_id) as s from node_snapshots), v as (select max(snapshot_id) as s from node_snapshots where snapshot_id < (select s from u)),
x as (select id, min(name) as name, min(kind) as kind, min(in_degree) as i, min(out_degree) as o from node_snapshots where snapshot_id = (select s from v) group by 1),
y as (select id, min(name) as name, min(kind) as kind, min(in_degree) as i, min(out_degree) as o from node_snapshots where snapshot_id = (select s from u) group by 1)"""


def _pair(spark, d):
    s = table(spark, d, "node_snapshots")
    last = [r[0] for r in s.select("snapshot_id").distinct().orderBy(F.desc("snapshot_id")).limit(2).collect()]
    return [G.canonical_nodes(s.where(F.col("snapshot_id") == k)) for k in reversed(last)]


@query("with " + _PAIR + " select id, case when x.id is null then 'added' when y.id is null then 'removed' else 'modified' end as change from x full join y using (id) where x.id is null or y.id is null or (x.name, x.kind) is distinct from (y.name, y.kind)")
def diff_nodes(spark, d):
    return G.diff_nodes(*_pair(spark, d))


@query("with " + _PAIR + " select y.id from y left join x using (id) where y.kind = 'symbol' and (x.id is null or x.i is distinct from y.i or x.o is distinct from y.o)")
def api_changes(spark, d):
    return G.signature_changes(*_pair(spark, d))


RULES = [
    {"name": "core is a leaf", "source": "**/core/**", "target": "**/plugins/**", "edge_kinds": ["imports", "calls"]},
    {"name": "no views from stores", "source": "/store/", "target": "**/views/**", "edge_kinds": ["imports", "calls", "reads"]},
    {"name": "shared core", "source": "^(atlas_core)/", "target": "^(?:brisk_basin|cedar_cabin)/", "edge_kinds": ["calls"]},
]


# The rules' patterns as regular expressions, written out.
_RULE_SQL = """select 'core is a leaf' as rule, sf as source_file, tf as target_file from x where kind in ('imports','calls') and regexp_matches(sf, '^.*/core/.*$') and regexp_matches(tf, '^.*/plugins/.*$')
 union all select 'no views from stores', sf, tf from x where kind in ('imports','calls','reads') and sf = '/store/' and regexp_matches(tf, '^.*/views/.*$')
 union all select 'shared core', sf, tf from x where kind = 'calls' and regexp_matches(sf, '^(atlas_core)/') and regexp_matches(tf, '^(brisk_basin|cedar_cabin)/')"""


@query(_g(_ENDS + f", v as ({_RULE_SQL}) select rule, source_file, target_file, count(*) as edges from v group by 1, 2, 3"))
def policy_violations(spark, d):
    return C.policy_violations(_n(spark, d), _e(spark, d), RULES)


@query(_g(_ENDS + f", v as (select distinct * from ({_RULE_SQL})), r as (select unnest([{', '.join(repr(r['name']) for r in RULES)}]) as rule) select r.rule, count(v.rule) as violations, count(v.rule) = 0 as passed from r left join v using (rule) group by 1"))
def policy_rule_detail(spark, d):
    return C.policy_rules(_n(spark, d), _e(spark, d), RULES)


@query()
def preflight_files(spark, d):
    return C.preflight(_n(spark, d), _e(spark, d), _changed(spark, d))


@query(_g("""k as (select n.file, (select count(*) from e where e.target = n.id) as i from n where file is not null)
select file, cast(sum(i) as bigint) as fan_in, max(i) as max_fan_in, case when max(i) >= 10 or sum(i) >= 50 then 'high' when max(i) >= 5 or sum(i) >= 20 then 'medium' else 'low' end as risk from k group by 1"""))
def preflight_client(spark, d):
    return C.fan_in_risk(_n(spark, d), _e(spark, d))


# Mutual reachability of what is left of the edges once leaves are gone.
_SCC = """t as (select distinct source as src, target as dst from e where source <> target),
t1 as (select * from t where src in (select dst from t) and dst in (select src from t)), t2 as (select * from t1 where src in (select dst from t1) and dst in (select src from t1)),
t3 as (select * from t2 where src in (select dst from t2) and dst in (select src from t2)), t4 as (select * from t3 where src in (select dst from t3) and dst in (select src from t3)),
t5 as (select * from t4 where src in (select dst from t4) and dst in (select src from t4)), t6 as (select * from t5 where src in (select dst from t5) and dst in (select src from t5)),
w(src, dst) as (select src, dst from t6 union select w.src, t6.dst from w join t6 on w.dst = t6.src),
c as (select a1.src as id, least(a1.src, min(a1.dst)) as scc from w a1 join w b1 on a1.src = b1.dst and a1.dst = b1.src where a1.src <> a1.dst group by a1.src)"""


@query(_g(_SCC + " select id, scc from c", recursive=True))
def cycles(spark, d):
    return Y.components(_e(spark, d))


@query(_g(_SCC + """, p as (select id, max(case when json_valid(properties) and json_extract(properties, '$.llm') is not null then 1 else 0 end) as llm from nodes where id is not null group by 1)
select scc, count(*) as size, case when max(coalesce(p.llm, 0)) = 1 then 'llm_involved' when max(case when n.kind = 'medium' then 1 else 0 end) = 1 then 'data_persistent' else 'pure_code' end as kind from c left join n using (id) left join p using (id) group by 1""", recursive=True))
def classify_cycles(spark, d):
    return Y.classify(_n(spark, d), Y.components(_e(spark, d)), table(spark, d, "nodes").select("id", "properties"))


_THREADS = "y as (select target as id, count(distinct source) as accessors, count(distinct case when kind = 'writes' then source end) as writers from e where kind in ('reads','writes','shares') and target in (select id from n where kind = 'medium') group by 1 having count(distinct source) > 1)"


@query(_g(_THREADS + " select id, accessors, writers > 1 as concurrent_write, case when accessors > 3 then 'high' else 'medium' end as risk from y"))
def thread_report(spark, d):
    return C.thread_report(_n(spark, d), _e(spark, d))


@query(_g(_SCC + ", " + _THREADS + """, q as (select 'encapsulation' as name, (select count(*) from e where coupling_depth >= 4) as n, 'medium' as severity union all select 'cycles', (select count(distinct scc) from c), case when (select count(distinct scc) from c) > 5 then 'high' else 'medium' end
 union all select 'thread_conflicts', (select count(*) from y), case when (select count(*) from y) > 3 then 'high' else 'low' end) select * from q where n > 0""", recursive=True))
def blindspots(spark, d):
    n, e = _n(spark, d), _e(spark, d)
    return C.blindspot_rows(e, Y.components(_e(spark, d)), C.thread_report(n, e))


@query(_g(_SCC + """, k as (select (select count(*) from n) as nodes, (select count(*) from e) as edges, (select count(distinct scc) from c) as cycles, (select count(*) from e where coupling_depth >= 4) as l4)
select nodes, edges, cycles, l4, least(least(edges / nodes, 5.0) / 5 * 40 + greatest(1 - cycles / 20, 0) * 10 + greatest(1 - least(nodes, 20) / 20, 0) * 20 + greatest(1 - l4 / edges, 0) * 30, 100) as score, case when edges / nodes > 2 then 'healthy' when edges > 0 then 'stable' else 'empty' end as trend from k""", recursive=True))
def health(spark, d):
    return C.health(_n(spark, d), _e(spark, d), Y.components(_e(spark, d)))


@query(_g("select least(100.0 * (select count(*) from e where coupling_depth >= 4) / (select count(*) from n), 100.0) as density, (100 - least(100.0 * (select count(*) from e where coupling_depth >= 4) / (select count(*) from n), 100.0)) * 0.6 + 40 as score"))
def density_health(spark, d):
    return C.density_health(_e(spark, d), _n(spark, d))


@query(_g("""q as (select id as source, coalesce(contains(lower(file), 'test') or contains(lower(file), 'spec'), false) or coalesce(regexp_matches(lower(name), '^(test|it_|should_)|_test'), false) as test from n)
select target as id, count(*) filter (where not test) as dependents, count(*) filter (where test) as tests from (select distinct source, target from e) join q using (source) where target in (select id from n) group by 1"""))
def test_dependents(spark, d):
    return C.dependents(_n(spark, d), _e(spark, d))


@query(_g(_SEED + ", s1 as (select id from s0 union select dst from h join s0 on src = s0.id), " + _ENDS + " select distinct sn as source_name, tn as target_name, kind from x where source in (select id from s1) and target in (select id from s1)"))
def explore_relationships(spark, d):
    n, e = _n(spark, d), _e(spark, d)
    return C.relationships(n, e, V.layers(G.adjacency(e), _first(spark, d), 1))


_CHANGED = "c as (select distinct file from timeline where event_type = 'file_modified' and file is not null and file <> '')"


def _changed(spark, d):
    return table(spark, d, "timeline").where("event_type = 'file_modified' and file <> ''").select("file").distinct()


# The fixed patterns, written out; the earlier graph is what no type resolution has added to.
_B = "b as (select source, target, case when lower(trim(kind)) in (" + _ALL + ") then lower(trim(kind)) else 'calls' end as kind, min(coalesce(coupling_depth, 0)) as coupling_depth from edges where source is not null and target is not null and not coalesce(lsp_resolved, false) group by 1, 2, 3)"
_SIGNALS = r"""m as (select file from c where regexp_matches(file, 'migrations?/|alembic/|\b\d{4,}_.*\.(py|sql)$|\.sql$|schema.*\.(py|sql)$|\bschema\.sql\b|\bmigrate\b.*\.(py|sql)$')),
 z as (select file from c where regexp_matches(file, '\.(proto|fbs|avsc|thrift|capnp)$')),
 g as (select file from c where regexp_matches(file, '\.(yaml|yml|toml|json|ini|cfg|env|conf)$|\.env\.|(settings|config)\.py$')),
 r as (select 5 as level, 'migration' as reason, file, '' as source, '' as target, 1 as n from m union all select 5, 'serialization', file, '', '', 1 from z union all select 5, 'configuration', file, '', '', 1 from g
 union all select 4, 'temporal', '', '', '', k - was from (select (select count(*) from e where coupling_depth >= 4) as k, (select count(*) from b where coupling_depth >= 4) as was) where k > was
 union all select 3, 'shared', '', source, target, 1 from e where coupling_depth >= 3 and source in (select n.id from n join c on n.file = c.file or ends_with(n.file, '/' || c.file) or starts_with(n.file, c.file || '/')))"""


def _check(spark, d):
    """Signals without circles, which have queries of their own."""
    before = G.canonical_edges(table(spark, d, "edges").where("not coalesce(lsp_resolved, false)"))
    return C.signals(_changed(spark, d), _n(spark, d), _e(spark, d), before, cycles=False)


@query(_g(_B + ", " + _CHANGED + ", " + _SIGNALS + " select level, reason, file, source, target, cast(n as bigint) as n from r"))
def check_signals(spark, d):
    return _check(spark, d)


@query(_g(_B + ", " + _CHANGED + ", " + _SIGNALS + " select count(*) filter (where level in (4, 5)) as violations, count(*) filter (where level not in (4, 5)) as passed from r"))
def check_constraints(spark, d):
    return C.constraints(_check(spark, d))


@query(_g(_B + ", " + _CHANGED + ", " + _SIGNALS + " select level, count(*) as n from r group by 1"))
def check_summary(spark, d):
    return _check(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(_g("select id, name from n where contains(lower(name), 'cache') or contains(lower(id), 'cache')"))
def search_substring(spark, d):
    return S.substring(_n(spark, d), "Cache").select("id", "name")


@query(_g(r"""w as (select id, list_reduce(list_prepend('', [' ' || replace(trim(regexp_replace(lower(coalesce(x, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ', '  ') || ' ' for x in [name, id, location]]), lambda a, b: a || '  ' || b) as t from n)
select id, cast((length(t) - length(replace(t, ' store  cache ', ''))) / 14 as int) as hits from w where contains(t, ' store  cache ')"""))
def search_phrase(spark, d):
    return S.phrase(_n(spark, d), "store cache")


@query(_g(r"""w as (select id, unnest(string_split(trim(regexp_replace(lower(concat_ws(' ', name, id, location)), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) as term from n) select term, id, count(*) as tf from w where term <> '' group by 1, 2"""))
def search_index(spark, d):
    return S.inverted_index(_n(spark, d))


@query()
def search_ranked(spark, d):
    n = _n(spark, d)
    return S.ranked(S.inverted_index(n), n.count(), "graph cache view")


@query(r"""with l as (select path, unnest(string_split_regex(source, '\r?\n')) as text from sources where path is not null and source is not null) select path, count(*) as n from l where regexp_matches(text, '(?i)todo|fixme') group by 1""")
def grep_counts(spark, d):
    return S.grep_counts(table(spark, d, "sources"), "todo|fixme")


@query()
def source_windows(spark, d):
    return S.source_windows(_n(spark, d), table(spark, d, "sources"))


_LATEST = "t as (select * from (select *, row_number() over (partition by id order by timestamp desc, event_type desc, file desc, summary desc, properties desc) as r from timeline where id is not null) where r = 1)"


@query("with " + _LATEST + " select id, timestamp, event_type, file from t order by id desc limit 50")
def timeline_latest(spark, d):
    return T.latest(table(spark, d, "timeline"), 50).select("id", "timestamp", "event_type", "file")


@query("with " + _LATEST + " select file, count(*) as n, max(timestamp) as last from t where file <> '' and timestamp >= (select max(timestamp) from timeline) - interval 30 day group by 1 having count(*) >= 3")
def hotspots(spark, d):
    return T.hotspots(table(spark, d, "timeline"))


@query("with " + _LATEST + """, m as (select id, timestamp, max(timestamp) over (order by id rows between unbounded preceding and 1 preceding) as top from t)
select id, timestamp, epoch(date_trunc('second', top))::bigint - epoch(date_trunc('second', timestamp))::bigint as behind_s from m where epoch(date_trunc('second', top))::bigint - epoch(date_trunc('second', timestamp))::bigint > 86400""")
def timeline_late(spark, d):
    return T.late_entries(table(spark, d, "timeline"))


@query("with " + _LATEST + ", " + _G + """, r as (select file, id as entry from (select *, row_number() over (partition by file order by id desc) as k from t where file <> '') where k <= 20)
select n.id, (select count(*) from e where source = n.id) as dependencies, (select count(*) from e where target = n.id) as dependents, r.entry from n join r using (file)""")
def node_history(spark, d):
    return T.history(_n(spark, d), _e(spark, d), table(spark, d, "timeline"))


@query("""with s as (select id, min(name) as name from node_snapshots where snapshot_id = (select max(snapshot_id) from node_snapshots) and id is not null group by 1), n as (select id, min(name) as name from nodes where id is not null group by 1)
select id, name from s union all select id, name from n where id not in (select id from s)""")
def upsert_nodes(spark, d):
    s = table(spark, d, "node_snapshots")
    new = s.join(s.agg(F.max("snapshot_id").alias("snapshot_id")), "snapshot_id", "left_semi")
    pick = lambda df: G.canonical_nodes(df).select("id", "name")
    return T.upsert(pick(table(spark, d, "nodes")), pick(new), "id")


@query(_g("x as (select id from n where kind = 'medium') select kind, count(*) as n from e where source not in (select id from x) and target not in (select id from x) group by 1"))
def remove_nodes(spark, d):
    n = _n(spark, d)
    return T.remove_nodes(n, _e(spark, d), n.where("kind = 'medium'"))[1].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_g("select case when name = 'inner' then 'nested' else name end as name, count(*) as n from n group by 1"))
def rename_nodes(spark, d):
    return T.rename(_n(spark, d), "inner", "nested").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query()
def communities(spark, d):
    return M.communities(_n(spark, d), _e(spark, d))


@query()
def community_labels(spark, d):
    n, e = _n(spark, d), _e(spark, d)
    top = M.communities(n, e, levels=1)
    return M.labels(top.select("id", "community"), n)


@query(_g("select fam, count(*) as n from (select case when kind in ('imports','calls','inherits','defines') then 'structural' when kind in ('reads','writes','shares') then 'data' else 'temporal' end as fam from e) group by 1").replace("fam", "family"))
def edge_families(spark, d):
    from loomgraph.functions.columns import family

    return _e(spark, d).groupBy(family("kind").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def _records(spark, d):
    from loomgraph.operators import extract as X

    return X, X.records(table(spark, d, "sources"))


@query()
def extract_nodes(spark, d):
    X, rec = _records(spark, d)
    return X.nodes(rec)


@query()
def extract_edges(spark, d):
    X, rec = _records(spark, d)
    return X.edges(rec)


@query()
def extract_routes(spark, d):
    X, rec = _records(spark, d)
    return X.routes(rec)


@query()
def extract_callbacks(spark, d):
    X, rec = _records(spark, d)
    return X.callbacks(rec)


@query()
def resolved_calls(spark, d):
    X, rec = _records(spark, d)
    return X.resolved_calls(rec)


@query()
def dataflow(spark, d):
    X, rec = _records(spark, d)
    return X.flows(rec)


@query()
def shared_variables(spark, d):
    X, rec = _records(spark, d)
    return X.shared_variables(rec)


@query()
def extract_errors(spark, d):
    X, rec = _records(spark, d)
    return X.errors(rec)


@query()
def file_diff(spark, d):
    from loomgraph.operators.incremental import file_diff

    return file_diff(*_pair(spark, d))
