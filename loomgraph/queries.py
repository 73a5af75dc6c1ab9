"""Queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import hierarchy as H
from loomgraph.operators import keyed as K
from loomgraph.operators import snapshots as S
from loomgraph.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DEGREES = "select target, count(*) as n_rows, count(distinct (source, lower(trim(kind)))) as n_distinct from edges where target is not null group by target"


@query(f"""with d as ({_DEGREES}), n as (select id, max(in_degree) as stored from nodes where id is not null and in_degree is not null group by id)
select n.id from n left join d on d.target = n.id where n.stored <> coalesce(d.n_distinct, 0)""")
def p1_found(spark, d):
    return K.stale_in_degrees(table(spark, d, "nodes"), table(spark, d, "edges")).select("id")


@query(_DEGREES)
def p1_in_degrees(spark, d):
    return K.in_degrees(table(spark, d, "edges"))


@query("""with s as (select snapshot_id, id, max_by((name, kind, location, out_degree, in_degree), coalesce(loaded_at, timestamp '0001-01-01')) as v from node_snapshots
where snapshot_id is not null and id is not null group by 1, 2),
o as (select snapshot_id, lead(snapshot_id) over (order by snapshot_id) as next_id from (select distinct snapshot_id from s)),
a as (select o.next_id as snapshot_id, id, v from s join o using (snapshot_id) where o.next_id is not null),
b as (select * from s where snapshot_id > (select min(snapshot_id) from s))
select snapshot_id, id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as change_type
from a full join b using (snapshot_id, id) where a.id is null or b.id is null or a.v is distinct from b.v""")
def p2_found(spark, d):
    return S.snapshot_changes(table(spark, d, "node_snapshots"))


_TREE = """with recursive l as (select distinct source, target from edges where lower(trim(kind)) = 'defines' and source is not null and target is not null),
ids as (select source as id from l union select target from l),
t(id, root, depth) as (select id, id, 0 from ids where id not in (select target from l) union all select l.target, t.root, t.depth + 1 from t join l on l.source = t.id)
"""


@query(_TREE + "select ids.id, coalesce(t.root, '') as root, coalesce(t.depth, -1) as depth from ids left join t using (id)")
def p5_found(spark, d):
    return H.hierarchy(H.containment(table(spark, d, "edges")))


def _paths(spark, d):
    return H.hierarchy(H.containment(table(spark, d, "edges")), paths=True)


@query(_TREE.replace("t(id, root, depth)", "t(id, root, depth, path)").replace("select id, id, 0 from", "select id, id, 0, id from").replace("t.depth + 1 from", "t.depth + 1, t.path || ' > ' || l.target from") + "select ids.id, coalesce(t.path, '') as path from ids left join t using (id)")
def p5_paths(spark, d):
    return _paths(spark, d).select("id", F.array_join("path", " > ").alias("path"))


@query("""with recursive l as (select distinct source, target from edges where lower(trim(kind)) = 'defines' and source is not null and target is not null),
ids as (select source as id from l union select target from l),
t(id, anc, distance) as (select id, [id], 0 from ids where id not in (select target from l) union all select l.target, list_append(t.anc, l.target), t.distance + 1 from t join l on l.source = t.id),
x as (select t.id as descendant, distance as depth, unnest(anc) as id, generate_subscripts(anc, 1) - 1 as pos from t)
select id, descendant, cast(depth - pos as int) as distance from x where pos < depth""")
def p5_descendants(spark, d):
    return H.descendants(_paths(spark, d))
