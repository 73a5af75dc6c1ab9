"""What changed between full snapshots (problem 2).

Each delivery of a record is reduced to 16 bytes over the compared columns.
Consecutive snapshots meet in a full outer join on the primary key: a missing
side is an addition or a removal, unequal hashes are a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import row_hash

COMPARED = ("name", "kind", "location", "out_degree", "in_degree")


def snapshot_changes(snapshots: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """``snapshot_id, id, change_type`` of every snapshot after the first.

    Within a snapshot the row of an id with the latest ``loaded_at`` counts (a
    null one is the earliest; among ties the largest hash, so the result does
    not depend on the order of rows). Rows that lack a snapshot_id or an id are
    left out. The predecessor is the delivered snapshot next below, whatever
    the gap. Columns not compared are not read.
    """
    rows = snapshots.where("snapshot_id is not null and id is not null")
    # max over a struct combines on the map side, so repeated deliveries do not travel
    latest = F.max(F.struct(F.col("loaded_at"), row_hash(*compared).alias("hash")))
    state = rows.groupBy("snapshot_id", "id").agg(latest.alias("latest")).select("snapshot_id", "id", F.col("latest.hash").alias("hash"))
    # One row per delivered snapshot.
    ids = rows.select("snapshot_id").distinct()
    steps = ids.select("snapshot_id", F.lead("snapshot_id").over(Window.orderBy("snapshot_id")).alias("next_id")).where("next_id is not null")
    follow = {r["snapshot_id"]: r["next_id"] for r in steps.collect()}
    if not follow:
        return state.where("false").select("snapshot_id", "id", F.lit("").alias("change_type"))
    later = F.create_map(*[F.lit(x) for pair in follow.items() for x in pair])
    kind = snapshots.schema["snapshot_id"].dataType
    old = state.select(F.try_element_at(later, F.col("snapshot_id")).cast(kind).alias("snapshot_id"), "id", F.col("hash").alias("old")).where("snapshot_id is not null")
    new = state.where(F.col("snapshot_id") != min(follow)).select("snapshot_id", "id", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, ["snapshot_id", "id"], "full_outer").select("snapshot_id", "id", change.alias("change_type")).where("change_type is not null")
