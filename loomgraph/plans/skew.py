"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1 / (HOT_SHARE * partitions) of the rows.
HOT_SHARE = 4


def lookup_join(rows: DataFrame, unique: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``unique`` (one row per ``key``) without a hot task.

    Keys are counted with a map-side combine. Those above the hot share (at
    most ``HOT_SHARE`` times the number of shuffle partitions, whatever the
    size of the data) are looked up by broadcast of their few rows; all others
    by an ordinary shuffle join. Rows with a null key find nothing.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bound = HOT_SHARE * parts
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n"), key).limit(bound + 1).collect()
    total = rows.count() if len(top) > bound else sum(r["_n"] for r in top)
    hot = [r[key] for r in top if r["_n"] * bound > total and r["_n"] > 10_000][:bound]
    if not hot:
        return rows.join(unique, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = rows.where(~is_hot).join(unique, key, how)
    few = unique.where(F.col(key).isin(hot))
    return cold.unionByName(rows.where(is_hot).join(F.broadcast(few), key, how))
