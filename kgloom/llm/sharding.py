"""Sharding by longest-processing-time scheduling.

Rows with the same key form a group that stays together.  The scheduler sorts groups by size and hands each to the
least-loaded shard, which it finds through a heap.  So that the list of groups on the driver stays short at any
scale, only groups above a fixed share of all bytes are listed one by one; the others are listed in bundles (unions
of whole groups, dealt by a hash) whose expected sizes halve from level to level, so that the last things scheduled
are tiny and even out the shards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, materialise

#: A group of more than total / (shards * HEAVY) bytes is scheduled by itself: at most shards * HEAVY such groups.
HEAVY = 64
#: Levels of bundles, and bundles of each level for each shard.
LEVELS, BUNDLES = 14, 8


def least_loaded(sizes: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """The schedule: items by falling size (ties by key), each to the shard with the least load (ties: lowest)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign_shards(rows: DataFrame, shards: int, group: str, size: str) -> DataFrame:
    """``rows`` with ``shard`` (int, from 0), where rows of one ``group`` (a long) share a shard and bytes are even.

    A null ``group`` is a group like any other and a null ``size`` counts as 0.  Groups of equal size are scheduled by
    their number, so reruns agree; repeated rows are of one group and so share a shard.  A single group above the mean
    load of a shard still stays whole: its shard then exceeds the others.  An empty table gives no rows.  A column
    ``shard`` is replaced; others are kept whatever their names.
    """
    kept = rows.drop("shard") if "shard" in rows.columns else rows
    keys, names, own, shared = (fresh(kept.columns, x) for x in ("__key", "__name", "__own", "__shared"))
    # As text, so that the null group has a name that no number has.
    key = F.coalesce(column(group).cast("string"), F.lit("null"))
    groups = materialise(kept.groupBy(key.alias("g")).agg(F.sum(F.coalesce(column(size), F.lit(0))).cast("long").alias("bytes")), "groups").withColumn("bundle", _bundle(F.col("g"), shards))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = F.col("bytes") > F.lit(total / (shards * HEAVY))
    large = [(r.g, int(r.bytes)) for r in groups.where(heavy).select("g", "bytes").collect()]
    bundles = [(r.bundle, int(r.bytes)) for r in groups.where(~heavy).groupBy("bundle").agg(F.sum("bytes").alias("bytes")).collect()]
    assert len(large) <= shards * HEAVY and len(bundles) <= shards * BUNDLES * LEVELS
    plan = least_loaded(large + bundles, shards)

    spark = rows.sparkSession
    by_group = F.broadcast(spark.createDataFrame([(k, plan[k]) for k, _ in large], f"`{keys}` string, `{own}` int"))
    by_bundle = F.broadcast(spark.createDataFrame([(k, plan[k]) for k, _ in bundles], f"`{names}` string, `{shared}` int"))
    out = kept.withColumn(keys, key).withColumn(names, _bundle(F.col(keys), shards))
    out = out.join(by_group, keys, "left").join(by_bundle, names, "left")
    return out.select(*[column(c) for c in kept.columns], F.coalesce(own, shared).alias("shard"))


def _bundle(key: Column, shards: int) -> Column:
    """The bundle of a group: level 0 takes half of the groups, level 1 a quarter, and so on."""
    spread = F.xxhash64(key, F.lit("bundle"))
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        level = F.when(F.getbit(spread, F.lit(i)) == 0, F.lit(i)).otherwise(level)
    return F.concat_ws(":", level.cast("string"), F.pmod(F.shiftrightunsigned(spread, LEVELS), F.lit(shards * BUNDLES)).cast("string"))
