"""The rows with the lowest hash priority of each group, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the priority that name a shard: 65,536 shards, each about 1/65,536 of its group.
SHARD_DIGITS = 4
#: Groups whose boundaries may be broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 100_000


def priority(seed: str, key: Column) -> Column:
    """Uniform, reproducible 128-bit priority of a key, in hex; lower is earlier."""
    return F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))


def shard_counts(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable summary of a reservoir: rows of each group and priority shard; partial sums before the shuffle."""
    return rows.groupBy(*groups, F.substring("priority", 1, SHARD_DIGITS).alias("shard")).agg(F.count("*").alias("n"))


def boundaries(counts: DataFrame, quotas: DataFrame, groups: list[str]) -> DataFrame:
    """Per group the shard where its quota ends and how many rows of that shard still fit."""
    w = Window.partitionBy(*groups).orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counts.join(quotas, groups).withColumn("upto", F.sum("n").over(w))
    first = F.struct("shard", (F.col("quota") - (F.col("upto") - F.col("n"))).alias("rest"))
    ended = running.where("upto >= quota").groupBy(*groups).agg(F.min(first).alias("end"))
    return quotas.join(ended, groups, "left").select(*groups, "quota", F.coalesce("end.shard", F.lit("~")).alias("end_shard"), F.coalesce("end.rest", F.lit(0)).alias("rest"))


def lowest(rows: DataFrame, ends: DataFrame, groups: list[str], tie: str) -> DataFrame:
    """The rows within the boundaries. Only the boundary shard of a group is ranked, by (priority, ``tie``)."""
    small = ends.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    known = rows.join(F.broadcast(ends) if small else ends, groups).where("quota > 0").withColumn("shard", F.substring("priority", 1, SHARD_DIGITS))
    w = Window.partitionBy(*groups, "shard").orderBy("priority", tie)
    whole = known.where("shard < end_shard")
    edge = known.where("shard = end_shard").withColumn("_at", F.row_number().over(w)).where("_at <= rest").drop("_at")
    return whole.unionByName(edge).drop("shard", "end_shard", "rest", "quota")


def shard_totals(rows: DataFrame) -> dict[str, int]:
    """Rows of each priority shard; at most 65,536 numbers, whatever the table's size."""
    return {r.shard: r.n for r in shard_counts(rows, []).collect()}


def below(rows: DataFrame, totals: dict[str, int], k: int, tie: str) -> DataFrame:
    """The ``k`` rows of lowest (priority, ``tie``), given their shard totals. Only the shard in which the ``k``-th row falls is ranked."""
    end, rest = "~", 0
    for shard in sorted(totals):
        if k <= totals[shard]:
            end, rest = shard, max(0, k)
            break
        k -= totals[shard]
    sharded = rows.withColumn("shard", F.substring("priority", 1, SHARD_DIGITS))
    edge = sharded.where(F.col("shard") == end).withColumn("_at", F.row_number().over(Window.partitionBy("shard").orderBy("priority", tie))).where(F.col("_at") <= rest).drop("_at")
    return sharded.where(F.col("shard") < end).unionByName(edge).drop("shard")


def first(rows: DataFrame, k: int, tie: str) -> DataFrame:
    """The ``k`` rows of lowest (priority, ``tie``). Tasks pass on these rows alone, not the first ``k`` of each."""
    return below(rows, shard_totals(rows), k, tie)
