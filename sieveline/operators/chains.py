"""Depths in chains of rows that each name the row before them, by doubling: as many joins as the longest chain has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import cut


def depths(links: DataFrame, key: str, before: str) -> DataFrame:
    """(key, depth): what a recursion from the rows without ``before`` reaches, one row for each path, and after how many steps.

    A row climbs to the row that it has reached so far, and takes over what that one has climbed. A row whose chain leads to
    no start, as its end is missing or it runs in a circle, is not reached. Repeated keys give a row each, as in SQL.
    """
    links = links.select(F.col(key).alias("key"), F.col(before).alias("at"))
    # at: where the climb goes on, null once it is over.
    climbed = cut(links.withColumn("depth", F.when(F.col("at").isNull(), 0).otherwise(1)))
    steps, most = 1, climbed.select("key").distinct().count()
    # A path of more steps than there are keys runs in a circle.
    while steps <= most and not climbed.where("at IS NOT NULL").isEmpty():
        further = climbed.select(F.col("key").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        moved = climbed.where("at IS NOT NULL").join(further, "at").select("key", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"))
        climbed, steps = cut(climbed.where("at IS NULL").unionByName(moved)), 2 * steps
    return climbed.where("at IS NULL").select(F.col("key").alias(key), "depth")
