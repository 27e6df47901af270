"""A sample whose categories have given shares, and the targets that cannot be met.

One pass over the rows keeps a reservoir per task and category: its rows of lowest hash priority, how many it has seen, and from which
priority on it has dropped some. A reservoir holds twice what its target would take of the rows seen so far, and its minimum, so it grows with the data. Reservoirs
merge by putting their rows together, adding the counts and taking the least of the bounds. After the final counts each target is trimmed uniformly to its feasible
quota: all priority shards below the boundary stay and the boundary shard is ranked, so a category of any size is never gathered. Where the boundary lies beyond what
every task has kept (rows of a category may come together in few tasks), that target is drawn from the rows again, so the sample is always that of lowest priority.

Rows without a side or category belong to no target but count in the pool of their side. An empty pool
makes n zero, and then only ``min_rows`` is asked for. A target without a share or minimum counts it as zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import side, strip
from sieveline.operators import priority as P
from sieveline.session import cut

SEED = "quota-1"
BY = ["side", "category_field", "category"]
#: Rows that a reservoir holds besides its share, and how full it runs before it is trimmed.
SPARE, ROOM = 64, 4
#: Hex digits of a priority; 60 bits, which order rows before their id does.
DIGITS = 15


def pooled(rows: DataFrame) -> DataFrame:
    """(row_id, side, category_field, category, priority); the category of a tuning row is its difficulty, else its coverage."""
    s = side(F.col("split"))
    difficulty = F.replace(F.lower(strip(F.col("difficulty"))), F.lit("_"), F.lit("-"))
    return rows.select("row_id", s.alias("side"), F.when(s == "tuning", "difficulty").otherwise("coverage").alias("category_field"), F.when(s == "tuning", difficulty).otherwise(F.col("coverage")).alias("category"), F.substring(P.priority(SEED, F.col("row_id")), 1, DIGITS).alias("priority")).where("side IS NOT NULL")


def report(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: rows of the pool, n, needed, available and taken rows and whether the category is exhausted."""
    pool = counts.groupBy("side").agg(F.sum("n").alias("pool_rows"))
    there = counts.groupBy(*BY).agg(F.sum("n").alias("available"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    joined = targets.join(pool, "side", "left").join(there, BY, "left")
    n = F.expr("(coalesce(pool_rows, 0) * coalesce(sample_pct, 0)) div 100")
    needed = F.greatest(zero("min_rows"), F.expr("(coalesce(share_pct, 0) * n + 99) div 100"))
    return joined.withColumn("n", n).select(
        "target_id", "side", "category_field", "category", zero("pool_rows").alias("pool_rows"), "n", needed.alias("needed"), zero("available").alias("available"),
    ).withColumn("taken", F.least("needed", "available")).withColumn("exhausted", F.col("available") < F.col("needed"))


class Reservoir:
    """The rows of lowest priority of one category, as one task sees them."""

    def __init__(self, share: float, least: int):
        self.share, self.least, self.n, self.kept_to = share, least, 0, None
        self.rows, self.priorities = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.held = 0

    def add(self, rows: np.ndarray, priorities: np.ndarray) -> None:
        self.n += len(rows)
        if self.kept_to is not None:
            low = priorities < self.kept_to
            rows, priorities = rows[low], priorities[low]
        self.rows.append(rows)
        self.priorities.append(priorities)
        self.held += len(rows)

    def trim(self, pool: int) -> None:
        """Keep the rows of lowest priority, given the rows of the side so far."""
        room = 2 * int(np.ceil(self.share * pool)) + self.least + SPARE
        if self.held <= ROOM * room:
            return
        rows, priorities = np.concatenate(self.rows), np.concatenate(self.priorities)
        self.kept_to = int(np.partition(priorities, room)[room])
        low = priorities < self.kept_to
        self.rows, self.priorities, self.held = [rows[low]], [priorities[low]], int(low.sum())


def reservoirs(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(side, category_field, category, row_id, priority, n, kept_to): the rows of each task's reservoirs, and without a row_id what a task says of a category.

    ``n`` counts its rows; rows whose priority is ``kept_to`` or more may be missing, none if it is null. Categories without a target are counted only.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    asked = cut(targets.groupBy(*BY).agg(F.max(zero("share_pct") * zero("sample_pct") / 10_000).alias("share"), F.max(zero("min_rows")).cast("long").alias("least")))
    # So that rows stay in their tasks; more categories than this are joined by shuffle.
    few = asked.count() <= P.BROADCAST_GROUPS
    named = pooled(rows).join(F.broadcast(asked) if few else asked, BY, "left").withColumn("p", F.conv("priority", 16, 10).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, Reservoir] = {}
        pools: dict[str, int] = {}
        for batch in batches:
            pools_now, places = np.unique(batch.column("side").to_numpy(zero_copy_only=False), return_counts=True)
            for s, n in zip(pools_now, places):
                pools[s] = pools.get(s, 0) + int(n)
            keys = list(zip(*(batch.column(c).to_pylist() for c in BY)))
            codes: dict[tuple, int] = {}
            code = np.fromiter((codes.setdefault(k, len(codes)) for k in keys), np.int64, len(keys))
            ids, p = batch.column("row_id").to_numpy(), batch.column("p").to_numpy()
            share, least = batch.column("share").to_pylist(), batch.column("least").to_pylist()
            for key, c in codes.items():
                at = np.flatnonzero(code == c)
                if key not in seen:
                    seen[key] = Reservoir(share[at[0]] or 0.0, least[at[0]] or 0)
                mine = seen[key]
                if share[at[0]] is None:
                    mine.n += len(at)
                else:
                    mine.add(ids[at], p[at])
                    mine.trim(pools[key[0]])
        names = [*BY, "row_id", "p", "n", "kept_to"]
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for key, mine in seen.items():
            ids, p = np.concatenate(mine.rows), np.concatenate(mine.priorities)
            m = len(ids)
            columns = [[k] * (m + 1) for k in key] + [[*ids.tolist(), None], [*p.tolist(), None], [None] * m + [mine.n], [None] * m + [mine.kept_to]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    made = named.select(*BY, "row_id", "p", "share", "least").mapInArrow(run, "side string, category_field string, category string, row_id long, p long, n long, kept_to long")
    return made.select(*BY, "row_id", F.lpad(F.lower(F.hex("p")), DIGITS, "0").alias("priority"), "n", F.lpad(F.lower(F.hex("kept_to")), DIGITS, "0").alias("kept_to"))


def counts(reservoirs: DataFrame) -> DataFrame:
    """(side, category_field, category, n, kept_to): the merged summaries; as many rows as there are categories."""
    return cut(reservoirs.where("row_id IS NULL").groupBy(*BY).agg(F.sum("n").alias("n"), F.min("kept_to").alias("kept_to")))


def draw(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, row_id): of each target the rows of lowest priority, as many as feasible."""
    kept = cut(reservoirs(rows, targets))
    merged = counts(kept)
    named = targets.select("target_id", *BY)
    quotas = report(merged, targets).select("target_id", F.col("taken").alias("quota"))

    def ends(source: DataFrame, wanted: DataFrame) -> DataFrame:
        return P.boundaries(P.shard_counts(source, ["target_id"]), wanted, ["target_id"])

    held = kept.where("row_id IS NOT NULL").select(*BY, "row_id", "priority").join(named, BY).select("target_id", "row_id", "priority")
    bounds = named.join(merged.where("kept_to IS NOT NULL"), BY).select("target_id", F.substring("kept_to", 1, P.SHARD_DIGITS).alias("bound"))
    reached = cut(ends(held, quotas).join(bounds, "target_id", "left").withColumn("whole", F.coalesce(F.col("end_shard") < F.col("bound"), F.lit(True)) | (F.col("quota") == 0)))
    out = P.lowest(held, reached.where("whole").drop("bound", "whole"), ["target_id"], "row_id").select("target_id", "row_id")
    if reached.where("NOT whole").isEmpty():
        return out
    again = pooled(rows).join(named, BY).join(reached.where("NOT whole").select("target_id"), "target_id").select("target_id", "row_id", "priority")
    rest = ends(again, quotas.join(reached.where("NOT whole").select("target_id"), "target_id"))
    return out.unionByName(P.lowest(again, rest, ["target_id"], "row_id").select("target_id", "row_id"))
