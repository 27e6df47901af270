"""A sample that stays the same over reruns and keeps its rows as data grow.

Selected keys are kept in a ledger, a table of one directory per step. A step keeps every earlier key by a join and fills the growth of
the quota from unseen keys with the lowest hash priority. The key of a row is its trimmed id; a row with a missing or
blank id is its own key, and rows that share an id are chosen together.

A step is written once: beside the ledger first, then put in place by a rename that fails if the step is there. A step that is run again
gives back the ledger as it was after that step; a write that broke off leaves nothing behind that is read.

An empty table selects nothing; ids are compared as written but for outer white space; repeated steps over the same data add nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import strip
from sieveline.operators import priority as P

SEED = "sample-1"
PERCENT = 10


def row_key(ident: Column, row: Column) -> Column:
    trimmed = strip(ident)
    return F.when(trimmed != "", F.concat(F.lit("id:"), trimmed)).otherwise(F.concat(F.lit("row:"), row.cast("string")))


class Ledger:
    """The steps at a path of any Hadoop file system."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def steps(self) -> list[int]:
        """Numbers of the steps in place; a few directory names."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)))
        return sorted(int(n.removeprefix("step=")) for n in names if n.startswith("step="))

    def read(self, upto: int) -> DataFrame:
        """(key, step) of the steps up to one."""
        there = [f"{self.path}/step={n:04d}" for n in self.steps() if n <= upto]
        if not there:
            return self.spark.createDataFrame([], "key string, step int")
        return self.spark.read.schema("key string, step int").option("basePath", self.path).parquet(*there)

    def add(self, keys: DataFrame, step: int) -> None:
        """Write a step; if another run has put it in place meanwhile, that one stays."""
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        keys.write.parquet(draft)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(draft).toUri(), self._conf) if self._at(draft).toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(kind, 1)
        never[0] = kind.NONE
        try:
            files.rename(self._at(draft), self._at(f"{self.path}/step={step:04d}"), never)
        except Exception:
            self._fs.delete(self._at(draft), True)
            if step not in self.steps():
                raise


def extend(rows: DataFrame, path: str, step: int, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """Add a step to the ledger at ``path`` so that it has ``percent`` of the distinct keys of ``rows``, rounded up; return the ledger up to the step.

    A step that is there is returned as it is, whatever ``rows`` are; one before the last cannot be put in.
    """
    ledger = Ledger(rows.sparkSession, path)
    there = ledger.steps()
    if step in there:
        return ledger.read(step)
    if there and step < there[-1]:
        raise ValueError(f"step {step} comes before step {there[-1]}, which is there")
    kept = ledger.read(step - 1)
    ranked = rows.select(row_key(F.col("id"), F.col("row_id")).alias("key")).distinct().withColumn("priority", P.priority(seed, F.col("key")))
    unseen = ranked.join(kept.select("key"), "key", "left_anti") if there else ranked
    # Kept keys count towards the quota, also those that no longer occur.
    still = ranked.join(kept.select("key"), "key", "left_semi").count() if there else 0
    fresh = P.shard_totals(unseen)
    quota = max(0, -(-(sum(fresh.values()) + still) * percent // 100) - (kept.count() if there else 0))
    ledger.add(P.below(unseen, fresh, quota, "key").select("key"), step)
    return ledger.read(step)


def sample(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(row_id, step): the rows whose key is in the ledger and the step that chose it."""
    return rows.select("row_id", row_key(F.col("id"), F.col("row_id")).alias("key")).join(ledger, "key").select("row_id", "step")
