"""The open-cleared rule over a run log that arrives as a stream; its result equals the batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sieveline.operators.runlog import FIELDS, well_formed
from sieveline.session import scratch

KEYS = ("trial_id", "event_name", "stage", "event_class")


def _step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Last line and state of an identity are kept; lines of one micro-batch are taken by log_id, repeated ones once."""
    last, before = state.get if state.exists else (-1, "")
    bad = []
    for log_id, now in sorted({(int(i), s) for b in batches for i, s in zip(b["log_id"], b["state"])}):
        if log_id <= last:
            continue
        if now == "cleared" and before != "open":
            bad.append(log_id)
        last, before = log_id, now
    state.update((last, before))
    yield pd.DataFrame({"log_id": pd.Series(bad, dtype="int64")})


def stream(lines: DataFrame) -> DataFrame:
    """Flagged log_ids of a streaming run log."""
    formed = lines.select(*FIELDS).where(well_formed())
    return formed.groupBy(*KEYS).applyInPandasWithState(_step, "log_id long", "last long, before string", "append", "NoTimeout")


def run_once(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Read what is at ``path`` as a stream until it ends; the flagged lines as a table in the shared folder."""
    schema = spark.read.parquet(path).schema
    out = scratch(spark, "stream")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # A stream watches directories; a single file is picked out of its own.
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    source = reader.parquet(path)
    query = stream(source).writeStream.format("parquet").option("checkpointLocation", out + "-state").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("log_id long").parquet(out)
