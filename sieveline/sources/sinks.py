"""Sinks of results and the transfer record of a selected configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_table(df: DataFrame) -> DataFrame:
    """One text column: each row's values joined by a bar, for people."""
    return df.select(F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("line"))


def write_transfer(best: DataFrame, path: str) -> None:
    """Best configurations with their version and fingerprint."""
    body = F.concat_ws("|", F.col("project_id").cast("string"), "config", F.col("mean_score").cast("string"))
    best.select(F.lit(VERSION).alias("version"), "project_id", "config", "mean_score", F.sha2(body, 256).alias("fingerprint")).write.mode("overwrite").json(path)


def read_transfer(spark: SparkSession, path: str) -> DataFrame:
    """The record with ``accepted``: version and fingerprint are as written and the project has one configuration."""
    got = spark.read.schema("version int, project_id int, config string, mean_score double, fingerprint string").json(path)
    body = F.concat_ws("|", F.col("project_id").cast("string"), "config", F.col("mean_score").cast("string"))
    ok = F.coalesce((F.col("version") == VERSION) & (F.col("fingerprint") == F.sha2(body, 256)), F.lit(False))
    single = got.groupBy("project_id").agg((F.count("*") == 1).alias("single"))
    return got.join(single, "project_id").select("project_id", "config", "mean_score", (ok & F.col("single")).alias("accepted"))


_BASELINE = "project_id int, trial_id long, n_scored long, n_failed long, failure_types string, mean_score double"


def write_baseline(sweep: DataFrame, path: str) -> None:
    """The sweep of every configuration, by project, for later runs to compare with."""
    sweep.write.mode("errorifexists").partitionBy("project_id").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BASELINE).json(path)
