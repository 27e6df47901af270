"""Queries of sources, sinks, scalar functions and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import scalar
from sieveline.operators import disclosure, experiments
from sieveline.plans.experiment_plans import SQL as EXPERIMENTS
from sieveline.plans.dataset_plans import strip
from sieveline.sources import jsonl, sinks
from sieveline.streaming import runlog_state
from sieveline.session import scratch, ship, table


def _lines(spark, d) -> str:
    """The labelled rows as JSON lines; rows without a split are written cut off, those without a difficulty as arrays."""
    path = scratch(spark, "lines")
    row = F.to_json(F.struct("row_id", "id", "input", "output", F.struct("split", "difficulty").alias("tags")))
    r = table(spark, d, "evaluation_rows")
    r.select(F.when(F.col("split").isNull(), F.lit('{"row_id": 1, "input": ')).when(F.col("difficulty").isNull(), F.concat(F.lit("["), row, F.lit("]"))).otherwise(row).alias("value")).write.text(path)
    return path


def jsonl_scan(spark, d):
    return jsonl.error_summary(jsonl.scan(spark, _lines(spark, d))).select("error", "n", "percent")


def jsonl_fields(spark, d):
    """Fields by dot path of the good rows, by split."""
    got = jsonl.mapped(jsonl.scan(spark, _lines(spark, d)), {"id": "row_id", "split": "tags.split", "difficulty": "tags.difficulty", "none": "tags..x"})
    return got.groupBy("split", "difficulty").agg(F.count("*").alias("n"), F.count("none").alias("nothing"), F.min(F.col("id").cast("long")).alias("first_id"))


def file_fingerprint(spark, d):
    """Files of the loads table and their length; the digests themselves are checked in tests."""
    return jsonl.fingerprints(spark, f"{d}/projects.parquet").agg(F.count("*").alias("n_files"), F.min(F.length("sha256")).cast("long").alias("digest_length"))


def transfer_record(spark, d):
    """Write the best configurations, read them back and verify them."""
    path = scratch(spark, "transfer")
    sinks.write_transfer(experiments.best_config(table(spark, d, "trials"), table(spark, d, "trial_scores")), path)
    return sinks.read_transfer(spark, path)


def secret_fingerprints(spark, d):
    return table(spark, d, "evaluation_rows").where("id IS NOT NULL").select("row_id", scalar.secret_fingerprint(F.col("id")).alias("fingerprint"), scalar.digest16(F.col("id")).alias("digest"))


def fence_round_trip(spark, d):
    """Outputs that do not survive wrapping and unwrapping: none."""
    return table(spark, d, "evaluation_rows").where("output IS NOT NULL").where(scalar.unfence(scalar.fence(F.col("output"))) != F.col("output")).select("row_id")


def token_permutations(spark, d):
    ship(spark)
    return table(spark, d, "evaluation_rows").where("output IS NOT NULL").select("row_id", scalar.token_permutation(F.col("output")).alias("permuted"))


def canonical_outputs(spark, d):
    ship(spark)
    r = table(spark, d, "evaluation_rows").where("output IS NOT NULL").select("row_id", scalar.canonical_json(F.col("output")).alias("canonical"))
    return r.where("canonical IS NOT NULL").select("row_id", F.length("canonical").alias("n_chars"))


#: Words whose digests the disclosure query looks for.
SECRETS = ("trainee", "auditor", "overnight", "migrated")


def disclosure_scan(spark, d):
    ship(spark)
    digests = spark.createDataFrame([(w,) for w in SECRETS], "w string").select(F.sha2("w", 256).alias("digest"), F.octet_length("w").alias("n_bytes"))
    return disclosure.disclosed(table(spark, d, "run_log"), "log_id", "detail", digests)


_PINS = (
    ("a", "1.2.0", "1.2", "keep"), ("b", "2.0", "1.9.9", "change"), ("c", "1.9", "1.10", "keep-newer"), ("e", "3.1", None, "install"), ("f", "2.0.1", "2.0.1", "keep"), ("g", "2.0", "2.0rc1", "change"), ("h", "1.0", "1!0.5", "keep-newer"),
    ("i", "1.0", "main", "change"), ("j", "", "1.0", "change"), ("k", "1.0.dev3", "1.0a1", "keep-newer"), ("l", "1.0", "1.0.post1", "keep-newer"), ("m", "main", "main", "keep"), ("n", "1.0rc2", "1.0RC-2", "keep"), ("o", "99999999999999999999", "3", "change"),
)


def version_guard(spark, d):
    pins = spark.createDataFrame([p[:2] for p in _PINS], "name string, version string")
    have = spark.createDataFrame([(n, v) for n, _, v, _ in _PINS if v], "name string, version string")
    return scalar.version_guard(pins, have)


def runlog_stream_state(spark, d):
    ship(spark)
    return runlog_state.run_once(spark, f"{d}/run_log.parquet")


_ALL = (jsonl_scan, jsonl_fields, file_fingerprint, transfer_record, secret_fingerprints, fence_round_trip, token_permutations, canonical_outputs, disclosure_scan, version_guard, runlog_stream_state)
QUERIES = {f.__name__: f for f in _ALL}

SQL = {
    "jsonl_scan": "WITH e AS (SELECT CASE WHEN split IS NULL THEN 'invalid JSON' WHEN difficulty IS NULL THEN 'row is not an object' END AS error FROM evaluation_rows) SELECT error, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM e), 4) AS percent FROM e WHERE error IS NOT NULL GROUP BY error",
    "jsonl_fields": "SELECT split, difficulty, count(*) AS n, 0::BIGINT AS nothing, min(row_id) AS first_id FROM evaluation_rows WHERE split IS NOT NULL AND difficulty IS NOT NULL GROUP BY ALL",
    "file_fingerprint": "SELECT 1::BIGINT AS n_files, 64::BIGINT AS digest_length",
    "transfer_record": EXPERIMENTS["best_config"].replace("SELECT * FROM bc", "SELECT project_id, config, mean_score, true AS accepted FROM bc"),
    "secret_fingerprints": f"SELECT row_id, substr(sha256({strip('id')}), 1, 8) AS fingerprint, substr(sha256(id), 1, 16) AS digest FROM evaluation_rows WHERE id IS NOT NULL",
    "fence_round_trip": "SELECT row_id FROM evaluation_rows WHERE false",
    "disclosure_scan": " UNION ALL ".join(f"SELECT DISTINCT log_id, sha256('{w}') AS digest FROM run_log WHERE contains(detail, '{w}')" for w in SECRETS),
    "version_guard": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{a}')" for n, _, _, a in _PINS) + ") t(name, action)",
    "runlog_stream_state": EXPERIMENTS["runlog_state_rule"],
}
