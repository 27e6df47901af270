"""JSON-lines sources: permissive and strict scans, fields by dot path, and files by fingerprint.

A permissive scan keeps every bad line as a finding and fails on none. Line numbers count blank lines, too. An empty file has no rows and no errors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of a text source.

    Lines are numbered without a global sort: blocks of a file are counted, and a line's place in its block is added to
    the lines of the blocks before it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("m").alias("low"))
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return raw.join(before.drop("n"), ["file", "block"]).select("file", (F.col("before") + F.col("m") - F.col("low") + 1).alias("line_no"), "value")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, row, error): ``row`` is a variant object or null, ``error`` its reason or null; blank lines are left out."""
    v = F.try_parse_json("value")
    lines = numbered(spark, path).where(F.col("value").rlike(r"(?U)\S"))
    error = F.when(v.isNull(), "invalid JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "row is not an object")
    return lines.select("file", "line_no", v.alias("row"), error.alias("error")).withColumn("row", F.when(F.col("error").isNull(), F.col("row")))


def error_summary(scanned: DataFrame) -> DataFrame:
    """Errors by cause, with the first line of each and their share of all rows in percent."""
    total = scanned.agg(F.count("*").alias("total"))
    by = scanned.where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
    return by.crossJoin(F.broadcast(total)).select("error", "n", "first_line", F.round(F.col("n") * 100 / F.col("total"), 4).alias("percent"))


def strict(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`scan`, but the first bad line fails the job."""
    s = scan(spark, path)
    return s.select("file", "line_no", F.when(F.col("error").isNull(), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("error"))).cast("variant")).alias("row"))


def field(row: Column, path: str, kind: str = "string") -> Column:
    """A field by dot path; null if absent. An empty part of the path is absent."""
    parts = path.split(".")
    return F.lit(None).cast(kind) if not all(parts) else F.try_variant_get(row, "$" + "".join(f"['{p}']" for p in parts), kind)


def present(row: Column, path: str) -> Column:
    """Whether a dot path is there, be it with a null."""
    parts = path.split(".")
    return F.lit(False) if not all(parts) else F.try_variant_get(row, "$" + "".join(f"['{p}']" for p in parts), "variant").isNotNull()


def mapped(scanned: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Good rows with columns by dot path; a row without an id is named by its line."""
    r = F.col("row")
    out = scanned.where("error IS NULL").select("line_no", *(field(r, p).alias(n) for n, p in mapping.items()))
    return out.withColumn("id", F.coalesce("id", F.concat(F.lit("line-"), F.col("line_no").cast("string")))) if "id" in mapping else out


#: What names of fields suggest.
SUGGESTIONS = {"input": r"^(input|question|prompt|query|text|message)$", "expected": r"^(output|expected|answer|label|target|gold)", "id": r"(^|_)(id|key|uuid)$"}


def suggest(schema_fields: list[str]) -> dict[str, list[str]]:
    """Candidate fields for input, expected output and id."""
    return {role: [f for f in schema_fields if re.search(p, f, re.I)] for role, p in SUGGESTIONS.items()}


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def dotenv(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, key, value) of KEY=VALUE lines; comments and lines of another form are left out, quotes are taken off."""
    m = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    v = F.regexp_extract("value", m, 2)
    bare = F.when(v.rlike(r"""^(['"]).*\1$"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(F.regexp_replace(v, r"\s+#.*$", ""))
    return numbered(spark, path).where(F.col("value").rlike(m) & ~F.col("value").rlike(r"^\s*#")).select("line_no", F.regexp_extract("value", m, 1).alias("key"), bare.alias("value"))


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """(name, version) of exact pins."""
    m = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*==\s*([^\s;#]+)"
    return spark.read.text(path).where(F.col("value").rlike(m)).select(F.lower(F.regexp_replace(F.regexp_extract("value", m, 1), "[._]", "-")).alias("name"), F.regexp_extract("value", m, 2).alias("version"))


def document(spark: SparkSession, value: str) -> DataFrame:
    """(row): the JSON of a file if there is one of that name, else of the text itself; what is no JSON fails the job. An array gives a row per item."""
    at = None if value.lstrip()[:1] in ("{", "[") else spark.sparkContext._jvm.org.apache.hadoop.fs.Path(value)
    there = at is not None and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    text = spark.read.text(value, wholetext=True) if there else spark.createDataFrame([(value,)], "value string")
    v = F.parse_json("value")
    listed = F.schema_of_variant(v).startswith("ARRAY")
    return text.select(F.explode(F.when(listed, v.cast("array<variant>")).otherwise(F.array(v))).alias("row"))
