"""Queries over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.llm import garbled, leaks, tokens
from sieveline.session import ship, table


def _documents(spark, d):
    ship(spark)
    return table(spark, d, "documents")


def p8_ids(spark, d):
    return tokens.encode(_documents(spark, d))


def p8_offsets(spark, d):
    """How many ids and pre-tokens each document has; the last start of a pre-token."""
    return tokens.encode(_documents(spark, d), offsets=True).select("doc_id", F.size("ids").alias("n_ids"), F.size("starts").alias("n_pretokens"), F.element_at(F.when(F.size("starts") > 0, F.col("starts")), -1).alias("last_start"))


def p9_found(spark, d):
    return leaks.verbatim(leaks.matched(table(spark, d, "benchmark_items"), _documents(spark, d)))


def p9_changed(spark, d):
    return leaks.changed(leaks.matched(table(spark, d, "benchmark_items"), _documents(spark, d)))


def p10_found(spark, d):
    return garbled.judged(_documents(spark, d)).select("doc_id")


def p10_restored(spark, d):
    return garbled.judged(_documents(spark, d)).select("doc_id", "restorable", "chain", "restored")


QUERIES = {f.__name__: f for f in (p8_ids, p8_offsets, p9_found, p9_changed, p10_found, p10_restored)}

SQL = {
    "p9_found": r"""WITH i AS (SELECT item_id, regexp_extract_all(lower(coalesce(input, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark_items),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS s FROM i WHERE len(w) >= 10),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS s FROM d WHERE len(w) >= 10)
SELECT DISTINCT item_id, doc_id FROM dw JOIN iw USING (s)""",
}
