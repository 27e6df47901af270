"""Queries over the labelled rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.llm import formatting, groups, ledger, overlap, pairs, quota
from sieveline.session import cut, scratch, ship, table


def _rows(spark, d):
    ship(spark)
    return table(spark, d, "evaluation_rows")


def p2_found(spark, d):
    return overlap.cross_split_pairs(_rows(spark, d))


def p2_counts(spark, d):
    return overlap.overlap_counts(_rows(spark, d))


def p3_sample(spark, d):
    """Two steps of one ledger: after the first half of the loads and after all of them."""
    rows = _rows(spark, d)
    path = scratch(spark, "ledger")
    half = table(spark, d, "loads").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY load_id)")).first()[0]
    ledger.extend(rows.where(F.col("load_id") <= F.lit(half)), path, 1)
    return ledger.sample(rows, ledger.extend(rows, path, 2))


def p4_found(spark, d):
    return pairs.broken_pairs(_rows(spark, d), table(spark, d, "projects"), table(spark, d, "documents"))


def p5_found(spark, d):
    return groups.parted(_rows(spark, d))


def p5_splits(spark, d):
    return groups.assign(_rows(spark, d))


def p5_shares(spark, d):
    """Rows and groups that each split was given."""
    return groups.assign(_rows(spark, d)).groupBy("assigned").agg(F.count("*").alias("n_rows"), F.count_if(F.col("row_id") == F.col("group_id")).alias("n_groups"))


def p5_forest(spark, d):
    return groups.components(cut(groups.keyed(_rows(spark, d))))[1]


def p6_found(spark, d):
    return p6_report(spark, d).where("exhausted").select("target_id")


def p6_report(spark, d):
    targets = table(spark, d, "sample_targets")
    return quota.report(quota.counts(quota.reservoirs(_rows(spark, d), targets)), targets)


def p6_sample(spark, d):
    return quota.draw(_rows(spark, d), table(spark, d, "sample_targets"))


def p7_found(spark, d):
    return formatting.copies(_rows(spark, d))


def p7_collapsed(spark, d):
    return formatting.collapsed(_rows(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_sample, p4_found, p5_found, p5_splits, p5_shares, p5_forest, p6_found, p6_report, p6_sample, p7_found, p7_collapsed)}

_SIDE = """CASE WHEN lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) IN ('tune','tuning','train','search') THEN 'tuning'
  WHEN lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) IN ('holdout','held-out','heldout','held_out','test','validation','validate') THEN 'heldout' END"""

_PAIRS = rf"""WITH w AS (SELECT row_id, {_SIDE} AS side, regexp_extract_all(lower(coalesce(input, '') || ' ' || coalesce(output, '')), '[\p{{L}}\p{{N}}_]+') AS ws FROM evaluation_rows),
g AS (SELECT DISTINCT row_id, side, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s FROM w WHERE side IS NOT NULL),
n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
c AS (SELECT a.row_id AS t, b.row_id AS h, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.side = 'tuning' AND b.side = 'heldout' GROUP BY ALL),
pairs AS (SELECT least(t, h) AS row_id_a, greatest(t, h) AS row_id_b FROM c JOIN n x ON x.row_id = t JOIN n y ON y.row_id = h WHERE k * 10 >= 7 * (x.n + y.n - k))"""

_KEY = r"CASE WHEN trim(id, E' \t\n\r ') <> '' THEN 'id:' || trim(id, E' \t\n\r ') ELSE 'row:' || row_id END"

_POOL = f"""WITH s AS (SELECT row_id, {_SIDE} AS side, difficulty, coverage FROM evaluation_rows),
pool AS (SELECT row_id, side, CASE WHEN side = 'tuning' THEN 'difficulty' ELSE 'coverage' END AS category_field,
  CASE WHEN side = 'tuning' THEN replace(lower(regexp_replace(difficulty, '^\\s+|\\s+$', '', 'g')), '_', '-') ELSE coverage END AS category FROM s WHERE side IS NOT NULL),
tot AS (SELECT side, count(*) AS pool_rows FROM pool GROUP BY side),
av AS (SELECT side, category_field, category, count(*) AS available FROM pool GROUP BY ALL),
r AS (SELECT target_id, t.side, t.category_field, t.category, coalesce(pool_rows, 0) AS pool_rows, coalesce(pool_rows, 0) * sample_pct // 100 AS n,
  greatest(min_rows, (share_pct * (coalesce(pool_rows, 0) * sample_pct // 100) + 99) // 100) AS needed, coalesce(available, 0) AS available
  FROM sample_targets t LEFT JOIN tot ON tot.side = t.side LEFT JOIN av ON av.side = t.side AND av.category_field = t.category_field AND av.category = t.category)"""

SQL = {
    "p2_found": f"{_PAIRS} SELECT * FROM pairs",
    "p2_counts": f"{_PAIRS}, e AS (SELECT row_id, count(*) AS n FROM (SELECT row_id_a AS row_id FROM pairs UNION ALL SELECT row_id_b FROM pairs) GROUP BY row_id) SELECT {_SIDE} AS side, split, source, count(*) AS n_rows, sum(n)::BIGINT AS n_pairs FROM evaluation_rows JOIN e USING (row_id) GROUP BY ALL",
    "p3_sample": f"""WITH k AS (SELECT row_id, load_id, {_KEY} AS key FROM evaluation_rows),
half AS (SELECT quantile_disc(load_id, 0.5) AS h FROM loads),
u AS (SELECT key, min(load_id) AS first, md5('sample-1|' || key) AS p FROM k GROUP BY key),
one AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY p, key) AS r, count(*) OVER () AS n FROM u, half WHERE first <= h) WHERE r <= ceil(n * 10 / 100)),
two AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY p, key) AS r FROM u WHERE key NOT IN (SELECT key FROM one)) WHERE r <= ceil((SELECT count(*) FROM u) * 10 / 100) - (SELECT count(*) FROM one))
SELECT row_id, step FROM k JOIN (SELECT key, 1::INT AS step FROM one UNION ALL SELECT key, 2::INT FROM two) USING (key)""",
    "p6_found": f"{_POOL} SELECT target_id FROM r WHERE available < needed",
    "p6_report": f"{_POOL} SELECT *, least(needed, available) AS taken, available < needed AS exhausted FROM r",
    "p6_sample": f"""{_POOL} SELECT target_id, row_id FROM (SELECT target_id, row_id, least(needed, available) AS q,
  row_number() OVER (PARTITION BY target_id ORDER BY md5('quota-1|' || row_id), row_id) AS k FROM pool JOIN r USING (side, category_field, category)) WHERE k <= q""",
}
