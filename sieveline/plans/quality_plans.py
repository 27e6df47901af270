"""Queries of the column profile, with their SQL."""

from __future__ import annotations

from sieveline.operators import profile as P
from sieveline.session import ship, table


def p1_found(spark, d):
    ship(spark)
    return P.findings(P.compare_loads(table(spark, d, "evaluation_rows"), table(spark, d, "loads")))


def p1_profile(spark, d):
    return P.profile(table(spark, d, "evaluation_rows"))


def p1_discrimination(spark, d):
    ship(spark)
    return P.discrimination(table(spark, d, "evaluation_rows"), table(spark, d, "loads"))


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p1_discrimination": p1_discrimination}

_PROFILED = {
    "row_id": "row_id", "line_no": "line_no", "project_id": "project_id", "id": "length(id)", "input": "length(input)", "output": "length(output)", "split": "length(split)",
    "difficulty": "length(difficulty)", "coverage": "length(coverage)", "source": "length(source)", "output_source": "length(output_source)",
    "created_at": "epoch_us(created_at)", "loaded_at": "epoch_us(loaded_at)",
}

SQL = {
    "p1_found": r"""
WITH v AS (
  SELECT load_id, 'difficulty' AS column_name, difficulty AS value, difficulty IN ('easy','medium','hard','very-hard') AS ok FROM evaluation_rows
  UNION ALL SELECT load_id, 'split', split, split IN ('tune','tuning','train','search','holdout','held-out','heldout','held_out','test','validation','validate') FROM evaluation_rows
  UNION ALL SELECT load_id, 'source', source, regexp_full_match(source, '[a-z]+(-[a-z0-9]+)*') FROM evaluation_rows),
s AS (SELECT load_id, column_name, count(*) AS n, count(*) FILTER (value IS NULL) AS nn, count(*) FILTER (NOT ok) AS bad, count(*) FILTER (ok) AS good,
  count(DISTINCT CASE WHEN ok THEN value END) AS d FROM v GROUP BY ALL),
c AS (SELECT load_id, column_name, value, count(*) AS n FROM v WHERE ok GROUP BY ALL),
p AS (SELECT s.*, l.prev_load_id AS prev FROM s JOIN loads l USING (load_id)),
j AS (SELECT p.*, q.n AS qn, q.nn AS qnn, q.good AS qgood, q.d AS qd FROM p JOIN s q ON q.load_id = p.prev AND q.column_name = p.column_name),
x AS (SELECT j.load_id, j.column_name, sum(abs(coalesce(t.a, 0) * j.qgood - coalesce(t.b, 0) * j.good)) AS gap FROM j JOIN (
   SELECT load_id, column_name, value, sum(a) AS a, sum(b) AS b FROM (
     SELECT load_id, column_name, value, n AS a, 0 AS b FROM c
     UNION ALL SELECT l.load_id, c.column_name, c.value, 0, c.n FROM c JOIN loads l ON l.prev_load_id = c.load_id) GROUP BY ALL) t
   ON t.load_id = j.load_id AND t.column_name = j.column_name GROUP BY ALL)
SELECT load_id, column_name, 'pattern' AS finding FROM p WHERE n > nn AND bad * 100 >= 5 * (n - nn)
UNION ALL SELECT load_id, column_name, 'nulls' FROM j WHERE abs(nn * qn - qnn * n) * 100 >= 15 * n * qn
UNION ALL SELECT load_id, column_name, 'shift' FROM j JOIN x USING (load_id, column_name) WHERE good > 0 AND qgood > 0 AND gap * 50 >= 25 * good * qgood
UNION ALL SELECT load_id, column_name, 'distinct' FROM j WHERE d > 2 * qd OR 2 * d < qd""",
    "p1_profile": " UNION ALL ".join(
        f"SELECT load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, min({e})::DOUBLE AS low, max({e})::DOUBLE AS high FROM evaluation_rows GROUP BY load_id"
        for c, e in _PROFILED.items()
    )
    + " UNION ALL SELECT load_id, 'metadata', count(*), count(*) - count(metadata), NULL, NULL, NULL FROM evaluation_rows GROUP BY load_id",
}
