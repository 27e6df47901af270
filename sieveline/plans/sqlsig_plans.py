"""Queries of the SQL structure comparison, over a corpus of pairs written for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import sqlsig
from sieveline.session import ship

#: (name, left, right, 1 if the two have one structure): at least one pair for each construct.
PAIRS = (
    ("items", "SELECT a, b FROM t", "select b, a from t", 1),
    ("item_alias", "SELECT a AS x FROM t", "SELECT a FROM t", 1),
    ("item_multiset", "SELECT a, a FROM t", "SELECT a FROM t", 0),
    ("distinct", "SELECT DISTINCT a FROM t", "SELECT a FROM t", 0),
    ("all", "SELECT ALL a FROM t", "SELECT a FROM t", 1),
    ("fence", "```sql\nSELECT a FROM t;\n```", "SELECT a FROM t", 1),
    ("comment", "SELECT a -- note\nFROM t /* x */", "SELECT a FROM t", 1),
    ("quoted", 'SELECT "A" FROM [T]', "SELECT a FROM `t`", 1),
    ("string_case", "SELECT a FROM t WHERE b = 'X'", "SELECT a FROM t WHERE b = 'x'", 0),
    ("table_alias", "SELECT o.x FROM orders AS o", "SELECT orders.x FROM orders", 1),
    ("unqualified", "SELECT x FROM orders", "SELECT orders.x FROM orders", 0),
    ("self_join", "SELECT a.x FROM t a, t b", "SELECT b.x FROM t a, t b", 0),
    ("comma_join", "SELECT 1 FROM a, b WHERE a.i = b.i", "SELECT 1 FROM a JOIN b ON b.i = a.i", 1),
    ("join_order", "SELECT 1 FROM a JOIN b ON a.i = b.i", "SELECT 1 FROM b INNER JOIN a ON a.i = b.i", 1),
    ("cross_join", "SELECT 1 FROM a CROSS JOIN b", "SELECT 1 FROM a, b", 1),
    ("left_order", "SELECT 1 FROM a LEFT JOIN b ON a.i = b.i", "SELECT 1 FROM b LEFT JOIN a ON a.i = b.i", 0),
    ("right_left", "SELECT 1 FROM a RIGHT JOIN b ON a.i = b.i", "SELECT 1 FROM b LEFT OUTER JOIN a ON a.i = b.i", 1),
    ("full", "SELECT 1 FROM a FULL JOIN b ON a.i = b.i", "SELECT 1 FROM a LEFT JOIN b ON a.i = b.i", 0),
    ("using", "SELECT 1 FROM a JOIN b USING (i)", "SELECT 1 FROM a JOIN b ON a.i = b.i", 0),
    ("using_set", "SELECT 1 FROM a JOIN b USING (i, j)", "SELECT 1 FROM a JOIN b USING (j, i)", 1),
    ("natural", "SELECT 1 FROM a NATURAL JOIN b", "SELECT 1 FROM a, b", 0),
    ("derived", "SELECT 1 FROM (SELECT a, b FROM t) d", "SELECT 1 FROM (SELECT b, a FROM t) AS d", 1),
    ("conjuncts", "SELECT 1 FROM t WHERE a = 1 AND b = 2 AND a = 1", "SELECT 1 FROM t WHERE b = 2 AND 1 = a", 1),
    ("disjuncts", "SELECT 1 FROM t WHERE a = 1 OR (b = 2 OR c = 3)", "SELECT 1 FROM t WHERE (c = 3 OR b = 2) OR a = 1", 1),
    ("and_or", "SELECT 1 FROM t WHERE a = 1 AND b = 2", "SELECT 1 FROM t WHERE a = 1 OR b = 2", 0),
    ("mirror", "SELECT 1 FROM t WHERE a < b", "SELECT 1 FROM t WHERE b > a", 1),
    ("strict", "SELECT 1 FROM t WHERE a < b", "SELECT 1 FROM t WHERE a <= b", 0),
    ("not_pushed", "SELECT 1 FROM t WHERE NOT (a > b)", "SELECT 1 FROM t WHERE a <= b", 0),
    ("in_set", "SELECT 1 FROM t WHERE a IN (1, 2, 2)", "SELECT 1 FROM t WHERE a IN (2, 1)", 1),
    ("in_or", "SELECT 1 FROM t WHERE a IN (1, 2)", "SELECT 1 FROM t WHERE a = 1 OR a = 2", 0),
    ("in_query", "SELECT 1 FROM t WHERE a IN (SELECT x FROM u)", "SELECT 1 FROM t WHERE a NOT IN (SELECT x FROM u)", 0),
    ("exists", "SELECT 1 FROM t WHERE EXISTS (SELECT 1 FROM u AS v WHERE v.i = t.i)", "SELECT 1 FROM t WHERE EXISTS (SELECT 1 FROM u WHERE t.i = u.i)", 1),
    ("is_null", "SELECT 1 FROM t WHERE a IS NULL", "SELECT 1 FROM t WHERE a IS NOT NULL", 0),
    ("like", "SELECT 1 FROM t WHERE a LIKE 'x%' ESCAPE '!'", "SELECT 1 FROM t WHERE a LIKE 'x%'", 0),
    ("ilike", "SELECT 1 FROM t WHERE a ILIKE 'x%'", "SELECT 1 FROM t WHERE a LIKE 'x%'", 0),
    ("between", "SELECT 1 FROM t WHERE a BETWEEN 1 AND 2", "SELECT 1 FROM t WHERE a BETWEEN 2 AND 1", 0),
    ("plus", "SELECT a + b FROM t", "SELECT b + a FROM t", 1),
    ("plus_chain", "SELECT a + b + c FROM t", "SELECT c + b + a FROM t", 0),
    ("minus", "SELECT a - b FROM t", "SELECT b - a FROM t", 0),
    ("cast", "SELECT CAST(a AS INT) FROM t", "SELECT a::int FROM t", 1),
    ("cast_type", "SELECT CAST(a AS INT) FROM t", "SELECT CAST(a AS INTEGER) FROM t", 0),
    ("number", "SELECT 1.5 FROM t", "SELECT 1.50 FROM t", 0),
    ("case", "SELECT CASE WHEN a = 1 THEN 2 ELSE 3 END FROM t", "SELECT CASE WHEN 1 = a THEN 2 ELSE 3 END FROM t", 1),
    ("case_order", "SELECT CASE WHEN a = 1 THEN 2 WHEN b = 1 THEN 3 END FROM t", "SELECT CASE WHEN b = 1 THEN 3 WHEN a = 1 THEN 2 END FROM t", 0),
    ("count", "SELECT COUNT(*) FROM t", "SELECT COUNT(1) FROM t", 0),
    ("count_distinct", "SELECT COUNT(DISTINCT a) FROM t", "SELECT COUNT(a) FROM t", 0),
    ("group_set", "SELECT a, b, SUM(c) FROM t GROUP BY a, b", "SELECT a, b, SUM(c) FROM t GROUP BY 2, 1, a", 1),
    ("group_alias", "SELECT a + 1 AS x, COUNT(*) FROM t GROUP BY x", "SELECT a + 1, COUNT(*) FROM t GROUP BY 1 + a", 1),
    ("having", "SELECT a, COUNT(*) AS n FROM t GROUP BY a HAVING n > 1 AND a > 2", "SELECT a, COUNT(*) FROM t GROUP BY a HAVING 2 < a AND 1 < COUNT(*)", 1),
    ("order_ordinal", "SELECT a, b FROM t ORDER BY 2 DESC", "SELECT b, a FROM t ORDER BY b DESC", 1),
    ("order_order", "SELECT a, b FROM t ORDER BY a, b", "SELECT a, b FROM t ORDER BY b, a", 0),
    ("order_nulls", "SELECT a FROM t ORDER BY a NULLS LAST", "SELECT a FROM t ORDER BY a", 0),
    ("limit_comma", "SELECT a FROM t LIMIT 5, 10", "SELECT a FROM t LIMIT 10 OFFSET 5", 1),
    ("cte", "WITH x AS (SELECT a FROM t), y AS (SELECT b FROM u) SELECT 1 FROM x, y", "WITH y AS (SELECT b FROM u), x AS (SELECT a FROM t) SELECT 1 FROM y, x", 1),
    ("union", "SELECT a FROM t UNION SELECT b FROM u UNION SELECT c FROM v", "SELECT c FROM v UNION (SELECT b FROM u UNION SELECT a FROM t)", 1),
    ("union_all", "SELECT a FROM t UNION SELECT b FROM u", "SELECT a FROM t UNION ALL SELECT b FROM u", 0),
    ("except", "SELECT a FROM t EXCEPT SELECT b FROM u", "SELECT b FROM u EXCEPT SELECT a FROM t", 0),
    ("typed", "SELECT 1 FROM t WHERE d > DATE '2024-01-01'", "SELECT 1 FROM t WHERE d > '2024-01-01'", 0),
    ("interval", "SELECT d + INTERVAL '1' DAY FROM t", "SELECT d + INTERVAL '1' DAYS FROM t", 1),
    ("window_set", "SELECT SUM(a) OVER (PARTITION BY b, c ORDER BY d) FROM t", "SELECT SUM(a) OVER (PARTITION BY c, b ORDER BY d) FROM t", 1),
    ("window_frame", "SELECT SUM(a) OVER (ORDER BY d ROWS 3 PRECEDING) FROM t", "SELECT SUM(a) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) FROM t", 1),
    ("window_no_frame", "SELECT SUM(a) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) FROM t", "SELECT SUM(a) OVER (ORDER BY d) FROM t", 0),
    ("row", "SELECT 1 FROM t WHERE (a, b) IN ((1, 2))", "SELECT 1 FROM t WHERE (b, a) IN ((1, 2))", 0),
    ("star_ordinal", "SELECT * FROM t ORDER BY 1", "SELECT * FROM t ORDER BY a", 0),
    ("arrow", "SELECT a -> 'b' FROM t", "SELECT a -> 'b' FROM t", 0),
    ("named_window", "SELECT SUM(a) OVER w FROM t WINDOW w AS (ORDER BY b)", "SELECT SUM(a) OVER w FROM t WINDOW w AS (ORDER BY b)", 0),
    ("not_select", "DELETE FROM t", "DELETE FROM t", 0),
    ("bad_ordinal", "SELECT a FROM t ORDER BY 3", "SELECT a FROM t ORDER BY 3", 0),
    ("empty", "", "", 0),
)


def _pairs(spark):
    ship(spark)
    return spark.createDataFrame([p[:3] for p in PAIRS], "name string, a string, b string")


def sql_match(spark, d):
    return _pairs(spark).select("name", sqlsig.match(F.col("a"), F.col("b")).alias("score"))


def sql_signature(spark, d):
    """The statements of the corpus by signature: how many share one; unreadable ones have none."""
    s = _pairs(spark).select(F.explode(F.array("a", "b")).alias("sql")).select(sqlsig.signature(F.col("sql")).alias("signature"))
    return s.groupBy("signature").agg(F.count("*").alias("n_statements"))


def sql_gold_scan(spark, d):
    """Statements whose gold answer cannot be read and so could never score."""
    return _pairs(spark).select("name", sqlsig.signature(F.col("a")).alias("s")).where("s IS NULL").select("name")


QUERIES = {"sql_match": sql_match, "sql_signature": sql_signature, "sql_gold_scan": sql_gold_scan}
SQL = {
    "sql_match": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s}.0::DOUBLE)" for n, _, _, s in PAIRS) + ") t(name, score)",
    "sql_gold_scan": "SELECT * FROM (VALUES ('arrow'), ('named_window'), ('not_select'), ('bad_ordinal'), ('empty')) t(name)",
}
