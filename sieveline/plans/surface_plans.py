"""One executed query for each construct that the SQL comparison reads; names in braces are tables.

Catalyst plans them all but the recursion, which it would run as one job a level and break off after 100 levels.
"""

from __future__ import annotations

import re

from sieveline.operators import chains
from sieveline.session import table

#: name: statement, or (statement, its form for the comparing engine).
STATEMENTS = {
    "sql_select_items": "SELECT n_name AS nation, n_regionkey + 1 AS next_region FROM {nation}",
    "sql_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "sql_derived_table": "SELECT d.seg, d.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM {customer} GROUP BY c_mktsegment) d WHERE d.n > 1",
    "sql_qualified_names": "SELECT nation.n_name, region.r_name FROM {nation} AS nation, {region} AS region WHERE nation.n_regionkey = region.r_regionkey",
    "sql_comma_join": "SELECT o_orderkey, c_name FROM {orders} o, {customer} c WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000",
    "sql_inner_join_on": "SELECT l_orderkey, l_linenumber, o_orderdate FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_quantity >= 49",
    "sql_join_using": "SELECT trial_id, count(*) AS n FROM {trials} JOIN {trial_scores} USING (trial_id) GROUP BY trial_id",
    "sql_natural_join": "SELECT project_name, phase, count(*) AS n FROM (SELECT project_id, project_name FROM {projects}) p NATURAL JOIN (SELECT project_id, phase FROM {trials}) t GROUP BY project_name, phase",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "sql_right_join": "SELECT n_name, count(s_suppkey) AS n FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_full_join": "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY s_nationkey) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) b ON a.k = b.k",
    "sql_cross_join": "SELECT r_name, o_orderpriority FROM {region} CROSS JOIN (SELECT DISTINCT o_orderpriority FROM {orders}) p",
    "sql_parenthesised_joins": "SELECT r_name, count(*) AS n FROM {customer} JOIN ({nation} JOIN {region} ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey GROUP BY r_name",
    "sql_self_join": "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_where_boolean": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE NOT (l_discount < 0.05 OR l_tax > 0.04) AND l_quantity BETWEEN 10 AND 12",
    "sql_group_ordinal": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY 1, 2",
    "sql_group_alias": "SELECT year(o_orderdate) AS y, count(*) AS n FROM {orders} GROUP BY y",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 100000",
    "sql_order_nulls": "SELECT doc_id, lang FROM {documents} ORDER BY lang DESC NULLS LAST, doc_id LIMIT 100",
    "sql_limit_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "sql_with": "WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey), top AS (SELECT * FROM big WHERE q > 200) SELECT o_orderkey, q FROM top JOIN {orders} ON o_orderkey = l_orderkey",
    "sql_with_recursive": "WITH RECURSIVE chain(load_id, depth) AS (SELECT load_id, 0 FROM {loads} WHERE prev_load_id IS NULL UNION ALL SELECT l.load_id, c.depth + 1 FROM {loads} l JOIN chain c ON l.prev_load_id = c.load_id) SELECT load_id, depth FROM chain",
    "sql_union": "SELECT s_nationkey AS k FROM {supplier} UNION SELECT c_nationkey FROM {customer}",
    "sql_union_all": "SELECT 'supplier' AS kind, s_nationkey AS k FROM {supplier} UNION ALL SELECT 'customer', c_nationkey FROM {customer}",
    "sql_intersect": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'",
    "sql_intersect_all": "SELECT l_quantity AS q FROM {lineitem} WHERE l_orderkey < 500 INTERSECT ALL SELECT l_quantity FROM {lineitem} WHERE l_orderkey >= 500 AND l_orderkey < 700",
    "sql_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}",
    "sql_except_all": "SELECT p_size AS s FROM {part} EXCEPT ALL SELECT p_size FROM {part} WHERE p_retailprice > 1000",
    "sql_scalar_subquery": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM {orders})",
    "sql_in_subquery": "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)",
    "sql_not_in_list": "SELECT doc_id FROM {documents} WHERE lang NOT IN ('en', 'de', 'fr')",
    "sql_exists_correlated": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "sql_not_exists": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "sql_correlated_scalar": "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS best FROM {customer} c",
    "sql_is_null": "SELECT row_id FROM {evaluation_rows} WHERE difficulty IS NULL AND split IS NOT NULL",
    "sql_like_escape": "SELECT row_id FROM {evaluation_rows} WHERE id LIKE 'eval!_w%' ESCAPE '!'",
    "sql_ilike": "SELECT row_id, split FROM {evaluation_rows} WHERE split ILIKE '%TRAIN%'",
    "sql_between_not": "SELECT event_id FROM {events} WHERE value NOT BETWEEN 1 AND 150",
    "sql_arithmetic": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS charge, l_linenumber % 3 AS m FROM {lineitem} WHERE l_orderkey < 1000",
    "sql_concat": "SELECT c_name || '/' || c_mktsegment AS label FROM {customer}",
    "sql_cast": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderdate AS DATE) AS day FROM {orders}",
    "sql_case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM {orders}",
    "sql_case_searched": "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM {lineitem} GROUP BY 1",
    "sql_aggregates": "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first, max(l_shipdate) AS last, round(avg(l_quantity), 6) AS q, round(sum(l_extendedprice), 2) AS total FROM {lineitem} GROUP BY l_returnflag",
    "sql_typed_literals": "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1997-02-01'",
    "sql_interval": "SELECT o_orderkey, o_orderdate + INTERVAL '3' MONTH AS due FROM {orders}",
    "sql_window_rank": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}",
    "sql_window_frame_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS s FROM {events}",
    "sql_window_frame_range": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM {lineitem}",
    "sql_window_lag": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}",
    "sql_row_constructor": "SELECT n_name FROM {nation} WHERE (n_regionkey, n_nationkey) IN (SELECT r_regionkey, r_regionkey FROM {region})",
    "sql_star_join_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY n_name",
    "sql_semi_anti_counts": "SELECT count(*) AS n, count_if(o_totalprice > 200000) AS big FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)",
    # The three constructs whose statements above read a slice, over their whole tables.
    "sql_arithmetic_whole": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_linenumber % 3 AS m FROM {lineitem}",
    "sql_intersect_all_whole": "SELECT l_quantity AS q FROM {lineitem} WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_quantity FROM {lineitem} WHERE l_returnflag <> 'R'",
    "sql_order_nulls_whole": "SELECT doc_id, lang FROM {documents} ORDER BY lang DESC NULLS LAST, doc_id",
    "sql_label_counts": "SELECT label, count(*) AS n FROM {embeddings} GROUP BY label",
}

_NAMES = re.compile(r"\{(\w+)\}")


def _query(sql: str):
    def run(spark, d):
        return spark.sql(sql, **{n: table(spark, d, n) for n in set(_NAMES.findall(sql))})

    return run


def with_recursive(spark, d):
    return chains.depths(table(spark, d, "loads"), "load_id", "prev_load_id")


QUERIES = {name: _query(s) for name, s in STATEMENTS.items()} | {"sql_with_recursive": with_recursive}
SQL = {name: _NAMES.sub(r"\1", s) for name, s in STATEMENTS.items()}
