"""Running queries beside their SQL, and small tables in the shape of the real ones."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"
ROWS = "row_id long, load_id long, line_no int, project_id int, id string, input string, output string, split string, difficulty string, coverage string, source string, output_source string, metadata map<string,string>"
SCORES = "score_id long, trial_id long, row_id long, project_id int, score double, error_type string, cost_usd double, scored_at timestamp"
LOG = "log_id long, trial_id long, ts string, event_name string, stage int, event_class string, state string, detail string"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def sql_rows(statement, columns, data=DATA):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    r = con.sql(statement)
    assert sorted(r.columns) == sorted(columns)
    at = [r.columns.index(c) for c in columns]
    return sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())


def same_as_sql(spark, query, statement, data=DATA):
    df = query(spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == sql_rows(statement, columns, data)


def rows(spark, *given):
    """Rows of the labelled table from dicts; what is not given is null, row_id counts up."""
    names = [c.strip().split(" ")[0] for c in ROWS.replace("map<string,string>", "map").split(",")]
    full = [{"row_id": i, "load_id": 1, "line_no": i, "project_id": 1} | g for i, g in enumerate(given, 1)]
    return spark.createDataFrame([tuple(f.get(n) for n in names) for f in full], ROWS)


def clashing(df):
    """The same rows with further columns named like those that operators make."""
    from pyspark.sql import functions as F

    for name in ("n", "k", "w", "words", "side", "key", "priority", "shard", "node", "root", "value", "label", "status", "band", "t", "h", "rep"):
        df = df.withColumn(name, F.lit("x"))
    return df
