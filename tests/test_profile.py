import numpy as np
from pyspark.sql import functions as F

from sieveline.operators import profile as P
from tests.helpers import clashing, rows


def loads(spark, *pairs):
    return spark.createDataFrame(list(pairs), "load_id long, prev_load_id long")


def found(df, l):
    return sorted(map(tuple, P.findings(P.compare_loads(df, l)).collect()))


def test_findings_at_their_bounds(spark):
    first = [{"load_id": 1, "difficulty": "easy", "split": "train", "source": "a-1"}] * 20
    # 3 of 20 null: 0.15; 1 of 17 invalid: over 5 %; the rest half shifted
    second = [{"load_id": 2, "difficulty": None, "split": "train", "source": "a-1"}] * 3 + [{"load_id": 2, "difficulty": "Easy", "split": "train", "source": "b"}] * 1 + [{"load_id": 2, "difficulty": d, "split": "train", "source": "a-1"} for d in ["easy"] * 12 + ["hard"] * 4]
    df = rows(spark, *first, *second)
    l = loads(spark, (1, None), (2, 1))
    assert found(df, l) == [(2, "difficulty", "nulls"), (2, "difficulty", "pattern"), (2, "difficulty", "shift")]
    assert found(clashing(df), l) == found(df, l)


def test_distinct_and_missing_predecessors(spark):
    df = rows(spark, *[{"load_id": 1, "source": "a"}] * 3, *[{"load_id": 2, "source": s} for s in ("a", "b", "c")], *[{"load_id": 4, "source": "a\n"}])
    got = found(df, loads(spark, (1, None), (2, 1), (3, 2), (4, 3)))
    assert (2, "source", "distinct") in got and (2, "source", "shift") in got
    assert (4, "source", "pattern") in got  # a line end is no part of a name
    assert not [g for g in got if g[0] == 4 and g[2] in ("shift", "distinct", "nulls")]  # load 3 has no rows


def test_empty(spark):
    assert found(rows(spark).limit(0), loads(spark, (1, None))) == []
    assert P.profile(rows(spark).limit(0)).collect() == []


def test_exact_distance(spark):
    df = rows(spark, *[{"load_id": 1, "difficulty": d} for d in ["easy"] * 8 + ["hard"] * 2], *[{"load_id": 2, "difficulty": d} for d in ["easy"] * 4 + ["medium"] * 6])
    counts = P.value_counts(df)
    got = P.shifts(counts, P.base(counts), loads(spark, (2, 1))).where("column_name = 'difficulty'").first()
    assert got.shift_rows == 2 * 60


def shifted(spark):
    n = 3000
    value = lambda names, r: F.element_at(F.array(*map(F.lit, names)), (r * len(names)).cast("int") + 1)
    made = spark.range(2 * n).withColumn("load_id", F.when(F.col("id") < n, 1).otherwise(2).cast("long"))
    hard = F.rand(1) < F.when(F.col("load_id") == 1, 0.1).otherwise(0.6)
    return made.select(F.col("id").alias("row_id"), "load_id", F.when(hard, "hard").otherwise("easy").alias("difficulty"), F.when(F.rand(4) > 0.2 * (F.col("load_id") - 1), value(P.TUNING, F.rand(2))).alias("split"), value([f"s-{k}" for k in range(30)], F.rand(3)).alias("source"))


def test_classifiers_tell_shifted_loads_apart_and_name_the_column(spark):
    got = {r.column_name: r for r in P.discrimination(shifted(spark), loads(spark, (2, 1), (1, None))).collect()}
    assert len(got) == 3 and got["difficulty"].auc_full > 0.75 and got["difficulty"].auc_without < 0.65
    assert abs(got["difficulty"].auc_alone - 0.75) < 0.03 and 0.55 < got["split"].auc_alone < 0.65 and abs(got["source"].auc_alone - 0.5) < 0.04


def test_descent_finds_the_log_odds(spark):
    """A model of one column separates by value: its coefficients approach the log of the two shares' ratio."""
    df = shifted(spark)
    theta = P.train(P.cells(df, loads(spark, (2, 1)))).first().theta
    bucket = df.select((1 + F.pmod(F.xxhash64("difficulty"), F.lit(P.BUCKETS["difficulty"] - 1))).alias("b"), "difficulty").distinct().collect()
    at = {r.difficulty: theta[(4 * 2) * P._WIDTH + r.b] for r in bucket}
    assert P.MODELS[4] == ("difficulty",) and abs(at["hard"] - np.log(0.6 / 0.1)) < 0.25 and abs(at["easy"] - np.log(0.4 / 0.9)) < 0.25


def test_findings_need_the_classifier(spark, monkeypatch):
    df, l = shifted(spark), loads(spark, (2, 1))
    assert found(df, l) == [(2, "difficulty", "shift"), (2, "split", "nulls")]
    blind = P.discrimination(df, l).select("load_id", "column_name", *(F.lit(0.5).alias(x) for x in ("auc_full", "auc_without", "auc_alone")))
    monkeypatch.setattr(P, "discrimination", lambda *_: blind)
    assert found(df, l) == []
    monkeypatch.setattr(P, "discrimination", lambda *_: blind.limit(0))
    assert found(df, l) == []
