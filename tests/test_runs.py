"""Scorers, agents, products and reviews on small tables, with nulls and what fails."""

import pytest

from sieveline.operators import dataset, runs
from sieveline.sources import jsonl, sinks
from tests.helpers import clashing, rows


def test_evaluators(spark):
    given = [
        ("normalized-exact", "Yes, it is!", "yes it  is", 1.0, None), ("exact", "a", None, None, "missing"), ("numeric-tolerance", " 1.5", "1.50", 1.0, None), ("numeric-tolerance", "1", "2", 0.0, None), ("numeric-tolerance", "NaN", "1", None, "not a number"),
        ("numeric-tolerance", "x", "1", None, "not a number"), ("set-f1", "a b b", "B c", 0.5, None), ("set-f1", "", "-", 1.0, None), ("schema", '{"a": 1, "b": "x", "c": 3}', '{"b": "x", "a": 2}', 0.5, None), ("schema", "[1]", "{}", None, "not an object"),
        ("schema", '{"a": 1}', "{}", 1.0, None), ("llm-judge-rubric", "a", "a", None, "no evaluator"), (None, "a", "a", None, "no evaluator"),
    ]
    df = spark.createDataFrame(list(enumerate(given)), "k int, g struct<m: string, o: string, e: string, s: double, r: string>")
    from pyspark.sql import functions as F

    got = df.select("k", runs.evaluator(F.col("g.m"), F.col("g.o"), F.col("g.e")).alias("x")).orderBy("k").collect()
    assert [(r.x.score, r.x.error) for r in got] == [(s, e) for *_, s, e in given]


def test_scorer_errors_are_kept(spark):
    def scorer(output, expected, input_data, metadata):
        return {"t": True, "n": float("nan"), "h": 2, "ok": 0.25, "m": len(metadata) / 10}.get(output) if output != "boom" else [][1]

    df = spark.createDataFrame([(k, o, None, None, {"a": "b"}) for k, o in enumerate(["t", "n", "h", "ok", "m", "boom", None, "other"])], "k int, output string, expected string, input_data string, metadata map<string,string>")
    got = {r.k: (r.score, r.error) for r in runs.scored(df, scorer).collect()}
    number, bounds = "score is not a number", "score out of range"
    assert got == {0: (None, number), 1: (None, bounds), 2: (None, bounds), 3: (0.25, None), 4: (0.1, None), 5: (None, "IndexError"), 6: (None, "missing"), 7: (None, number)}
    assert runs.scored(df.where("k = 3"), scorer, transform=lambda x: "m").first().score == 0.1
    assert runs.scored(df.limit(0), scorer).collect() == []


def test_agents_see_no_answer(spark):
    df = rows(spark, {"id": "a", "input": "q", "output": "secret", "metadata": {"output_source": "secret", "k": "v"}}, {"id": None, "input": None})
    from pyspark.sql import functions as F

    asked = df.withColumn("config", F.create_map(F.lit("model"), F.lit("m")))
    got = {r.row_id: (r.reply, r.error) for r in runs.answered(asked, lambda **k: repr(sorted(k.items())) if k["input"] else 1).collect()}
    assert "secret" not in got[1][0] and "'k': 'v'" in got[1][0] and "'model': 'm'" in got[1][0] and got[2] == (None, "reply is not a text")


def test_products(spark):
    projects = spark.createDataFrame([(1, {"t": ["0", "1"], "m": ["a", "b", "b"]}, ["t"]), (2, {"t": ["0"]}, [])], "project_id int, knobs map<string,array<string>>, wired array<string>")
    df = rows(spark, {"input": "a", "output": "b", "split": "train"}, {"input": "a", "output": "b", "split": "test"}, {"input": "a", "output": None, "split": "train"}, {"project_id": 3, "input": "a", "output": "b", "split": "train"})
    assert sorted((r.row_id, tuple(sorted(r.config.items()))) for r in runs.config_rows(projects, clashing(df)).collect()) == [(1, (("m", m), ("t", t))) for m in "ab" for t in "01"]
    cases = spark.createDataFrame([(1, 7, 1.0, 0.9, 0.5, 0.0)], "project_id int, row_id long, good double, equivalent_good double, partial double, bad double")
    more = spark.createDataFrame([(1, 7, f"x{k:02d}", 0.1) for k in range(11)] + [(1, 8, "y", 0.1)], "project_id int, row_id long, probe string, score double")
    assert sorted(r.probe for r in runs.case_probes(cases, more).collect()) == ["bad", "equivalent_good", "good", "partial", *(f"x{k:02d}" for k in range(8))]


def test_tuning_rows_refuse_unknown_splits(spark):
    good = rows(spark, {"split": " Train"}, {"split": "test"}, {"split": None}, {"metadata": {"split": "search"}}, {"split": ""})
    assert sorted(r.row_id for r in runs.tuning_rows(good).collect()) == [1, 4]
    with pytest.raises(Exception, match="unknown split: trian"):
        runs.tuning_rows(rows(spark, {"split": "trian"})).collect()


def test_thresholds():
    good = {"good_minimum": 0.8, "bad_maximum": 0.2, "equivalence_tolerance": 0.15, "separation_margin": 0.05}
    assert runs.threshold_faults(good) == []
    assert runs.threshold_faults(good | {"bad_maximum": 0.8}) == ["bad_maximum is not below good_minimum"]
    assert len(runs.threshold_faults(good | {"separation_margin": 0.31})) == 1 and len(runs.threshold_faults(good | {"good_minimum": True, "bad_maximum": float("nan")})) == 2


def test_reviews_and_draws(spark):
    df = rows(spark, {"id": "A", "input": "x", "output": "o", "split": "train", "difficulty": "easy"}, *({"id": f"k{k}", "input": f"q {k // 3}", "output": "o", "split": "train", "difficulty": "easy"} for k in range(30)), {"input": None})
    published = dataset.id_digests(df)
    assert runs.review_unmatched(published, clashing(df)).collect() == []
    other = spark.createDataFrame([(1, "feed")], "project_id int, digest string")
    assert [r.digest for r in runs.review_unmatched(published.union(other), df).collect()] == ["feed"]
    drawn = runs.row_draw(clashing(df)).collect()
    groups = {r.row_id for r in drawn}
    assert 1 <= len(drawn) <= 4 and groups == {r.row_id for r in runs.row_draw(df.repartition(5)).collect()}
    whole = [{i + 2 for i in range(3 * g, 3 * g + 3)} for g in range(10)]
    assert all(w <= groups or not w & groups for w in whole)
    assert runs.row_draw(df.limit(0)).collect() == []


def test_costs_literals_and_baselines(spark, tmp_path):
    from pyspark.sql import functions as F

    given = [('{"usage": {"cost": 0.5}}', 0.5), ('{"response_cost": -1, "cost": 2}', 2.0), ("[]", None), ("no json", None), (None, None), ('{"cost": "NaN"}', None)]
    df = spark.createDataFrame(list(enumerate(g[0] for g in given)), "k int, r string")
    assert [r.c for r in df.select("k", runs.provider_cost(F.col("r")).alias("c")).orderBy("k").collect()] == [g[1] for g in given]
    (tmp_path / "cases.json").write_text('[{"name": "a"}, {"name": "b"}]')
    names = lambda v: [r.n for r in jsonl.document(spark, v).select(jsonl.field(F.col("row"), "name").alias("n")).collect()]
    assert names(str(tmp_path / "cases.json")) == ["a", "b"] and names('{"name": "c"}') == ["c"]
    sweep = spark.createDataFrame([(1, 2, 3, 0, "", 0.5)], sinks._BASELINE)
    sinks.write_baseline(sweep, str(tmp_path / "base"))
    assert sinks.read_baseline(spark, str(tmp_path / "base")).select(sweep.columns).collect() == sweep.collect()
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_baseline(sweep, str(tmp_path / "base"))
