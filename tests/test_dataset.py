import itertools
import random
import re

import pytest

from sieveline.operators import dataset as D
from tests.helpers import clashing, rows

NAMES = [n for n in ("token_stats", "duplicate_groups", "duplicate_summary", "similar_pairs", "similar_classes", "split_overlap", "split_sizes", "holdout_resolution", "question_cap", "row_bounds", "family_partition", "duplicate_ids", "missing_ids", "id_digests", "provenance_counts", "provenance_points", "label_counts", "answer_dominance", "outcome_fields", "input_types", "difficulty_coverage", "scenario_coverage", "check_report")]


@pytest.mark.parametrize("name", NAMES)
def test_empty_null_and_clashing(spark, name):
    f = getattr(D, name)
    assert f(rows(spark).limit(0)).collect() == []
    nulls = rows(spark, {}, {"input": ""}, {"input": "a", "output": " "}, {"input": "a b c d", "output": "x", "split": "train", "id": "1"}, {"input": "A b, c d", "output": "x", "split": "test", "id": "1"}, {"input": "w " * 5000, "output": "y" * 10_000})
    assert sorted(map(str, f(nulls).collect())) == sorted(map(str, f(clashing(nulls)).collect()))


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    for _ in range(4):
        texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 4, 6, 9]))) for _ in range(35)]
        texts += [t + " z" for t in texts[:15]]
        df = rows(spark, *({"input": t, "output": "x"} for t in texts))
        first = {}
        for i, t in enumerate(texts, 1):
            first.setdefault(t, i)
        runs = {i: (lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)})(t.split()) for t, i in first.items() if t}
        expected = {(a, b) for a, b in itertools.combinations(sorted(runs), 2) if len(runs[a] & runs[b]) * 10 >= 7 * len(runs[a] | runs[b])}
        assert {(r.class_a, r.class_b) for r in D.similar_pairs(df).collect()} == expected
        assert {(r.class_id, r.row_id) for r in D.similar_classes(df).collect()} == {(first[t], i) for i, t in enumerate(texts, 1)}


def test_similar_pairs_broadcast_nothing_uncounted(spark, tmp_path, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[: 20 + k]) for k in range(20)] + [" ".join(words[k:]) for k in range(20)]
    rows(spark, *({"input": t, "output": "x"} for t in texts)).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    runs = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in reversed(list(enumerate(texts, 1))) if t not in texts[: i - 1]}
    expected = {(a, b) for a, b in itertools.combinations(sorted(runs), 2) if len(runs[a] & runs[b]) * 10 >= 7 * len(runs[a] | runs[b])}
    # A table of 16 counts, in which every run meets others, orders them otherwise and loses no pair.
    for name, value in (("BROADCAST_CLASSES", 0), ("COUNTED_BITS", 4), ("SLICE_BITS", 4)):
        monkeypatch.setattr(D, name, value, raising=False)
    plans, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda x: plans.append(x) or cut(x))
    found = D.similar_pairs(df)
    assert "Broadcast" not in "".join(x._jdf.queryExecution().sparkPlan().toString() for x in (*plans, found))
    assert {(r.class_a, r.class_b) for r in found.collect()} == expected and len(expected) > 50


@pytest.mark.parametrize(("counts", "status"), [((9, 1), "WARN"), ((2, 1), "SKIP"), ((4, 2), "WARN"), ((11, 6), "PASS"), ((1, 1, 1), "SKIP"), ((8, 1, 1), "WARN"), ((10,), "WARN"), ((5, 4, 4), "PASS")])
def test_dominance_is_exact_at_its_bounds(spark, counts, status):
    df = rows(spark, *({"input": f"q {i} {j}", "output": f"label{i}"} for i, c in enumerate(counts) for j in range(c)))
    assert D.answer_dominance(df).first().status == status


def test_question_cap_takes_whole_groups(spark):
    df = rows(spark, *({"input": f"q{g}", "output": "a"} for g, size in enumerate([1, 2, 5, 9, 9]) for _ in range(size)))
    got = D.question_cap(df).first()
    assert (got.questions, got.distinct_questions, got.scope) == (4, 5, "dataset")
    assert tuple(D.row_bounds(df).first())[2:] == (17, 25)


def test_families_that_follow_the_split(spark):
    make = lambda word, split, n: [{"input": f"please {word} number {k}", "output": "x", "split": split} for k in range(n)]
    assert D.family_partition(rows(spark, *make("add two", "train", 5), *make("find the", "test", 5))).first().status == "WARN"
    assert D.family_partition(rows(spark, *make("add two", "train", 5), *make("add two", "test", 5))).first().status == "PASS"
    assert D.family_offset(rows(spark, *make("add two", "train", 5), *make("find the", "test", 5))).first().offset == 1


def test_origin_words(spark):
    words = {"production-log": "collected", "Synthetic x": "synthesised", "generated-real": "synthesised", "zzz": "undeclared", " n/a ": "undeclared", "": "undeclared", "log--x": "collected"}
    df = rows(spark, *({"input": "x", "source": w} for w in words))
    got = df.select("source", D.origin(D.provenance()).alias("o"), D.recognised(D.provenance()).alias("r")).collect()
    assert {r.source: r.o for r in got} == words
    assert [r.source for r in got if not r.r] == ["zzz"]


def test_metadata_is_asked_where_the_column_is_null(spark):
    df = rows(spark, {"input": "x", "output": "y", "metadata": {"split": "Tune", "difficulty": "very_hard", "provenance": "gold"}, "source": "synthetic"})
    assert D.split_sizes(df).first().side == "tuning"
    assert D.difficulty_coverage(df).first().bands == 1
    assert D.provenance_counts(df).first().collected == 1


def test_outcome_field(spark):
    df = rows(spark, *({"input": str(k), "output": '{"type": {"x": 1}, "intent": "%s"}' % ("a" if k else "b")} for k in range(10)))
    got = D.outcome_fields(df).first()
    assert (got.field, got.m, got.k, got.status) == ("intent", 9, 2, "WARN")


def test_folding(spark):
    df = rows(spark, {"input": "Straße ΣΊΣΥΦΟΣ, Größe_1", "output": "x"})
    from pyspark.sql import functions as F

    from sieveline.functions import text as X

    assert df.select(X.words(F.col("input")).alias("w")).first().w == re.findall(r"\w+", "Straße ΣΊΣΥΦΟΣ, Größe_1".casefold())


def test_whole_report_has_every_check(spark):
    text = "the quick brown fox jumps over the lazy dog near the river bank"
    bad = [{"input": text + end, "output": '{"label": "%s"}' % k, "split": split, "source": "synthetic", "difficulty": "easy", "id": f"a{k}"} for k, (end, split) in enumerate([("", "train"), ("", "train"), (" today", "test"), (" x", "odd")])]
    bad += [{"input": "[1, 2]", "output": '{"label": "z"}', "split": "train", "source": "synthetic", "difficulty": "easy", "id": "b"}, {"input": "q", "output": '{"label": "y"}', "source": "zzz", "difficulty": "easy", "id": "c"}]
    got = {r.check: (r.status, r["count"]) for r in D.check_report_whole(rows(spark, *bad)).collect()}
    # Of the 11 runs of the equal rows the two longer ones have all and one more each: six pairs in four rows.
    wanted = {"dataset-near-duplicates": ("WARN", 6), "dataset-shape": ("PASS", 6), "dataset-size": ("WARN", 6), "dataset-first-run-rows": ("PASS", 2), "dataset-input-shape": ("FAIL", 2), "dataset-provenance-vocabulary": ("WARN", 1), "dataset-outcome-field": ("PASS", 6)}
    wanted |= {"dataset-split-vocabulary": ("WARN", 1), "dataset-tuning-size": ("WARN", 3), "dataset-holdout-resolution": ("WARN", 1), "dataset-difficulty": ("WARN", 1)}
    assert {k: got.get(k) for k in wanted} == wanted
    made = D.check_report_whole(rows(spark, *({"input": f"q{k}", "output": "x", "source": "synthetic"} for k in range(3)))).collect()
    assert [(r.status, r["count"]) for r in made if r.check == "dataset-coverage"] == [("WARN", 0)]
    assert D.check_report_whole(rows(spark).limit(0)).collect() == []


def test_checks_of_the_whole_report_are_planned_one_by_one(spark):
    made = D.check_report_whole(rows(spark, *({"input": f"q{k} a b", "output": f"x{k}"} for k in range(3))))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert {"dataset-near-duplicates", "dataset-integrity"} <= {r.check for r in made.collect()}
