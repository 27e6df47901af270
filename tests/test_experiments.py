import datetime as dt
import itertools
import random

import pytest

from sieveline.operators import disclosure, experiments as X
from tests.helpers import SCORES


def scores(spark, *given):
    names = [c.split(" ")[0] for c in SCORES.split(", ")]
    return spark.createDataFrame([tuple(({"score_id": i, "trial_id": 1, "row_id": 1, "project_id": 1} | g).get(n) for n in names) for i, g in enumerate(given, 1)], SCORES)


def test_sweep_counts_failures_and_repeats(spark):
    s = scores(spark, {"score": 1.0}, {"score": 0.5}, {"error_type": "KeyError"}, {"score": float("nan")}, {"score": 2.0}, {})
    got = X.sweep_scores(s.unionByName(s)).first()
    assert (got.n_scored, got.n_failed, got.failure_types, got.mean_score) == (2, 4, "KeyError=1,invalid=2,missing=1", 0.75)
    assert X.sweep_scores(s.limit(0)).collect() == []


def test_grid_is_the_product(spark):
    p = spark.createDataFrame([(1, {"a": ["1", "2", "2"], "b": ["x"], "c": ["p", "q", "r"]}, ["a", "c"], 5), (2, {}, [], None)], "project_id int, knobs map<string,array<string>>, wired array<string>, max_trials int")
    got = {tuple(sorted(r.config.items())) for r in X.config_grid(p).where("project_id = 1").collect()}
    assert got == {(("a", a), ("b", "x"), ("c", c)) for a, c in itertools.product("12", "pqr")}
    assert [tuple(r) for r in X.search_space(p).orderBy("project_id").collect()] == [(1, 6, 6, 5, False), (2, 1, 1, None, None)]


def test_frontier_against_brute_force(spark):
    rng = random.Random(5)
    points = [(t, rng.randint(1, 6), rng.randint(0, 5) / 5) for t in range(1, 40)]
    s = scores(spark, *({"trial_id": t, "cost_usd": c / 1000, "score": m} for t, c, m in points))
    best = {t for t, c, m in points if not any((c2 < c and m2 >= m) or (c2 == c and (m2 > m or (m2 == m and t2 < t))) for t2, c2, m2 in points)}
    assert {r.trial_id for r in X.pareto_frontier(s, shards=3).collect()} == best


def test_ledger_refuses_without_debit(spark):
    e = spark.createDataFrame([(1, k, 10, c, c) for k, c in enumerate((5, 3, 9, 1))] + [(2, 1, 4, 5, 5)], "trial_id long, k long, budget long, reserve long, debit long")
    assert sorted(map(tuple, X.ledger_fold(e).collect())) == [(1, 3, 1, 1), (2, 0, 1, 4)]
    assert X.ledger_fold(e.limit(0)).collect() == []


def test_calibration_modes(spark):
    c = spark.createDataFrame([(1, 1, "binary", 0.8, 0.95, 0.2, 0.2), (1, 2, "graded", 0.8, 0.8, 0.75, 0.2), (1, 3, "graded", 1.0, 1.0, 1.0, 1.0)], "project_id int, row_id long, score_mode string, good double, equivalent_good double, partial double, bad double")
    got = {r.row_id: r for r in X.calibration_checks(c).collect()}
    assert got[1].partial_fails and got[1].partial_is_below_good is None and got[1].good_passes
    assert got[2].partial_is_below_good == (0.75 <= 0.8 - 0.05) and got[2].partial_is_above_bad
    assert not got[3].non_constant and not got[3].bad_fails


@pytest.mark.parametrize(("caps", "expected"), [([], (74, "WORKABLE", "OK", "proceed")), ([("x", 40, True, False), ("y", 30, False, True)], (30, "PARTIAL", "BLOCKED", "x")), ([("b", 65, False, True), ("a", 45, False, False)], (45, "PARTIAL", "OK", "b"))])
def test_readiness(spark, caps, expected):
    pillars = spark.createDataFrame([(1, 80.0, 70.0, 71.0)], "project_id int, dataset double, evaluation double, agent double")
    c = spark.createDataFrame([(1, *x) for x in caps], "project_id int, condition string, ceiling int, blocks boolean, asks boolean")
    assert tuple(X.readiness(pillars, c).first())[1:] == expected


def test_unmeasured_pillars_lose_their_weight(spark):
    pillars = spark.createDataFrame([(1, 90.0, None, None)], "project_id int, dataset double, evaluation double, agent double")
    none = spark.createDataFrame([], "project_id int, condition string, ceiling int, blocks boolean, asks boolean")
    assert X.readiness(pillars, none).first().overall == 90


def test_disclosed_windows(spark):
    import hashlib

    t = spark.createDataFrame([(1, "say ünlock now"), (2, "lock"), (3, None), (4, "")], "id long, text string")
    d = spark.createDataFrame([(hashlib.sha256(w.encode()).hexdigest(), len(w.encode())) for w in ("ünlock", "lock")], "digest string, n_bytes int")
    got = {(r.id, r.digest[:6]) for r in disclosure.disclosed(t, "id", "text", d).collect()}
    h = {w: hashlib.sha256(w.encode()).hexdigest()[:6] for w in ("ünlock", "lock")}
    assert got == {(1, h["ünlock"]), (1, h["lock"]), (2, h["lock"])}


def test_wiring(spark):
    a = spark.createDataFrame([(1, "k", v, m, r) for v, m, r in (("1", "a", "x"), ("2", "a", "y"), ("1", "b", "z"), ("2", "b", "z"))] + [(1, "one", "1", "a", "x"), (1, "dead", "1", "a", "x"), (1, "dead", "2", "a", "x")], "project_id int, knob string, value string, model string, request string")
    assert {r.knob: r.verdict for r in X.wiring_verdicts(a).collect()} == {"k": "partial", "one": "not-searched", "dead": "invisible"}


def test_overspent_and_costs(spark):
    assert dt.date(2025, 1, 1) and X.ledger_totals(scores(spark, {"cost_usd": 0.002}, {"cost_usd": None}, {"error_type": "RateLimitError", "cost_usd": 0.5})).first().asDict() == {"project_id": 1, "debit": 12000, "known_cost": 2000, "unreported_calls": 1, "unbilled_calls": 1, "refused_types": 1}
