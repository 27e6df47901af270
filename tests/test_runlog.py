import pytest

from sieveline.operators import runlog as R
from sieveline.streaming import runlog_state
from tests.helpers import LOG, clashing


def log(spark, *given):
    names = [c.split(" ")[0] for c in LOG.split(", ")]
    base = {"trial_id": 1, "ts": "20250101T000000Z", "event_name": "blocked", "stage": 1, "event_class": "key", "state": "open", "detail": "a sentence"}
    return spark.createDataFrame([tuple(({"log_id": i} | base | g).get(n) for n in names) for i, g in enumerate(given, 1)], LOG)


def test_rules(spark):
    df = log(spark, {}, {"ts": "2025"}, {"event_name": "odd"}, {"stage": 9}, {"event_class": "timeout"}, {"state": "shut"}, {"detail": "  "}, {"detail": "x" * 401}, {c: None for c in ("ts", "event_name", "stage", "event_class", "state", "detail")})
    got = sorted(map(tuple, R.violations(df.unionByName(df)).collect()))
    assert got == sorted([(2, "ts"), (3, "event"), (4, "stage"), (5, "class"), (6, "state"), (7, "detail-empty"), (8, "detail-long"), (9, "ts"), (9, "event"), (9, "stage"), (9, "state"), (9, "detail-empty")])
    assert sorted(map(tuple, R.violations(clashing(df)).collect())) == got
    assert R.violations(df.limit(0)).collect() == []


@pytest.mark.parametrize(("detail", "leak"), [("wrote /home/a/b", "path"), ("and/or 3/5", None), ("sk-abcdefgh1234", "credential"), ("ask a.b@c.org", "email"), ("id 0123456789abcdef01", "identifier"), ("see http://x", "url"), ("at 10.0.0.1", "host"), ('said "this is a rather long quoted row"', "quotation"), ("the user's approval before the provider's trial", None)])
def test_leaks(spark, detail, leak):
    got = {r.leak for r in R.leaks(log(spark, {"detail": detail})).collect()}
    assert leak in got if leak else not got


def states(spark):
    return log(spark, {"state": "cleared"}, {}, {"state": "cleared"}, {"state": "cleared"}, {"stage": 2, "state": "cleared"}, {}, {}, {"state": "cleared"}, {"trial_id": 2, "state": "cleared"})


def test_state_rule(spark):
    assert sorted(r.log_id for r in R.state_rule(states(spark)).collect()) == [1, 4, 5, 9]


def test_stream_equals_batch(spark, tmp_path):
    df = states(spark)
    for k, (a, b) in enumerate(((1, 3), (4, 6), (7, 9))):
        df.where(f"log_id BETWEEN {a} AND {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    got = runlog_state.run_once(spark, str(tmp_path / "log"), files_per_trigger=1)
    assert sorted(r.log_id for r in got.collect()) == [1, 4, 5, 9]
