"""Queries of runs, scorers, reviews and first findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import vocabulary as V
from sieveline.operators import dataset as D
from sieveline.operators import experiments as E
from sieveline.operators import runlog
from sieveline.operators import runs as R
from sieveline.plans.dataset_plans import _HASID, _REPORT, _with, identity, strip, words
from sieveline.plans.experiment_plans import _CASES, _LOG, _S, _SPACE
from sieveline.plans.experiment_plans import SQL as EXPERIMENTS
from sieveline.plans.source_plans import _lines
from sieveline.session import scratch, ship, table
from sieveline.sources import jsonl, sinks

t = table


def config_rows(s, d):
    """How many rows each configuration is run on."""
    product = R.config_rows(t(s, d, "projects"), t(s, d, "evaluation_rows"))
    return product.groupBy("project_id", E.canonical(F.col("config")).alias("config")).agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def _cases(s, d):
    return E.calibration_cases(t(s, d, "trial_scores"), t(s, d, "projects"))


def case_probes(s, d):
    return R.case_probes(_cases(s, d))


def permutation_distinguished(s, d):
    return R.permutation_distinguished(_cases(s, d))


def outcome_classes(s, d):
    return R.outcome_classes(t(s, d, "evaluation_rows"))


def bridge_wiring(s, d):
    return R.bridge_wiring(t(s, d, "projects"), t(s, d, "trials"))


def scoreable_rows(s, d):
    return R.scoreable(t(s, d, "evaluation_rows"), t(s, d, "projects"))


def tuning_counts(s, d):
    return R.tuning_counts(t(s, d, "evaluation_rows"))


def review_unmatched(s, d):
    rows = t(s, d, "evaluation_rows")
    return R.review_unmatched(R.digest_reviews(rows), rows)


def integrity_counts(s, d):
    readable = lambda o: ~o.rlike(r"^\s*\{") | F.try_parse_json(o).isNotNull()
    return R.integrity(jsonl.scan(s, _lines(s, d)), readable)


def worst_verdicts(s, d):
    return R.worst_verdicts(D.check_report(t(s, d, "evaluation_rows")))


def first_findings(s, d):
    return R.first_findings(runlog.violations(t(s, d, "run_log")), "rule", "log_id")


def provider_costs(s, d):
    """Costs read back from responses that report them in one place or another, by project."""
    scores = E.distinct_scores(t(s, d, "trial_scores"))
    cost = F.col("cost_usd")
    plain = lambda path: F.concat(F.lit(path[0]), cost.cast("string"), F.lit(path[1]))
    response = F.when(cost.isNull(), '{"usage": {"tokens": 3}}').when(F.col("score_id") % 3 == 0, plain(('{"usage": {"cost": ', "}}"))).when(F.col("score_id") % 3 == 1, plain(('{"cost": ', "}"))).otherwise(plain(('{"_hidden_params": {"response_cost": ', "}}")))
    got = scores.select("project_id", R.provider_cost(response).alias("got"))
    return got.groupBy("project_id").agg(F.count("got").alias("n"), F.sum(E.micro(F.col("got"))).alias("cost"))


def sweep_admission(s, d):
    return R.sweep_admission(t(s, d, "projects"), t(s, d, "evaluation_rows"), t(s, d, "trials"))


def repeated_answers(s, d):
    return R.repeated_answers(t(s, d, "evaluation_rows")).drop("fields")


def repeated_objects(s, d):
    return R.repeated_answers(t(s, d, "evaluation_rows")).where("fields IS NOT NULL").select("project_id", "row_id", "first_row", "fields")


def row_draw(s, d):
    return R.row_draw(t(s, d, "evaluation_rows"))


def scorer_calls(s, d):
    """A user's scorer over all outputs against themselves: by outcome how many."""
    ship(s)

    def same(output, expected, input_data, metadata):
        return 1.0 if output == expected and len(output) < 40 else len(output) / 40 if len(output) < 80 else 1 / (len(output) - len(output))

    rows = t(s, d, "evaluation_rows").select("row_id", "output", F.col("output").alias("expected"), F.col("input").alias("input_data"), "metadata")
    return R.scored(rows, same).groupBy("error").agg(F.count("*").alias("n"), F.count("score").alias("n_scored"))


def agent_calls(s, d):
    """A user's agent over all rows: by what it says of its call how many. It is not shown any expected output."""
    ship(s)

    def agent(input, metadata, id, config):
        return None if input is None else "leak" if any(k.startswith("output") for k in metadata) else "ok"

    rows = t(s, d, "evaluation_rows").withColumn("config", F.create_map(F.lit("model"), F.lit("m")))
    return R.answered(rows.select("row_id", "id", "input", "metadata", "config", "output"), agent).groupBy("reply", "error").agg(F.count("*").alias("n"))


def baseline_record(s, d):
    """Write the sweep as the baseline and read it back."""
    path = scratch(s, "baseline")
    sinks.write_baseline(E.sweep_scores(t(s, d, "trial_scores")), path)
    return sinks.read_baseline(s, path)


# The ceilings of the conditions that cap a score, and which of them block or ask.
CAPS = {
    "dataset-absent": (20, True, False), "no-expected-outputs": (30, True, False), "integrity": (35, True, False), "evaluator-absent": (40, True, False), "no-varying-knobs": (45, False, False), "unvalidated-evaluator": (45, False, False),
    "fully-synthetic": (65, False, False), "generated-answer-key": (74, False, True), "coarse-resolution": (89, False, False), "repeated-rows": (89, False, False),
}
#: Project, pillars, what is withheld, caps, what else is asked.
_CARDS = (
    (1, (80.0, 75.0, 40.0), (), ("no-varying-knobs", "fully-synthetic", "coarse-resolution"), None),
    (2, (90.0, 88.0, 95.0), (), ("generated-answer-key",), None),
    (3, (None, None, 30.0), ("dataset",), ("dataset-absent", "evaluator-absent", "no-varying-knobs"), None),
    (4, (90.0, 90.0, 94.0), (), (), "review-answer-key"),
    (5, (90.0, 80.0, None), ("agent",), ("integrity",), None),
)


def expected_cards(s, d):
    """Cards of an advisory, an asking, a blocked, a clean and a withheld case."""
    pillars = s.createDataFrame([(i, *p, list(w)) for i, p, w, _, _ in _CARDS], "project_id int, dataset double, evaluation double, agent double, withheld array<string>")
    caps = s.createDataFrame([(i, c, *CAPS[c]) for i, _, _, cs, _ in _CARDS for c in cs], "project_id int, condition string, ceiling int, blocks boolean, asks boolean")
    asks = s.createDataFrame([(i, a) for i, *_, a in _CARDS if a], "project_id int, action string")
    return E.readiness(pillars, caps, asks)


_ALL = (
    config_rows, case_probes, permutation_distinguished, outcome_classes, bridge_wiring, scoreable_rows, tuning_counts, review_unmatched, integrity_counts, worst_verdicts, first_findings, provider_costs, sweep_admission,
    repeated_answers, repeated_objects, row_draw, scorer_calls, agent_calls, baseline_record, expected_cards,
)
QUERIES = {f.__name__: f for f in _ALL}

_FREE = ", ".join(f"'{m}'" for m in V.REFERENCE_FREE)
_UNKNOWN = f"sp IS NOT NULL AND {strip('sp')} <> '' AND side IS NULL"
_QUOTA = "CASE " + " ".join(f"WHEN side = '{s}' AND band = '{b}' THEN {n}" for s, bands in R.DRAWN.items() for b, n in bands.items()) + " END"

SQL = {
    "config_rows": EXPERIMENTS["config_grid"].replace(" a AS (", " ga AS (").replace("FROM a)", "FROM ga)").replace("WITH g AS", _with("tu AS (SELECT project_id, count(*) AS n_rows, min(row_id) AS first_row, max(row_id) AS last_row FROM u WHERE side = 'tuning' GROUP BY 1)").rstrip() + ", g AS", 1).replace("SELECT project_id, 'model='", "SELECT e.project_id, 'model='").replace("AS config FROM e", "AS config, n_rows, first_row, last_row FROM e JOIN tu ON tu.project_id = e.project_id"),
    "case_probes": f"{_CASES} SELECT project_id, row_id, 'good' AS probe, good AS score FROM x UNION ALL SELECT project_id, row_id, 'equivalent_good', eq FROM x UNION ALL SELECT project_id, row_id, 'partial', part FROM x UNION ALL SELECT project_id, row_id, 'bad', bad FROM x",
    "permutation_distinguished": f"{_CASES} SELECT project_id, row_id, part <= 0.2::DOUBLE AS distinguished FROM x",
    "outcome_classes": f"{_with()} SELECT project_id, string_agg(cov, ',' ORDER BY cov) AS classes FROM (SELECT DISTINCT project_id, cov FROM r WHERE cov IS NOT NULL) GROUP BY 1",
    "bridge_wiring": """WITH k AS (SELECT project_id, e.key AS knob, len(list_distinct(e.value)) AS n FROM (SELECT project_id, unnest(map_entries(knobs)) AS e FROM projects)),
 o AS (SELECT project_id, e.key AS knob, count(DISTINCT e.value) AS c FROM (SELECT project_id, unnest(map_entries(config)) AS e FROM trials) GROUP BY ALL)
 SELECT k.project_id, k.knob, CASE WHEN n < 2 THEN 'not-searched' WHEN coalesce(c, 0) = 0 THEN 'unobserved' WHEN c > 1 THEN 'visible' ELSE 'ignored' END AS verdict FROM k LEFT JOIN o ON o.project_id = k.project_id AND o.knob = k.knob""",
    "scoreable_rows": f"{_with()} SELECT r.project_id, CASE WHEN coalesce(any_value(evaluator_method) IN ({_FREE}), false) THEN count(*) ELSE count(*) FILTER (lab) END AS scoreable_rows FROM r JOIN projects p ON p.project_id = r.project_id WHERE input IS NOT NULL GROUP BY 1",
    "tuning_counts": f"{_with()} SELECT project_id, count(*) FILTER (side = 'tuning') AS tuning_rows, count(*) FILTER ({_UNKNOWN}) AS unknown_rows, count(*) FILTER ({_UNKNOWN}) > 0 AS refused FROM r GROUP BY 1",
    "review_unmatched": f"SELECT DISTINCT project_id, substr(sha256(lower(id)), 1, 16) AS digest FROM evaluation_rows WHERE id IS NOT NULL EXCEPT SELECT project_id, substr(sha256(CASE WHEN {_HASID} THEN id ELSE 'line-' || line_no END), 1, 16) FROM evaluation_rows",
    "integrity_counts": f"""WITH f AS (SELECT split IS NULL OR difficulty IS NULL AS m, coalesce({strip('output')} <> '', false) AS lab, NOT regexp_matches(coalesce(output, ''), '^\\s*\\{{') OR json_valid(output) AS ok FROM evaluation_rows)
 SELECT count(*) AS candidate_rows, count(*) FILTER (m OR NOT lab OR NOT ok) AS invalid_rows, count(*) FILTER (m) AS malformed_rows, count(*) FILTER (NOT m AND NOT lab) AS unlabelled_rows, count(*) FILTER (NOT m AND lab AND NOT ok) AS unreadable_rows FROM f""",
    "worst_verdicts": _with(_REPORT) + """, z AS (SELECT project_id, status, string_agg("check", ',' ORDER BY "check") AS checks, list_position(['PASS', 'SKIP', 'WARN', 'FAIL'], status) AS v FROM rep GROUP BY ALL) SELECT project_id, status, checks FROM z QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY v DESC) = 1""",
    "first_findings": f"WITH found AS ({EXPERIMENTS['runlog_violations']}) SELECT * FROM (SELECT rule, log_id, row_number() OVER (PARTITION BY rule ORDER BY log_id)::INT AS \"at\", count(*) OVER (PARTITION BY rule) AS total FROM found) WHERE \"at\" <= 10",
    "provider_costs": f"{_S} SELECT project_id, count(cost_usd) AS n, sum(round(cost_usd * 1000000)::BIGINT)::BIGINT AS cost FROM sc GROUP BY 1",
    "sweep_admission": _with(_SPACE, "tu AS (SELECT project_id, count(*) AS n FROM u WHERE side = 'tuning' GROUP BY 1)", "bu AS (SELECT project_id, sum(round(budget_usd * 1000000)::BIGINT)::BIGINT AS b FROM trials GROUP BY 1)")
    + "SELECT sp.project_id, configurations * coalesce(n, 0) AS calls, configurations * coalesce(n, 0) * 10000 AS reserve, coalesce(b, 0) AS budget, configurations * coalesce(n, 0) * 10000 <= coalesce(b, 0) AS admitted FROM sp LEFT JOIN tu ON tu.project_id = sp.project_id LEFT JOIN bu ON bu.project_id = sp.project_id",
    "repeated_answers": _with(
        f"b AS (SELECT project_id, row_id, ident, output, {identity('output')} AS oi, list_distinct({words('output')}) AS ow, TRY_CAST({strip('output')} AS DOUBLE) AS num, min(row_id) OVER (PARTITION BY project_id, ident) AS first_row FROM u)"
    ) + """SELECT x.project_id, x.row_id, x.first_row, (x.oi = y.oi)::INT::DOUBLE AS exact, (abs(x.num - y.num) <= 0.000001::DOUBLE)::INT::DOUBLE AS number,
 round(CASE WHEN len(x.ow) + len(y.ow) = 0 THEN 1 ELSE 2 * len(list_intersect(x.ow, y.ow)) / (len(x.ow) + len(y.ow)) END, 9)::DOUBLE AS words FROM b x JOIN b y ON y.row_id = x.first_row WHERE x.row_id <> x.first_row""",
    "row_draw": _with(
        "g AS (SELECT project_id, side, md5(ident) AS i, arg_min(band, row_id) FILTER (band IS NOT NULL OR true) AS band0, min(row_id) AS low, count(*) AS n FROM u WHERE side IS NOT NULL GROUP BY ALL)",
        "gb AS (SELECT g.project_id, g.side, g.i, u.band, g.n FROM g JOIN u ON u.row_id = g.low)",
        f"q AS (SELECT *, {_QUOTA} AS quota FROM gb)",
        "f AS (SELECT *, sum(n) OVER (PARTITION BY project_id, side, band ORDER BY md5('draw-1|' || i), i ROWS UNBOUNDED PRECEDING) AS upto FROM q WHERE quota IS NOT NULL)",
    ) + "SELECT f.project_id, f.side, f.band, u.row_id FROM f JOIN u ON u.project_id = f.project_id AND u.side = f.side AND md5(u.ident) = f.i WHERE upto <= quota",
    "scorer_calls": "SELECT CASE WHEN output IS NULL THEN 'missing' WHEN length(output) < 40 THEN NULL WHEN length(output) = 40 THEN NULL WHEN length(output) < 80 THEN 'score out of range' ELSE 'ZeroDivisionError' END AS error, count(*) AS n, count(*) FILTER (length(output) <= 40) AS n_scored FROM evaluation_rows GROUP BY 1",
    "agent_calls": "SELECT CASE WHEN input IS NOT NULL THEN 'ok' END AS reply, CASE WHEN input IS NULL THEN 'reply is not a text' END AS error, count(*) AS n FROM evaluation_rows GROUP BY ALL",
    "baseline_record": EXPERIMENTS["sweep_scores"],
    "expected_cards": """SELECT * FROM (VALUES (1, 45::BIGINT, 'PARTIAL', 'OK', 'proceed'), (2, 74, 'WORKABLE', 'OK', 'generated-answer-key'), (3, 11, 'NOT READY', 'BLOCKED', 'dataset-absent'),
 (4, 91, 'WORKABLE', 'OK', 'review-answer-key'), (5, 35, 'PARTIAL', 'BLOCKED', 'integrity')) t(project_id, overall, band, status, recommended_action)""",
}
