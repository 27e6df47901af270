"""Queries of sweeps, calibration, ledger, run log and readiness, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import vocabulary as V
from sieveline.operators import dataset as D
from sieveline.operators import experiments as X
from sieveline.operators import runlog as R
from sieveline.plans.dataset_plans import _COUNTS, _PROV, _with
from sieveline.session import ship, table

t = table


def config_grid(s, d):
    return X.config_grid(t(s, d, "projects")).select("project_id", X.canonical(F.col("config")).alias("config"))


def search_space(s, d):
    return X.search_space(t(s, d, "projects"))


def score_validity(s, d):
    return X.score_validity(t(s, d, "trial_scores"))


def sweep_scores(s, d):
    return X.sweep_scores(t(s, d, "trial_scores"))


def best_config(s, d):
    return X.best_config(t(s, d, "trials"), t(s, d, "trial_scores"))


def sweep_complete(s, d):
    return X.sweep_complete(t(s, d, "trials"), t(s, d, "trial_scores"))


def incumbent_match(s, d):
    return X.incumbent_match(t(s, d, "trials"), t(s, d, "trial_scores"))


def pareto_frontier(s, d):
    return X.pareto_frontier(t(s, d, "trial_scores"))


def wiring_verdicts(s, d):
    return X.wiring_verdicts(X.requests(t(s, d, "projects")))


def calibration_checks(s, d):
    return X.calibration_checks(X.calibration_cases(t(s, d, "trial_scores"), t(s, d, "projects")))


def calibration_verdict(s, d):
    return X.calibration_verdict(calibration_checks(s, d))


def exception_outcomes(s, d):
    return X.exception_outcomes(t(s, d, "trial_scores"))


def seam_outcomes(s, d):
    return X.seam_outcomes(t(s, d, "trial_scores"))


def ledger_fold(s, d):
    ship(s)
    return X.ledger_fold(X.ledger_events(t(s, d, "trials"), t(s, d, "trial_scores")))


def ledger_totals(s, d):
    return X.ledger_totals(t(s, d, "trial_scores"))


def overspent_trials(s, d):
    return X.overspent_trials(t(s, d, "trials"))


def worst_case_requests(s, d):
    """Over all small combinations of the four settings."""
    calls = s.range(6).selectExpr("IF(id = 0, NULL, (id - 1) / 2.0D) AS num_retries").crossJoin(s.range(3).selectExpr("id / 1.0D AS library_retries")).crossJoin(s.range(4).selectExpr("IF(id = 0, NULL, id - 1.0D) AS max_retries")).crossJoin(s.range(3).selectExpr("CAST(id AS INT) AS fallbacks"))
    return X.worst_case_requests(calls)


def readiness_card(s, d):
    """Pillars measured from origin points, evaluator method and search space; caps from the checks."""
    rows, projects = t(s, d, "evaluation_rows"), t(s, d, "projects")
    space = X.search_space(projects)
    points = D.provenance_points(rows)
    known = F.coalesce(F.col("evaluator_method").isin(*V.EVALUATOR_METHODS), F.lit(False))
    pillars = projects.select("project_id", F.when(known, 100).otherwise(0).alias("evaluation")).join(points.select("project_id", (F.col("points") * 10).alias("dataset")), "project_id", "left").join(space.select("project_id", F.least(F.lit(100), F.col("wired_configurations") * 10).alias("agent")), "project_id")
    cap = lambda df, name, ceiling, blocks=False, asks=False: df.select("project_id", F.lit(name).alias("condition"), (F.lit(ceiling) if isinstance(ceiling, int) else ceiling).cast("int").alias("ceiling"), F.lit(blocks).alias("blocks"), F.lit(asks).alias("asks"))
    caps = cap(projects.join(rows.select("project_id").distinct(), "project_id", "left_anti"), "dataset-absent", 20, blocks=True)
    for other in (
        cap(D.label_counts(rows).where("scoreable_rows = 0"), "no-expected-outputs", 30, blocks=True),
        cap(projects.where("evaluator_method IS NULL"), "evaluator-absent", 40, blocks=True),
        cap(space.where("wired_configurations < 2"), "no-varying-knobs", 45),
        cap(points.where("ceiling IS NOT NULL"), "provenance", F.col("ceiling"), asks=True),
        cap(D.duplicate_summary(rows).where("groups > 0"), "repeated-rows", 89),
    ):
        caps = caps.unionByName(other)
    return X.readiness(pillars, caps)


def wilson_interval(s, d):
    return X.wilson(t(s, d, "trial_scores"))


def paired_mcnemar(s, d):
    return X.mcnemar(t(s, d, "trials"), t(s, d, "trial_scores"))


def normalized_entropy(s, d):
    return X.normalized_entropy(t(s, d, "evaluation_rows"))


def runlog_violations(s, d):
    return R.violations(t(s, d, "run_log"))


def runlog_leaks(s, d):
    return R.leaks(t(s, d, "run_log"))


def runlog_state_rule(s, d):
    return R.state_rule(t(s, d, "run_log"))


def runlog_summary(s, d):
    return R.summary(t(s, d, "run_log"))


_ALL = (
    config_grid, search_space, score_validity, sweep_scores, best_config, sweep_complete, incumbent_match, pareto_frontier, wiring_verdicts, calibration_checks, calibration_verdict, exception_outcomes, seam_outcomes,
    ledger_fold, ledger_totals, overspent_trials, worst_case_requests, readiness_card, wilson_interval, paired_mcnemar, normalized_entropy, runlog_violations, runlog_leaks, runlog_state_rule, runlog_summary,
)
QUERIES = {f.__name__: f for f in _ALL}

_S = """WITH sc AS (SELECT DISTINCT score_id, trial_id, row_id, project_id, score, error_type, cost_usd, scored_at,
  coalesce(NOT isnan(score) AND score BETWEEN 0 AND 1, false) AS ok FROM trial_scores),
k AS (SELECT *, CASE WHEN NOT ok THEN coalesce(error_type, CASE WHEN score IS NULL THEN 'missing' ELSE 'invalid' END) END AS kind FROM sc),
f AS (SELECT project_id, trial_id, kind, count(*) AS n, sum(CASE WHEN ok THEN round(score * 1000000)::BIGINT END) AS total FROM k GROUP BY ALL),
sw AS (SELECT project_id, trial_id, coalesce(sum(n) FILTER (kind IS NULL), 0)::BIGINT AS n_scored, coalesce(sum(n) FILTER (kind IS NOT NULL), 0)::BIGINT AS n_failed,
  coalesce(string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) FILTER (kind IS NOT NULL), '') AS failure_types, round(sum(total) / sum(n) FILTER (kind IS NULL) / 1000000, 6) AS mean_score FROM f GROUP BY ALL)"""
_CANON = "array_to_string(list_sort(list_transform(map_entries(config), lambda e: e.key || '=' || coalesce(e.value, 'null'))), ';')"
_BEST = f"{_S}, cf AS (SELECT trial_id, project_id, {_CANON} AS config FROM trials), bc AS (SELECT project_id, trial_id, config, mean_score FROM (SELECT sw.*, cf.config, row_number() OVER (PARTITION BY sw.project_id ORDER BY mean_score DESC, trial_id) AS r FROM sw JOIN cf USING (trial_id) WHERE mean_score IS NOT NULL) WHERE r = 1)"
_SPACE = """sp AS (SELECT project_id, max_trials, list_product(list_transform(map_values(knobs), lambda v: len(list_distinct(v))))::BIGINT AS configurations,
  list_product(list_transform(map_entries(knobs), lambda e: CASE WHEN list_contains(wired, e.key) THEN len(list_distinct(e.value)) ELSE 1 END))::BIGINT AS wired_configurations FROM projects)"""
_CASES = f"""{_S}, q AS (SELECT project_id, row_id, score, row_number() OVER (PARTITION BY project_id, row_id ORDER BY score_id) AS i FROM sc WHERE ok),
c AS (SELECT project_id, row_id, list(score ORDER BY score DESC) AS s FROM q WHERE i <= 4 GROUP BY ALL HAVING count(*) = 4),
x AS (SELECT c.project_id, row_id, CASE WHEN task_kind = 'routing' THEN 'binary' ELSE 'graded' END AS score_mode, s[1] AS good, s[2] AS eq, s[3] AS part, s[4] AS bad FROM c JOIN projects USING (project_id)),
ch AS (SELECT project_id, row_id, score_mode, good >= 0.8::DOUBLE AS good_passes, eq >= 0.8::DOUBLE AS equivalent_is_accepted, abs(good - eq) <= 0.15::DOUBLE AS equivalent_matches_good, bad <= 0.2::DOUBLE AS bad_fails,
  NOT (round(good, 8) = round(eq, 8) AND round(good, 8) = round(part, 8) AND round(good, 8) = round(bad, 8)) AS non_constant, CASE WHEN score_mode = 'binary' THEN part <= 0.2::DOUBLE END AS partial_fails,
  CASE WHEN score_mode = 'graded' THEN part <= least(good, eq) - 0.05::DOUBLE END AS partial_is_below_good, CASE WHEN score_mode = 'graded' THEN part >= bad + 0.05::DOUBLE END AS partial_is_above_bad FROM x)"""
_CLASS = " OR ".join(f"(event_name = '{e}' AND event_class IN ({', '.join(repr(n) for n in names)}))" for e, names in V.RUN_LOG_CLASSES.items())
_LOG = f"""WITH l AS (SELECT DISTINCT log_id, trial_id, ts, event_name, stage, event_class, state, detail FROM run_log),
m AS (SELECT *, coalesce({_CLASS}, false) AS kc, coalesce(event_name IN ('blocked', 'stopped', 'warning'), false) AS ke, coalesce(stage BETWEEN 1 AND 8, false) AS ks, coalesce(state IN ('open', 'cleared'), false) AS kst FROM l)"""

SQL = {
    "config_grid": """WITH g AS (SELECT project_id, knobs['temperature'] AS t, knobs['prompt_style'] AS p, knobs['model'] AS m, knobs['retrieval_k'] AS k FROM projects),
 a AS (SELECT project_id, m, p, k, unnest(t) AS t FROM g), b AS (SELECT project_id, m, k, t, unnest(p) AS p FROM a), c AS (SELECT project_id, k, t, p, unnest(m) AS m FROM b), e AS (SELECT project_id, t, p, m, unnest(coalesce(k, ['-'])) AS k FROM c)
 SELECT project_id, 'model=' || m || ';prompt_style=' || p || CASE WHEN k = '-' THEN '' ELSE ';retrieval_k=' || k END || ';temperature=' || t AS config FROM e""",
    "search_space": f"WITH {_SPACE} SELECT project_id, configurations, wired_configurations, max_trials, wired_configurations <= max_trials AS covered FROM sp",
    "score_validity": f"{_S} SELECT project_id, count(*) AS n_rows, count(*) FILTER (score IS NULL) AS missing, count(*) FILTER (isnan(score)) AS not_a_number, count(*) FILTER (NOT isnan(score) AND NOT score BETWEEN 0 AND 1) AS out_of_range, count(*) FILTER (ok) AS valid FROM sc GROUP BY 1",
    "sweep_scores": f"{_S} SELECT * FROM sw",
    "best_config": f"{_BEST} SELECT * FROM bc",
    "sweep_complete": f"{_S} SELECT t.project_id, count(*) AS trials, count(*) FILTER (n_failed = 0 AND n_scored > 0) AS clean_trials, bool_and(coalesce(n_failed = 0 AND n_scored > 0, false)) AS complete FROM trials t LEFT JOIN sw USING (trial_id) GROUP BY 1",
    "incumbent_match": f"{_BEST} SELECT cf.project_id, cf.config, count(*) AS matches, min(cf.trial_id) AS first_trial, count(*) = 1 AS accepted FROM cf JOIN bc ON bc.project_id = cf.project_id AND bc.config = cf.config GROUP BY ALL",
    "pareto_frontier": f"{_S}, co AS (SELECT project_id, trial_id, sum(round(cost_usd * 1000000)::BIGINT)::BIGINT AS cost FROM sc GROUP BY ALL HAVING count(*) = count(cost_usd)), pt AS (SELECT project_id, trial_id, cost, mean_score FROM sw JOIN co USING (project_id, trial_id) WHERE mean_score IS NOT NULL) SELECT * FROM pt a WHERE NOT EXISTS (SELECT 1 FROM pt b WHERE b.project_id = a.project_id AND (b.cost < a.cost AND b.mean_score >= a.mean_score OR b.cost = a.cost AND b.mean_score > a.mean_score OR b.cost = a.cost AND b.mean_score = a.mean_score AND b.trial_id < a.trial_id))",
    "wiring_verdicts": "SELECT project_id, e.key AS knob, CASE WHEN len(list_distinct(e.value)) < 2 THEN 'not-searched' WHEN list_contains(wired, e.key) THEN 'visible' ELSE 'invisible' END AS verdict FROM (SELECT project_id, wired, unnest(map_entries(knobs)) AS e FROM projects)",
    "calibration_checks": f"{_CASES} SELECT * FROM ch",
    "calibration_verdict": f"{_CASES} SELECT project_id, count(*) AS cases, count(*) FILTER (ok) AS passed, bool_and(ok) AND count(*) >= 2 AS calibrated, least(900, count(*) * 300) AS timeout_seconds FROM (SELECT project_id, good_passes AND equivalent_is_accepted AND equivalent_matches_good AND bad_fails AND non_constant AND coalesce(partial_fails, true) AND coalesce(partial_is_below_good, true) AND coalesce(partial_is_above_bad, true) AS ok FROM ch) GROUP BY 1",
    "exception_outcomes": f"{_S} SELECT project_id, CASE WHEN error_type IS NOT NULL THEN 'propagated-error' WHEN score IS NULL THEN 'unavailable' WHEN score = 0 THEN 'returned-zero' ELSE 'returned-nonzero' END AS outcome, count(*) AS n FROM sc GROUP BY ALL",
    "seam_outcomes": f"{_S}, rf AS (SELECT row_id, max(score) AS reference FROM sc WHERE ok GROUP BY 1), o AS (SELECT project_id, row_id, CASE WHEN error_type IS NOT NULL THEN 'r' WHEN NOT ok THEN 'u' WHEN reference >= 0.8::DOUBLE AND score < 0.8::DOUBLE THEN 'd' ELSE 'p' END AS o FROM sc LEFT JOIN rf USING (row_id)) SELECT project_id, row_id, count(*) FILTER (o = 'u') AS unavailable, count(*) FILTER (o = 'r') AS refused, count(*) FILTER (o = 'd') AS damaged, count(*) FILTER (o = 'p') AS preserved, count(*) FILTER (o = 'r') > 0 AND count(*) FILTER (o IN ('d', 'p')) = 0 AS off_domain FROM o GROUP BY ALL",
    "ledger_fold": f"""{_S}, b AS (SELECT trial_id, round(budget_usd * 0.001::DOUBLE * 1000000)::BIGINT AS budget FROM trials WHERE budget_usd IS NOT NULL),
 ev AS (SELECT trial_id, list(CASE WHEN error_type IN ('RateLimitError', 'ConnectionError') THEN 0 ELSE coalesce(round(cost_usd * 1000000)::BIGINT, 10000) END ORDER BY score_id) AS x FROM sc GROUP BY 1),
 r AS (SELECT trial_id, len(x) AS n, list_reduce(x, lambda acc, d: CASE WHEN acc // 10000000 >= 10000 THEN acc - d * 10000000 + 1 ELSE acc END, budget * 10000000) AS acc FROM ev JOIN b USING (trial_id))
 SELECT trial_id, ((acc + 1000000000000000) % 10000000)::BIGINT AS admitted, (n - (acc + 1000000000000000) % 10000000)::BIGINT AS refused, ((acc + 1000000000000000) // 10000000 - 100000000)::BIGINT AS remaining FROM r""",
    "ledger_totals": f"{_S} SELECT project_id, sum(CASE WHEN error_type IN ('RateLimitError', 'ConnectionError') THEN 0 ELSE coalesce(round(cost_usd * 1000000)::BIGINT, 10000) END)::BIGINT AS debit, coalesce(sum(round(cost_usd * 1000000)::BIGINT) FILTER (coalesce(error_type NOT IN ('RateLimitError', 'ConnectionError'), true)), 0)::BIGINT AS known_cost, count(*) FILTER (cost_usd IS NULL) AS unreported_calls, count(*) FILTER (error_type IN ('RateLimitError', 'ConnectionError')) AS unbilled_calls, count(DISTINCT error_type) FILTER (error_type IN ('RateLimitError', 'ConnectionError')) AS refused_types FROM sc GROUP BY 1",
    "overspent_trials": "SELECT trial_id, project_id, round(spent_usd - budget_usd, 4) AS over FROM trials WHERE spent_usd > budget_usd",
    "worst_case_requests": """WITH c AS (SELECT CASE WHEN a > 0 THEN (a - 1) / 2.0::DOUBLE END AS num_retries, l::DOUBLE AS library_retries, CASE WHEN m > 0 THEN (m - 1)::DOUBLE END AS max_retries, f::INT AS fallbacks FROM range(6) t(a), range(3) u(l), range(4) v(m), range(3) w(f)),
 n AS (SELECT *, CASE WHEN coalesce(num_retries, 0) <> 0 THEN num_retries ELSE library_retries END AS counted FROM c)
 SELECT num_retries, library_retries, max_retries, fallbacks, ((1 + CASE WHEN counted <> 0 THEN greatest(1, ceil(counted)) ELSE 0 END + greatest(0, ceil(coalesce(num_retries, max_retries, 0))) + CASE WHEN fallbacks > 0 AND coalesce(num_retries, 0) <> 0 THEN greatest(1, ceil(num_retries)) ELSE 0 END) * (1 + fallbacks))::BIGINT AS worst_case FROM n""",
    "readiness_card": _with(_PROV, _COUNTS, _SPACE, "pp AS (SELECT project_id, round(((collected - answered) * 10 + answered * 6 + synthesised * 3 + undeclared * 3) / n_rows, 4) AS points, CASE WHEN synthesised * 2 > n_rows THEN 65 WHEN undeclared * 2 > n_rows THEN 70 WHEN (synthesised + undeclared) * 2 > n_rows THEN 74 WHEN answered * 2 > n_rows THEN 74 END AS ceiling FROM pc)",
        "dupp AS (SELECT DISTINCT project_id FROM u GROUP BY project_id, ident HAVING count(*) > 1)",
        f"""cp AS (SELECT project_id, 'dataset-absent' AS c, 20 AS x, true AS b, false AS a FROM projects WHERE project_id NOT IN (SELECT project_id FROM evaluation_rows)
 UNION ALL SELECT project_id, 'no-expected-outputs', 30, true, false FROM lc WHERE scoreable_rows = 0 UNION ALL SELECT project_id, 'evaluator-absent', 40, true, false FROM projects WHERE evaluator_method IS NULL
 UNION ALL SELECT project_id, 'no-varying-knobs', 45, false, false FROM sp WHERE wired_configurations < 2 UNION ALL SELECT project_id, 'provenance', ceiling, false, true FROM pp WHERE ceiling IS NOT NULL UNION ALL SELECT project_id, 'repeated-rows', 89, false, false FROM dupp)""",
        "cm AS (SELECT project_id, min(x) AS ceiling, arg_min(c, x) FILTER (b) AS bc, arg_min(c, x) FILTER (a) AS ac FROM cp GROUP BY 1)",
        f"""ov AS (SELECT p.project_id, least(floor((coalesce(points * 10 * 40, 0) + CASE WHEN coalesce(evaluator_method IN ({', '.join(repr(m) for m in V.EVALUATOR_METHODS)}), false) THEN 100 ELSE 0 END * 35 + least(100, wired_configurations * 10) * 25) / (CASE WHEN points IS NULL THEN 60 ELSE 100 END)), coalesce(cm.ceiling, 100))::BIGINT AS overall, bc, ac
 FROM projects p LEFT JOIN pp USING (project_id) JOIN sp USING (project_id) LEFT JOIN cm USING (project_id))""",
    ) + "SELECT project_id, overall, CASE WHEN overall >= 90 THEN 'EXCELLENT' WHEN overall >= 75 THEN 'STRONG' WHEN overall >= 55 THEN 'WORKABLE' WHEN overall >= 30 THEN 'PARTIAL' ELSE 'NOT READY' END AS band, CASE WHEN bc IS NOT NULL THEN 'BLOCKED' ELSE 'OK' END AS status, coalesce(bc, ac, 'proceed') AS recommended_action FROM ov",
    "wilson_interval": f"{_S}, w AS (SELECT project_id, trial_id, count(*) AS n, count(*) FILTER (score >= 0.5) AS k, k / n AS p FROM sc WHERE ok GROUP BY ALL) SELECT project_id, trial_id, n, k, round((p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n), 6) AS low, round((p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n), 6) AS high FROM w",
    "paired_mcnemar": f"{_BEST}, fi AS (SELECT project_id, min(trial_id) AS first FROM trials GROUP BY 1), per AS (SELECT project_id, trial_id, row_id, max(score >= 0.5) AS ok FROM sc WHERE ok GROUP BY ALL), g AS (SELECT a.project_id, count(*) AS paired, count(*) FILTER (a.ok AND NOT b.ok) AS gained, count(*) FILTER (NOT a.ok AND b.ok) AS lost FROM per a JOIN bc ON bc.trial_id = a.trial_id AND bc.project_id = a.project_id JOIN fi ON fi.project_id = a.project_id JOIN per b ON b.project_id = a.project_id AND b.trial_id = fi.first AND b.row_id = a.row_id GROUP BY 1) SELECT *, round(CASE WHEN gained + lost > 0 THEN greatest(0, abs(gained - lost) - 1) * greatest(0, abs(gained - lost) - 1) / (gained + lost) END, 6) AS statistic FROM g",
    "normalized_entropy": "WITH g AS (SELECT project_id, difficulty, count(*) AS c FROM evaluation_rows WHERE difficulty IS NOT NULL GROUP BY ALL) SELECT project_id, count(*) AS k, round(CASE WHEN count(*) > 1 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) END, 6) AS entropy FROM g GROUP BY 1",
    "runlog_violations": f"""{_LOG} SELECT log_id, 'ts' AS rule FROM m WHERE NOT coalesce(regexp_full_match(ts, '[0-9]{{8}}T[0-9]{{6}}Z'), false) UNION ALL SELECT log_id, 'event' FROM m WHERE NOT ke UNION ALL SELECT log_id, 'stage' FROM m WHERE NOT ks
 UNION ALL SELECT log_id, 'class' FROM m WHERE ke AND NOT kc UNION ALL SELECT log_id, 'state' FROM m WHERE NOT kst UNION ALL SELECT log_id, 'detail-empty' FROM m WHERE coalesce(trim(detail), '') = '' UNION ALL SELECT log_id, 'detail-long' FROM m WHERE length(detail) > 400""",
    "runlog_state_rule": f"{_LOG} SELECT log_id FROM (SELECT log_id, state, lag(state) OVER (PARTITION BY trial_id, event_name, stage, event_class ORDER BY log_id) AS b FROM m WHERE kc AND ks AND kst) WHERE state = 'cleared' AND coalesce(b, '') <> 'open'",
}
