"""Sweeps of configurations, their scores, calibration of scorers, and the spend ledger.

Inputs: ``projects`` (project_id, knobs, wired, max_trials, evaluator_method, task_kind), ``trials`` (trial_id, project_id, phase, config,
status, budget_usd, spent_usd) and ``scores`` (score_id, trial_id, row_id, project_id, score, error_type, cost_usd, scored_at). Repeated score
rows count once; null, non-finite and out-of-range scores are failures; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.vocabulary import THRESHOLDS as T

#: Whole numbers of this part of a dollar are added, so that sums do not depend on their order.
MICRO = 1_000_000
CONSERVATIVE_USD = 0.01
#: Errors raised before a provider bills.
UNBILLED = ("RateLimitError", "ConnectionError")


def distinct_scores(scores: DataFrame) -> DataFrame:
    return scores.select("score_id", "trial_id", "row_id", "project_id", "score", "error_type", "cost_usd", "scored_at").distinct()


def valid_score() -> Column:
    s = F.col("score")
    return s.isNotNull() & ~F.isnan(s) & s.between(0.0, 1.0)


def micro(c: Column) -> Column:
    return F.round(c * MICRO).cast("long")


def canonical(config: Column) -> Column:
    """A configuration with its keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")


def config_grid(projects: DataFrame, wired_only: bool = False) -> DataFrame:
    """(project_id, config): every combination of a project's knob values. The product is bounded by the knobs of one project."""
    knobs = F.map_filter("knobs", lambda k, v: F.array_contains("wired", k)) if wired_only else F.col("knobs")
    start = F.array(F.create_map().cast("map<string,string>"))
    product = F.aggregate(F.map_entries(knobs), start, lambda done, e: F.flatten(F.transform(done, lambda m: F.transform(F.array_distinct(e["value"]), lambda v: F.map_concat(m, F.create_map(e["key"], v))))))
    return projects.select("project_id", F.explode(product).alias("config"))


def search_space(projects: DataFrame) -> DataFrame:
    """Distinct configurations, those of wired knobs, and whether the trial limit covers the latter."""
    size = lambda knobs: F.aggregate(F.map_values(knobs), F.lit(1).cast("long"), lambda n, v: n * F.size(F.array_distinct(v)))
    wired = size(F.map_filter("knobs", lambda k, v: F.array_contains("wired", k)))
    return projects.select("project_id", size(F.col("knobs")).alias("configurations"), wired.alias("wired_configurations"), "max_trials", (wired <= F.col("max_trials")).alias("covered"))


def score_validity(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    return distinct_scores(scores).groupBy("project_id").agg(F.count("*").alias("n_rows"), F.count_if(s.isNull()).alias("missing"), F.count_if(F.isnan(s)).alias("not_a_number"), F.count_if(~F.isnan(s) & ~s.between(0.0, 1.0)).alias("out_of_range"), F.count_if(valid_score()).alias("valid"))


def sweep_scores(scores: DataFrame) -> DataFrame:
    """Per trial: scored and failed rows, failures by type and the mean score."""
    kind = F.when(valid_score(), None).otherwise(F.coalesce("error_type", F.when(F.col("score").isNull(), "missing").otherwise("invalid")))
    by = distinct_scores(scores).groupBy("project_id", "trial_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.when(valid_score(), F.round(F.col("score") * MICRO).cast("long"))).alias("total"))
    return by.groupBy("project_id", "trial_id").agg(
        F.sum(F.when(F.col("kind").isNull(), F.col("n")).otherwise(0)).alias("n_scored"), F.sum(F.when(F.col("kind").isNotNull(), F.col("n")).otherwise(0)).alias("n_failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.concat("kind", F.lit("="), F.col("n").cast("string"))))), ",").alias("failure_types"),
        F.round(F.sum("total") / F.sum(F.when(F.col("kind").isNull(), F.col("n"))) / MICRO, 6).alias("mean_score"),
    )


def trial_costs(scores: DataFrame) -> DataFrame:
    return distinct_scores(scores).groupBy("project_id", "trial_id").agg(F.sum(micro(F.col("cost_usd"))).alias("cost"), F.count_if(F.col("cost_usd").isNull()).alias("unreported"))


def best_config(trials: DataFrame, scores: DataFrame) -> DataFrame:
    """Per project the trial of the highest mean; of equal ones the smallest."""
    swept = sweep_scores(scores).where("mean_score IS NOT NULL").join(trials.select("trial_id", canonical(F.col("config")).alias("config")), "trial_id")
    top = swept.groupBy("project_id").agg(F.max_by(F.struct("trial_id", "config", "mean_score"), F.struct("mean_score", -F.col("trial_id"))).alias("t"))
    return top.select("project_id", "t.*")


def sweep_complete(trials: DataFrame, scores: DataFrame) -> DataFrame:
    """Whether a project's sweep ran every trial without a failure."""
    done = trials.select("project_id", "trial_id").join(sweep_scores(scores).select("trial_id", "n_scored", "n_failed"), "trial_id", "left")
    ok = F.coalesce((F.col("n_failed") == 0) & (F.col("n_scored") > 0), F.lit(False))
    return done.groupBy("project_id").agg(F.count("*").alias("trials"), F.count_if(ok).alias("clean_trials"), F.every(ok).alias("complete"))


def incumbent_match(trials: DataFrame, scores: DataFrame) -> DataFrame:
    """Trials with exactly the selected configuration of their project; a transfer needs exactly one."""
    best = best_config(trials, scores).select("project_id", "config")
    same = trials.select("project_id", canonical(F.col("config")).alias("config"), "trial_id").join(best, ["project_id", "config"])
    return same.groupBy("project_id", "config").agg(F.count("*").alias("matches"), F.min("trial_id").alias("first_trial")).withColumn("accepted", F.col("matches") == 1)


def pareto_frontier(scores: DataFrame, shards: int = 64) -> DataFrame:
    """Trials of measured cost that no cheaper or equal one beats. Each shard of a project gives its own frontier first, so that a project's trials are never sorted in one task."""
    points = sweep_scores(scores).join(trial_costs(scores).where("unreported = 0"), ["project_id", "trial_id"]).where("mean_score IS NOT NULL AND cost IS NOT NULL").select("project_id", "trial_id", "cost", "mean_score")

    def front(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("cost", F.desc("mean_score"), "trial_id").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_best", F.max("mean_score").over(w)).where("_best IS NULL OR mean_score > _best").drop("_best")

    local = front(points.withColumn("shard", F.pmod(F.xxhash64("trial_id"), F.lit(shards))), "project_id", "shard").drop("shard")
    return front(local, "project_id")


def requests(projects: DataFrame) -> DataFrame:
    """(project_id, knob, value, model, request): what one change of a knob makes of the base configuration, of wired knobs only."""
    base = F.transform_values("knobs", lambda k, v: F.get(v, F.lit(0)))
    models = F.coalesce(F.col("knobs")["model"], F.array(F.lit("none")))
    one = projects.select("project_id", "wired", base.alias("base"), F.explode(models).alias("model"), F.col("knobs"))
    each = one.select("project_id", "wired", "base", "model", F.explode("knobs").alias("knob", "values")).select("*", F.explode("values").alias("value"))
    changed = F.map_zip_with("base", F.create_map("knob", "value"), lambda k, a, b: F.coalesce(b, F.when(k == "model", F.col("model")).otherwise(a)))
    return each.select("project_id", "knob", "value", "model", canonical(F.map_filter(changed, lambda k, v: F.array_contains("wired", k))).alias("request"))


def wiring_verdicts(asked: DataFrame) -> DataFrame:
    """Per knob: not-searched, visible (every value makes its own request under every model), partial or invisible."""
    per = asked.groupBy("project_id", "knob", "model").agg(F.count_distinct("value").alias("v"), F.count_distinct("request").alias("r"))
    g = per.groupBy("project_id", "knob").agg(F.max("v").alias("v"), F.every(F.col("r") == F.col("v")).alias("all"), F.some((F.col("r") == F.col("v")) & (F.col("v") > 1)).alias("any"))
    return g.select("project_id", "knob", F.when(F.col("v") < 2, "not-searched").when(F.col("all"), "visible").when(F.col("any"), "partial").otherwise("invisible").alias("verdict"))


def calibration_cases(scores: DataFrame, projects: DataFrame) -> DataFrame:
    """Cases made of rows with four valid scores: the first four by score id, ordered as good, equivalent, partial and bad."""
    v = distinct_scores(scores).where(valid_score())
    w = Window.partitionBy("project_id", "row_id").orderBy("score_id")
    four = v.withColumn("k", F.row_number().over(w)).where("k <= 4").groupBy("project_id", "row_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") == 4)
    probe = lambda i, name: F.get("s", F.lit(i)).alias(name)
    mode = F.when(F.col("task_kind") == "routing", "binary").otherwise("graded")
    return four.join(projects.select("project_id", mode.alias("score_mode")), "project_id").select("project_id", "row_id", "score_mode", probe(0, "good"), probe(1, "equivalent_good"), probe(2, "partial"), probe(3, "bad"))


def calibration_checks(cases: DataFrame) -> DataFrame:
    """The checks of each case; a check that its mode lacks is null."""
    c = F.col
    near = lambda x: F.round(x, 8)
    binary = c("score_mode") == "binary"
    constant = (near(c("good")) == near(c("equivalent_good"))) & (near(c("good")) == near(c("partial"))) & (near(c("good")) == near(c("bad")))
    return cases.select(
        "project_id", "row_id", "score_mode", (c("good") >= T["good_minimum"]).alias("good_passes"), (c("equivalent_good") >= T["good_minimum"]).alias("equivalent_is_accepted"),
        (F.abs(c("good") - c("equivalent_good")) <= T["equivalence_tolerance"]).alias("equivalent_matches_good"), (c("bad") <= T["bad_maximum"]).alias("bad_fails"), (~constant).alias("non_constant"),
        F.when(binary, c("partial") <= T["bad_maximum"]).alias("partial_fails"), F.when(~binary, c("partial") <= F.least("good", "equivalent_good") - T["separation_margin"]).alias("partial_is_below_good"),
        F.when(~binary, c("partial") >= c("bad") + T["separation_margin"]).alias("partial_is_above_bad"),
    )


CHECKS = ("good_passes", "equivalent_is_accepted", "equivalent_matches_good", "bad_fails", "non_constant", "partial_fails", "partial_is_below_good", "partial_is_above_bad")


def calibration_verdict(checks: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for name in CHECKS:
        ok = ok & F.coalesce(F.col(name), F.lit(True))
    g = checks.withColumn("ok", ok).groupBy("project_id").agg(F.count("*").alias("cases"), F.count_if("ok").alias("passed"), F.every("ok").alias("all_pass"))
    return g.select("project_id", "cases", "passed", (F.col("all_pass") & (F.col("cases") >= 2)).alias("calibrated"), F.least(F.lit(900).cast("long"), F.col("cases") * 4 * 75).alias("timeout_seconds"))


def exception_outcomes(scores: DataFrame) -> DataFrame:
    o = F.when(F.col("error_type").isNotNull(), "propagated-error").when(F.col("score").isNull(), "unavailable").when(F.col("score") == 0, "returned-zero").otherwise("returned-nonzero")
    return distinct_scores(scores).groupBy("project_id", o.alias("outcome")).agg(F.count("*").alias("n"))


def seam_outcomes(scores: DataFrame) -> DataFrame:
    """Per row the outcomes of its deliveries against its best score, and whether all that ran were refused."""
    d = distinct_scores(scores)
    reference = d.where(valid_score()).groupBy("row_id").agg(F.max("score").alias("reference"))
    o = F.when(F.col("error_type").isNotNull(), "refused").when(~valid_score(), "unavailable").when((F.col("reference") >= T["good_minimum"]) & (F.col("score") < T["good_minimum"]), "damaged").otherwise("preserved")
    ran = d.join(reference, "row_id", "left").withColumn("o", o).groupBy("project_id", "row_id")
    g = ran.agg(*(F.count_if(F.col("o") == x).alias(x) for x in ("unavailable", "refused", "damaged", "preserved")))
    return g.withColumn("off_domain", (F.col("refused") > 0) & (F.col("damaged") + F.col("preserved") == 0))


def ledger_events(trials: DataFrame, scores: DataFrame, budget_share: float = 0.001) -> DataFrame:
    """(trial_id, k, budget, reserve, debit) in micro-dollars: what each call reserves and what it is settled to."""
    reserve = F.lit(int(CONSERVATIVE_USD * MICRO)).cast("long")
    debit = F.when(F.col("error_type").isin(*UNBILLED), F.lit(0).cast("long")).otherwise(F.coalesce(micro(F.col("cost_usd")), reserve))
    budget = trials.select("trial_id", micro(F.col("budget_usd") * budget_share).alias("budget")).where("budget IS NOT NULL")
    return distinct_scores(scores).join(budget, "trial_id").select("trial_id", F.col("score_id").alias("k"), "budget", reserve.alias("reserve"), debit.alias("debit"))


def ledger_fold(events: DataFrame) -> DataFrame:
    """(trial_id, admitted, refused, remaining): calls in order; one whose reserve exceeds what remains is refused and costs nothing.

    A later call may still fit, so this is no running sum. Rows of a trial are sorted and streamed through one
    running balance; no trial is held in memory.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        trial, remaining, yes, no = None, 0, 0, 0
        for batch in batches:
            for t, budget, reserve, debit in zip(*(batch.column(c).to_pylist() for c in ("trial_id", "budget", "reserve", "debit"))):
                if t != trial:
                    if trial is not None:
                        out.append((trial, yes, no, remaining))
                    trial, remaining, yes, no = t, budget, 0, 0
                if remaining >= reserve:
                    remaining, yes = remaining - debit, yes + 1
                else:
                    no += 1
        if trial is not None:
            out.append((trial, yes, no, remaining))
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["trial_id", "admitted", "refused", "remaining"])

    ordered = events.repartition("trial_id").sortWithinPartitions("trial_id", "k")
    return ordered.select("trial_id", "budget", "reserve", "debit").mapInArrow(fold, "trial_id long, admitted long, refused long, remaining long")


def ledger_totals(scores: DataFrame) -> DataFrame:
    """Per project: debits, known cost, calls without a reported cost and calls never billed, in micro-dollars."""
    d = distinct_scores(scores)
    unbilled = F.coalesce(F.col("error_type").isin(*UNBILLED), F.lit(False))
    cost = micro(F.col("cost_usd"))
    return d.groupBy("project_id").agg(
        F.sum(F.when(unbilled, 0).otherwise(F.coalesce(cost, F.lit(int(CONSERVATIVE_USD * MICRO))))).cast("long").alias("debit"), F.coalesce(F.sum(F.when(~unbilled, cost)), F.lit(0)).cast("long").alias("known_cost"),
        F.count_if(F.col("cost_usd").isNull()).alias("unreported_calls"), F.count_if(unbilled).alias("unbilled_calls"), F.count_distinct(F.when(unbilled, F.col("error_type"))).alias("refused_types"),
    )


def overspent_trials(trials: DataFrame) -> DataFrame:
    return trials.where("spent_usd > budget_usd").select("trial_id", "project_id", F.round(F.col("spent_usd") - F.col("budget_usd"), 4).alias("over"))


def worst_case_requests(calls: DataFrame) -> DataFrame:
    """Billable requests that a call may leave behind, from asked and library-wide retries, client retries and fallbacks."""
    up = lambda c: F.ceil(c).cast("long")
    asked, library = F.col("num_retries"), F.coalesce(F.col("library_retries"), F.lit(0.0))
    counted = F.when(F.coalesce(asked, F.lit(0.0)) != 0, asked).otherwise(library)
    loop = F.when(counted != 0, F.greatest(F.lit(1).cast("long"), up(counted))).otherwise(0)
    client = F.greatest(F.lit(0).cast("long"), up(F.coalesce(asked, "max_retries", F.lit(0.0))))
    legs = F.lit(1) + F.coalesce("fallbacks", F.lit(0))
    extra = F.when((legs > 1) & (F.coalesce(asked, F.lit(0.0)) != 0), F.greatest(F.lit(1).cast("long"), up(asked))).otherwise(0)
    return calls.withColumn("worst_case", (F.lit(1) + loop + client + extra) * legs)


def readiness(pillars: DataFrame, caps: DataFrame, asks: DataFrame | None = None) -> DataFrame:
    """Overall score, band and action of each project.

    ``pillars``: project_id, dataset, evaluation, agent in 0..100, null where unmeasured (then left out of the weights); a pillar named in an optional
    column ``withheld`` (array<string>) was asked for and not given: it keeps its weight and earns nothing.
    ``caps``: project_id, condition, ceiling, blocks, asks. The lowest ceiling bounds the weighted score; the action is the condition of
    the lowest blocking cap, else of the lowest asking one, else what else is asked, else ``proceed``.
    ``asks``: project_id, action (may be null): reasons beside the caps, as thin evidence or unread answers, that hold the top two bands at WORKABLE.
    """
    from sieveline.functions.vocabulary import BANDS, PILLAR_WEIGHTS

    kept = F.col("withheld") if "withheld" in pillars.columns else F.array().cast("array<string>")
    withheld = lambda p: F.coalesce(F.array_contains(kept, p), F.lit(False))
    weight = sum((F.when(F.col(p).isNotNull() | withheld(p), w).otherwise(0) for p, w in PILLAR_WEIGHTS.items()), F.lit(0))
    total = sum((F.when(withheld(p), 0).otherwise(F.coalesce(F.col(p) * w, F.lit(0))) for p, w in PILLAR_WEIGHTS.items()), F.lit(0))
    c = caps.groupBy("project_id").agg(F.min("ceiling").alias("ceiling"), F.min(F.when(F.col("blocks"), F.struct("ceiling", "condition"))).alias("b"), F.min(F.when(F.col("asks"), F.struct("ceiling", "condition"))).alias("a"))
    held = (asks if asks is not None else caps.select("project_id", F.lit(None).cast("string").alias("action")).limit(0)).groupBy("project_id").agg(F.lit(True).alias("held"), F.min("action").alias("action"))
    overall = F.least(F.floor(total / F.when(weight > 0, weight)), F.coalesce("ceiling", F.lit(100))).cast("long")
    j = pillars.join(c, "project_id", "left").join(held, "project_id", "left").withColumn("overall", overall)
    band = None
    for low, name in BANDS:
        band = F.when(F.col("overall") >= low, name) if band is None else band.when(F.col("overall") >= low, name)
    shown = F.when(F.coalesce("held", F.lit(False)) & band.isin("EXCELLENT", "STRONG"), "WORKABLE").otherwise(band)
    return j.select("project_id", "overall", shown.alias("band"), F.when(F.col("b").isNotNull(), "BLOCKED").otherwise("OK").alias("status"), F.coalesce("b.condition", "a.condition", "action", F.lit("proceed")).alias("recommended_action"))


def wilson(trials: DataFrame, passing: float = 0.5, z: float = 1.96) -> DataFrame:
    """Wilson interval of each trial's share of passing rows."""
    g = distinct_scores(trials).where(valid_score()).groupBy("project_id", "trial_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= passing).alias("k"))
    p, n, zz = F.col("k") / F.col("n"), F.col("n"), z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return g.select("project_id", "trial_id", "n", "k", F.round(mid - half, 6).alias("low"), F.round(mid + half, 6).alias("high"))


def mcnemar(trials: DataFrame, scores: DataFrame, passing: float = 0.5) -> DataFrame:
    """Per project, the best trial against its first one over rows that both scored: discordant counts and the corrected statistic."""
    best = best_config(trials, scores).select("project_id", F.col("trial_id").alias("best"))
    first = trials.groupBy("project_id").agg(F.min("trial_id").alias("first"))
    per = distinct_scores(scores).where(valid_score()).groupBy("project_id", "trial_id", "row_id").agg(F.max(F.col("score") >= passing).alias("ok"))
    a = per.join(best, "project_id").where("trial_id = best").select("project_id", "row_id", F.col("ok").alias("a"))
    b = per.join(first, "project_id").where("trial_id = first").select("project_id", "row_id", F.col("ok").alias("b"))
    g = a.join(b, ["project_id", "row_id"]).groupBy("project_id").agg(F.count("*").alias("paired"), F.count_if(F.col("a") & ~F.col("b")).alias("gained"), F.count_if(~F.col("a") & F.col("b")).alias("lost"))
    gap = F.greatest(F.lit(0), F.abs(F.col("gained") - F.col("lost")) - 1)
    return g.withColumn("statistic", F.round(F.when(F.col("gained") + F.col("lost") > 0, gap * gap / (F.col("gained") + F.col("lost"))), 6))


def normalized_entropy(rows: DataFrame) -> DataFrame:
    """Entropy of the difficulty tags of each project over its maximum; null with fewer than two tags."""
    g = rows.where("difficulty IS NOT NULL").groupBy("project_id", "difficulty").agg(F.count("*").alias("c"))
    t = g.groupBy("project_id").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return t.select("project_id", "k", F.round(F.when(F.col("k") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("k")), 6).alias("entropy"))
