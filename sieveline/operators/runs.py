"""Runs of configurations over rows, scorers and agents, reviews of rows, and what a report says first.

Inputs as in ``dataset`` and ``experiments``; further columns are ignored. A null output or expectation is scored as an error, not as zero; an empty table gives an
empty result. User functions run on Arrow batches and never end a job: what they raise becomes the row's error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import scalar
from sieveline.functions import text as X
from sieveline.functions import vocabulary as V
from sieveline.operators import dataset as D
from sieveline.operators import experiments as E

SCORED = "struct<score: double, error: string>"


def _scored(score: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), score.cast("double")).alias("score"), error.alias("error"))


def _missing(*columns: Column) -> Column:
    rule = F.lit(False)
    for c in columns:
        rule = rule | c.isNull()
    return F.when(rule, F.lit("missing"))


def normalized_exact(output: Column, expected: Column) -> Column:
    """1 if both have the same words in order, whatever their case and punctuation, else 0."""
    return _scored((X.identity(output) == X.identity(expected)).cast("double"), _missing(output, expected))


def numeric_tolerance(output: Column, expected: Column, tolerance: float = 1e-6) -> Column:
    """1 if two finite numbers differ by no more than the tolerance, else 0; what is no number is an error."""
    number = lambda c: X.strip(c).try_cast("double")
    a, b = number(output), number(expected)
    odd = F.when(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")) | (F.abs(b) == float("inf")), F.lit("not a number"))
    return _scored((F.abs(a - b) <= tolerance).cast("double"), F.coalesce(_missing(output, expected), odd))


def set_f1(output: Column, expected: Column) -> Column:
    """Harmonic mean of precision and recall of the distinct words; two empty sets agree."""
    a, b = F.array_distinct(X.words(output)), F.array_distinct(X.words(expected))
    both = F.size(a) + F.size(b)
    return _scored(F.when(both == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / F.when(both > 0, both)), _missing(output, expected))


def json_fields(output: Column, expected: Column) -> Column:
    """The share of the expected object's fields that the output has with an equal value; what is no object is an error. An empty object is met by any."""
    fields = lambda c: F.from_json(c, "map<string,string>")
    is_object = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    odd = F.when(~is_object(output) | ~is_object(expected), F.lit("not an object"))
    a, b = fields(output), fields(expected)
    met = F.size(F.filter(F.map_keys(b), lambda k: F.map_contains_key(a, k) & a[k].eqNullSafe(b[k])))
    return _scored(F.when(F.size(b) == 0, 1.0).otherwise(met / F.when(F.size(b) > 0, F.size(b))), F.coalesce(_missing(output, expected), odd))


def evaluator(method: Column, output: Column, expected: Column) -> Column:
    """The score by the evaluator method's name; a method that needs a judge or is unknown is an error."""
    none = F.struct(F.lit(None).cast("double").alias("score"), F.lit("no evaluator").alias("error"))
    return (
        F.when(method.isin("exact", "normalized-exact", "routing"), normalized_exact(output, expected))
        .when(method == "numeric-tolerance", numeric_tolerance(output, expected))
        .when(method == "set-f1", set_f1(output, expected))
        .when(method == "schema", json_fields(output, expected))
        .otherwise(none)
    )


def checked(value) -> tuple[float | None, str | None]:
    """A scorer's answer as a score: a finite number of 0..1 that is no truth value, else an error."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None, "score is not a number"
    if not math.isfinite(value) or not 0 <= value <= 1:
        return None, "score out of range"
    return float(value), None


def _called(df: DataFrame, wanted: tuple[str, ...], kind: str, run: Callable[..., tuple]) -> DataFrame:
    """``df`` with the columns ``value`` and ``error`` of a call per row, which sees the ``wanted`` columns and no others."""
    names = [c for c in df.columns if c not in ("value", "error")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], []]
            for given in zip(*(batch.column(c).to_pylist() for c in wanted)):
                try:
                    value, error = run(*given)
                except Exception as e:  # noqa: BLE001
                    value, error = None, type(e).__name__
                out[0].append(value)
                out[1].append(error)
            made = [pa.array(out[0], pa.float64() if kind == "double" else pa.string()), pa.array(out[1], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "value", "error"])

    kept = df.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(each, f"{fields}, value {kind}, error string")


def scored(replies: DataFrame, scorer: Callable, transform: Callable | None = None) -> DataFrame:
    """``replies`` (output, expected, input_data, metadata and others) with ``score`` and ``error`` of ``scorer(output=, expected=, input_data=, metadata=)``; ``transform`` changes a reply first."""

    def run(output, expected, input_data, metadata):
        if output is None:
            return None, "missing"
        return checked(scorer(output=transform(output) if transform else output, expected=expected, input_data=input_data, metadata=dict(metadata or ())))

    return _called(replies, ("output", "expected", "input_data", "metadata"), "double", run).withColumnRenamed("value", "score")


def answered(asked: DataFrame, agent: Callable) -> DataFrame:
    """``asked`` (id, input, metadata, config and others) with ``reply`` and ``error`` of ``agent(input=, metadata=, id=, config=)``.

    Expected outputs are withheld: the agent is called with these four columns alone, and the metadata's output fields are taken out.
    """

    def run(ident, given, metadata, config):
        shown = {k: v for k, v in dict(metadata or ()).items() if not k.startswith(("output", "expected"))}
        reply = agent(input=given, metadata=shown, id=ident, config=dict(config or ()))
        return (reply, None) if isinstance(reply, str) else (None, "reply is not a text")

    return _called(asked, ("id", "input", "metadata", "config"), "string", run).withColumnRenamed("value", "reply")


def config_rows(projects: DataFrame, rows: DataFrame) -> DataFrame:
    """(project_id, config, row_id, id, input, metadata): every configuration with every labelled row of its project's tuning side.

    The configurations of a project ride along as one array and are taken apart behind the join, so rows stay where they are.
    """
    grid = E.config_grid(projects).groupBy("project_id").agg(F.collect_list("config").alias("configs"))
    tuning = D.usable(rows).where(X.side(D.fallback("split")) == "tuning").select("project_id", "row_id", "id", "input", "metadata")
    return tuning.join(grid, "project_id").select("project_id", F.explode("configs").alias("config"), "row_id", "id", "input", "metadata")


PROBES = ("good", "equivalent_good", "partial", "bad")


def case_probes(cases: DataFrame, supplemental: DataFrame | None = None, most: int = 8) -> DataFrame:
    """(project_id, row_id, probe, score): the four probes of each case, and at most ``most`` supplemental ones (project_id, row_id, probe, score), by name."""
    four = cases.select("project_id", "row_id", F.explode(F.array(*(F.struct(F.lit(p).alias("probe"), F.col(p).alias("score")) for p in PROBES))).alias("x")).select("project_id", "row_id", "x.*")
    if supplemental is None:
        return four
    w = Window.partitionBy("project_id", "row_id").orderBy("probe")
    extra = supplemental.join(cases.select("project_id", "row_id"), ["project_id", "row_id"]).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most)
    return four.unionByName(extra.select("project_id", "row_id", "probe", "score"))


def permutation_distinguished(cases: DataFrame) -> DataFrame:
    """(project_id, row_id, distinguished): whether a reply with its tokens permuted, taken for the partial one, is scored as bad."""
    return cases.select("project_id", "row_id", (F.col("partial") <= V.THRESHOLDS["bad_maximum"]).alias("distinguished"))


def threshold_faults(t: dict[str, float]) -> list[str]:
    """What is wrong with calibration thresholds: each within 0..1, bad below good, and room for a partial score between them."""
    faults = [f"{k} is not within 0..1" for k, v in t.items() if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or not 0 <= v <= 1]
    if not faults:
        if t["bad_maximum"] >= t["good_minimum"]:
            faults.append("bad_maximum is not below good_minimum")
        elif t["good_minimum"] - t["bad_maximum"] <= 2 * t["separation_margin"]:
            faults.append("separation_margin leaves no room for a partial score")
    return faults


def outcome_classes(rows: DataFrame) -> DataFrame:
    """(project_id, classes): sorted union of the coverage classes that the rows declare."""
    c = D.first_non_empty(D.fallback("coverage"))
    return rows.select("project_id", c.alias("c")).where("c IS NOT NULL").groupBy("project_id", "c").agg(F.lit(1).alias("one")).groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("classes"))


def bridge_wiring(projects: DataFrame, trials: DataFrame) -> DataFrame:
    """Per knob, from the configurations that were run: not-searched, unobserved, visible (several of its values came through) or ignored."""
    knobs = projects.select("project_id", F.explode("knobs").alias("knob", "values")).select("project_id", "knob", F.size(F.array_distinct("values")).alias("searched"))
    seen = trials.select("project_id", F.explode("config").alias("knob", "value")).groupBy("project_id", "knob").agg(F.count_distinct("value").alias("came"))
    verdict = F.when(F.col("searched") < 2, "not-searched").when(F.coalesce("came", F.lit(0)) == 0, "unobserved").when(F.col("came") > 1, "visible").otherwise("ignored")
    return knobs.join(seen, ["project_id", "knob"], "left").select("project_id", "knob", verdict.alias("verdict"))


def scoreable(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, scoreable_rows): rows that a project's evaluator can score; a method without a reference needs no expected output."""
    free = projects.select("project_id", F.coalesce(F.col("evaluator_method").isin(*V.REFERENCE_FREE), F.lit(False)).alias("free"))
    n = rows.where("input IS NOT NULL").groupBy("project_id").agg(F.count("*").alias("every"), F.count_if(D.labelled()).alias("labelled"))
    return n.join(free, "project_id").select("project_id", F.when(F.col("free"), F.col("every")).otherwise(F.col("labelled")).alias("scoreable_rows"))


def tuning_rows(rows: DataFrame) -> DataFrame:
    """The rows of the tuning side; a split name outside the vocabulary fails the job, a row without a split is left out."""
    s = D.fallback("split")
    unknown = s.isNotNull() & (X.strip(s) != "") & X.side(s).isNull()
    return rows.where(F.when(unknown, F.raise_error(F.concat(F.lit("unknown split: "), s)).cast("boolean")).otherwise(X.side(s) == "tuning"))


def tuning_counts(rows: DataFrame) -> DataFrame:
    """(project_id, tuning_rows, unknown_rows, refused): what :func:`tuning_rows` would return or refuse."""
    s = D.fallback("split")
    unknown = s.isNotNull() & (X.strip(s) != "") & X.side(s).isNull()
    return rows.groupBy("project_id").agg(F.count_if(X.side(s) == "tuning").alias("tuning_rows"), F.count_if(unknown).alias("unknown_rows"), F.coalesce(F.some(unknown), F.lit(False)).alias("refused"))


def review_unmatched(reviews: DataFrame, rows: DataFrame) -> DataFrame:
    """(project_id, digest): reviewed rows that the scan has not published; a review is refused if there are any."""
    return reviews.select("project_id", "digest").distinct().join(D.id_digests(rows), ["project_id", "digest"], "left_anti")


def integrity(scanned: DataFrame, readable: Callable[[Column], Column]) -> DataFrame:
    """One row: candidate, invalid, malformed, unlabelled and unreadable rows of a permissive scan, ``readable`` telling of a labelled output whether it can be used.

    Malformed rows are those that are invalid for another reason than their label.
    """
    from sieveline.sources.jsonl import field

    output = field(F.col("row"), "output")
    malformed = F.col("error").isNotNull()
    unlabelled = ~malformed & ~F.coalesce(X.strip(output) != "", F.lit(False))
    unreadable = ~malformed & ~unlabelled & ~F.coalesce(readable(output), F.lit(False))
    return scanned.select(malformed.alias("m"), unlabelled.alias("u"), unreadable.alias("r")).agg(
        F.count("*").alias("candidate_rows"), F.count_if(F.col("m") | F.col("u") | F.col("r")).alias("invalid_rows"), F.count_if("m").alias("malformed_rows"), F.count_if("u").alias("unlabelled_rows"), F.count_if("r").alias("unreadable_rows")
    )


SEVERITY = ("PASS", "SKIP", "WARN", "FAIL")


def worst_verdicts(report: DataFrame) -> DataFrame:
    """(project_id, status, checks): of each dataset the worst verdict of its checks, and which checks have it."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status"))
    ranked = report.withColumn("_rank", rank)
    by = ranked.groupBy("project_id", "_rank", "status").agg(F.array_join(F.array_sort(F.collect_set("check")), ",").alias("checks"))
    return by.groupBy("project_id").agg(F.max_by(F.struct("status", "checks"), "_rank").alias("w")).select("project_id", "w.*")


def first_findings(found: DataFrame, by: str, order: str, most: int = 10) -> DataFrame:
    """The first ``most`` findings of each kind with the number of all of them; tasks pass on no more than these of a kind."""
    first = found.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("at") <= most)
    return first.join(found.groupBy(by).agg(F.count("*").alias("total")), by).select(by, order, "at", "total")


#: Where providers report what a call cost, first found first.
COST_PATHS = ("$.response_cost", "$._hidden_params.response_cost", "$.usage.cost", "$.usage.total_cost", "$.cost.total", "$.cost")


def provider_cost(response: Column) -> Column:
    """The first finite cost of at least 0 that a JSON response reports, else null."""
    v = F.try_parse_json(response)
    costs = [F.try_variant_get(v, p, "double") for p in COST_PATHS]
    return F.coalesce(*(F.when((c >= 0) & (c < float("inf")), c) for c in costs))


def sweep_admission(projects: DataFrame, rows: DataFrame, trials: DataFrame) -> DataFrame:
    """Per project: calls of the whole sweep, what they reserve, the budget of its trials in micro-dollars, and whether the sweep is admitted at once."""
    configs = E.search_space(projects).select("project_id", "configurations")
    n = D.usable(rows).where(X.side(D.fallback("split")) == "tuning").groupBy("project_id").agg(F.count("*").alias("n"))
    budget = trials.groupBy("project_id").agg(F.sum(E.micro(F.col("budget_usd"))).alias("budget"))
    j = configs.join(n, "project_id", "left").join(budget, "project_id", "left").withColumn("calls", F.col("configurations") * F.coalesce("n", F.lit(0)))
    reserve = F.col("calls") * int(E.CONSERVATIVE_USD * E.MICRO)
    return j.select("project_id", "calls", reserve.alias("reserve"), F.coalesce("budget", F.lit(0)).alias("budget"), (reserve <= F.coalesce("budget", F.lit(0))).alias("admitted"))


def repeated_answers(rows: DataFrame) -> DataFrame:
    """Rows whose normalised input repeats an earlier one of their dataset, their output scored against that of the first by each preferred evaluator."""
    base = D.usable(rows).select("project_id", "row_id", F.md5(X.identity(F.col("input"))).alias("identity"), "output")
    first = base.groupBy("project_id", "identity").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n")).where("n > 1")
    expected = base.join(first, ["project_id", "identity"]).where("row_id = first_row").select("project_id", "identity", "first_row", F.col("output").alias("expected"))
    j = base.join(expected, ["project_id", "identity"]).where("row_id <> first_row")
    o, e = F.col("output"), F.col("expected")
    return j.select("project_id", "row_id", "first_row", normalized_exact(o, e)["score"].alias("exact"), numeric_tolerance(o, e)["score"].alias("number"), F.round(set_f1(o, e)["score"], 9).alias("words"), json_fields(o, e)["score"].alias("fields"))


#: Rows of a first run by side and difficulty.
DRAWN = {"tuning": {"easy": 4, "medium": 5, "hard": 5, "very-hard": 4}, "heldout": {"easy": 2, "medium": 3, "hard": 3, "very-hard": 2}}


def row_draw(rows: DataFrame, seed: str = "draw-1") -> DataFrame:
    """(project_id, side, band, row_id): the rows of a first run, at most 18 of the tuning and 10 of the held-out side.

    Within a side and difficulty the groups of equal inputs are taken whole, by hash priority, as long as they fit the quota; a group that does not fit ends the draw of its
    stratum. A group's difficulty is that of its smallest row. Only as many groups as rows are asked for are ranked of any stratum.
    """
    from sieveline.operators.priority import priority

    side = X.side(D.fallback("split"))
    base = D.usable(rows).select("project_id", "row_id", side.alias("side"), D.difficulty_band().alias("band"), F.md5(X.identity(F.col("input"))).alias("identity")).where("side IS NOT NULL")
    groups = base.groupBy("project_id", "side", "identity").agg(F.min(F.struct("row_id", "band")).alias("f"), F.count("*").alias("n")).select("project_id", "side", "identity", "f.band", "n")
    quota = F.coalesce(*(F.when((F.col("side") == s) & (F.col("band") == b), n) for s, bands in DRAWN.items() for b, n in bands.items()))
    ranked = groups.withColumn("quota", quota).where("quota IS NOT NULL").withColumn("p", priority(seed, F.col("identity")))
    w = Window.partitionBy("project_id", "side", "band").orderBy("p", "identity")
    most = max(n for bands in DRAWN.values() for n in bands.values())
    near = ranked.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most)
    fits = near.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("upto <= quota").select("project_id", "side", "identity", "band")
    return base.drop("band").join(fits, ["project_id", "side", "identity"]).select("project_id", "side", "band", "row_id")


def digest_reviews(rows: DataFrame) -> DataFrame:
    """Reviews as a careless reviewer would name them: by the digest of the id in lower case."""
    return rows.where("id IS NOT NULL").select("project_id", scalar.digest16(F.lower(F.col("id"))).alias("digest"))
