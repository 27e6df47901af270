"""Column profile of loads and the changes between a load and the one before it.

Every load is compared with its predecessor in two ways. Exact aggregates count nulls, invalid and distinct
values. A classifier two-sample test trains logistic regressions that tell the two loads' rows apart: one over all columns, one without each
column (ablation) and one with each alone, every one fitted on one half of the rows and judged on the other (cross-fitting). A column is proposed as changed if
it discriminates by itself, or if leaving it out costs the full model, as much as the least change that counts would; the exact aggregates then decide.

Training is distributed gradient descent: rows are counted by bucket combination, each step is a join of these weighted rows with the coefficients
of their load and an aggregation of gradients and curvatures by load and coefficient, with partial sums in every task. All models of all loads
take their steps together. Nothing of it is on the driver, and a load of any size is spread like the others.

Nulls, values outside the vocabulary, empty tables, loads without rows and extra columns are handled: a load
without rows has no profile; a predecessor without rows gives no comparison; a column without valid values on
either side gives no ``shift``. ``pattern`` and ``distinct`` are exact rules about values of one load and their number, which no classifier sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import HELDOUT, TUNING
from sieveline.session import cut

COLUMNS = ("difficulty", "split", "source")
# The vocabulary of a difficulty and the form of a source.
DIFFICULTIES = ("easy", "medium", "hard", "very-hard")
SOURCE_FORM = r"\A[a-z]+(-[a-z0-9]+)*\z"

INVALID_PERCENT = 5
NULLS_PERCENT = 15
SHIFT_PERCENT = 25
#: Hash buckets of the classifier over all columns; bucket 0 is null.
BUCKETS = {"difficulty": 64, "split": 64, "source": 256}
#: Steps of the descent, the ridge, and the standard errors by which a discrimination may fall short by chance.
STEPS, RIDGE, ERRORS = 4, 1e-4, 3.0


def valid(column: Column, value: Column) -> Column:
    """Whether a non-null value of one of COLUMNS is written exactly as its vocabulary says."""
    return (
        F.when(column == "difficulty", value.isin(*DIFFICULTIES))
        .when(column == "split", value.isin(*TUNING, *HELDOUT))
        .otherwise(value.rlike(SOURCE_FORM))
    )


def value_counts(rows: DataFrame) -> DataFrame:
    """(load_id, column_name, value, n, ok): how often each value of COLUMNS occurs in each load."""
    pairs = ", ".join(f"'{c}', {c}" for c in COLUMNS)
    long = rows.select("load_id", F.expr(f"stack({len(COLUMNS)}, {pairs}) AS (column_name, value)"))
    return long.groupBy("load_id", "column_name", "value").agg(F.count("*").alias("n")).withColumn("ok", F.coalesce(valid(F.col("column_name"), F.col("value")), F.lit(False)))


def base(counts: DataFrame) -> DataFrame:
    """Exact aggregates of each load and column."""
    n, ok, some = F.col("n"), F.col("ok"), F.col("value").isNotNull()
    return counts.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~some, n)), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(some & ~ok, n)), F.lit(0)).alias("n_invalid"),
        F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("n_valid"),
        F.count(F.when(ok, 1)).alias("n_distinct"),
    )


def _pairs(loads: DataFrame) -> DataFrame:
    return loads.where(F.col("prev_load_id").isNotNull()).select("load_id", "prev_load_id").distinct()


def shifts(counts: DataFrame, stats: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_id, column_name, shift_rows): over valid values, the sum of ``|a B - b A|`` for counts a, b and totals A, B of a load and the one before it."""
    pairs = _pairs(loads)
    zero = F.lit(0).cast("long")
    valid_only = counts.where("ok")
    now = valid_only.join(pairs, "load_id").select("load_id", "column_name", "value", F.col("n").alias("a"), zero.alias("b"))
    old = valid_only.withColumnRenamed("load_id", "prev_load_id").join(pairs, "prev_load_id").select("load_id", "column_name", "value", zero.alias("a"), F.col("n").alias("b"))
    merged = now.unionByName(old).groupBy("load_id", "column_name", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    this = stats.select("load_id", "column_name", F.col("n_valid").alias("valid_a"))
    prev = pairs.join(stats.select(F.col("load_id").alias("prev_load_id"), "column_name", F.col("n_valid").alias("valid_b")), "prev_load_id").drop("prev_load_id")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    gap = F.abs(wide("a") * wide("valid_b") - wide("b") * wide("valid_a"))
    return merged.join(this, ["load_id", "column_name"]).join(prev, ["load_id", "column_name"]).groupBy("load_id", "column_name").agg(F.sum(gap).alias("shift_rows"))


#: The columns of each model: all, all but one, one.
MODELS = (tuple(COLUMNS), *(tuple(c for c in COLUMNS if c != left) for left in COLUMNS), *((c,) for c in COLUMNS))
_STARTS = {c: sum(BUCKETS[x] for x in COLUMNS[:k]) for k, c in enumerate(COLUMNS)}
_WIDTH = sum(BUCKETS.values())


def _place(model: int, fold: Column, column: str) -> Column:
    """Where the coefficient of a row's value stands among those of its load."""
    return (F.lit(model * 2) + fold) * _WIDTH + _STARTS[column] + F.col(column)


def _score(model: int, fold: Column) -> Column:
    return sum((F.get("theta", _place(model, fold, c)) for c in MODELS[model]), F.lit(0.0))


def cells(rows: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_id, label, fold, a bucket of each column, n, share): the rows of a load (label 1) and of the one before it (0), counted; both labels weigh alike."""
    bucket = lambda c: F.when(F.col(c).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(c), F.lit(BUCKETS[c] - 1))).cast("int").alias(c)
    counted = rows.select("load_id", F.pmod(F.xxhash64("row_id"), F.lit(2)).cast("int").alias("fold"), *map(bucket, COLUMNS)).groupBy("load_id", "fold", *COLUMNS).agg(F.count("*").alias("n"))
    pairs = _pairs(loads)
    now = counted.join(pairs.select("load_id"), "load_id").withColumn("label", F.lit(1))
    old = counted.withColumnRenamed("load_id", "prev_load_id").join(pairs, "prev_load_id").drop("prev_load_id").withColumn("label", F.lit(0))
    both = cut(now.unionByName(old))
    totals = both.groupBy("load_id", "label", "fold").agg(F.sum("n").alias("total"))
    return cut(both.join(totals, ["load_id", "label", "fold"]).withColumn("share", F.col("n") / F.col("total") / 2).drop("total"))


def train(cells: DataFrame) -> DataFrame:
    """(load_id, theta): the coefficients of all models of a load, those of either fold's rows."""
    theta = cut(cells.select("load_id").distinct().withColumn("theta", F.array_repeat(F.lit(0.0), len(MODELS) * 2 * _WIDTH)))
    # Of each column the models that have it; a row gives one gradient of all of them to the bucket of each of its values.
    having = [[m for m, cs in enumerate(MODELS) if c in cs] for c in COLUMNS]
    rank = [[ms.index(m) if m in ms else None for m in range(len(MODELS))] for ms in having]
    fold, many = F.col("fold"), range(len(having[0]))
    for _ in range(STEPS):
        at = cells.join(theta, "load_id").select("load_id", "label", "fold", "share", *COLUMNS, *((1 / (1 + F.exp(-_score(m, fold)))).alias(f"p{m}") for m in range(len(MODELS))))
        parts = at.select("load_id", "fold", "label", "share", F.explode(F.array(*(F.struct((F.lit(_STARTS[c]) + F.col(c)).alias("w"), *(F.col(f"p{m}").alias(f"q{k}") for k, m in enumerate(ms))) for c, ms in zip(COLUMNS, having)))).alias("x"))
        q = lambda k: F.col(f"x.q{k}")
        sums = parts.groupBy("load_id", (fold * _WIDTH + F.col("x.w")).alias("i")).agg(*(F.sum(F.col("share") * (F.col("label") - q(k))).alias(f"g{k}") for k in many), *(F.sum(F.col("share") * q(k) * (1 - q(k))).alias(f"h{k}") for k in many))
        # One coefficient array of fixed length for each load.
        steps = sums.groupBy("load_id").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(F.array(*(f"g{k}" for k in many)).alias("g"), F.array(*(f"h{k}" for k in many)).alias("h"))))).alias("m"))
        ranks = F.array(*(F.array(*(F.lit(r).cast("int") for r in rs)) for rs in rank))
        sizes = F.array(*(F.lit(float(len(cs))) for cs in MODELS))

        def moved(x: Column, i: Column) -> Column:
            model, w = F.floor(i / (2 * _WIDTH)).cast("int"), i % _WIDTH
            column = sum(((w >= _STARTS[c]).cast("int") for c in COLUMNS[1:]), F.lit(0))
            s, k = F.col("m")[i % (2 * _WIDTH)], F.get(F.get(ranks, column), model)
            step = (F.get(s["g"], k) - RIDGE * x) / ((F.get(s["h"], k) + RIDGE) * F.get(sizes, model))
            return F.coalesce(x + step, x)

        theta = cut(theta.join(steps, "load_id").select("load_id", F.transform("theta", moved).alias("theta")))
    return theta


def discrimination(rows: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_id, column_name, auc_full, auc_without, auc_alone): areas under the curve on the rows not trained on, mean of both folds, for loads with a predecessor.

    Ties count half; a fold that lacks one of the loads gives 0.5.
    """
    weighted = cells(rows, loads)
    other = 1 - F.col("fold")
    scored = weighted.join(train(weighted), "load_id").select("load_id", "fold", "label", "n", F.posexplode(F.array(*(F.round(_score(m, other), 9) for m in range(len(MODELS))))).alias("m", "score"))
    by = scored.groupBy("load_id", "fold", "m", "score").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    # Scores of a load and model are as many as its bucket combinations at most.
    below = F.coalesce(F.sum("b").over(Window.partitionBy("load_id", "fold", "m").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    areas = by.withColumn("won", F.col("a") * (below + F.col("b") / 2)).groupBy("load_id", "fold", "m").agg((F.sum("won") / F.nullif(F.sum("a").cast("double") * F.sum("b"), F.lit(0.0))).alias("auc"))
    mean = areas.groupBy("load_id", "m").agg((F.sum(F.coalesce("auc", F.lit(0.5)) - 0.5) / 2 + 0.5).alias("auc"))
    wide = mean.groupBy("load_id").agg(F.map_from_entries(F.collect_list(F.struct("m", "auc"))).alias("auc"))
    k, auc = len(COLUMNS), F.col("auc")
    named = F.array(*(F.struct(F.lit(c).alias("column_name"), auc[0].alias("auc_full"), auc[1 + i].alias("auc_without"), auc[1 + k + i].alias("auc_alone")) for i, c in enumerate(COLUMNS)))
    return wide.select("load_id", F.explode(named).alias("x")).select("load_id", "x.*")


def compare_loads(rows: DataFrame, loads: DataFrame) -> DataFrame:
    """Per load and column: exact aggregates, those of the load before (null without one) and the classifiers' measures."""
    counts = cut(value_counts(rows))
    stats = base(counts)
    links = loads.select("load_id", "prev_load_id").distinct()
    before = stats.select(F.col("load_id").alias("prev_load_id"), "column_name", *(F.col(c).alias(f"prev_{c}") for c in ("n_rows", "n_null", "n_valid", "n_distinct")))
    return (
        stats.join(links, "load_id")
        .join(before, ["prev_load_id", "column_name"], "left")
        .join(shifts(counts, stats, loads), ["load_id", "column_name"], "left")
        .join(discrimination(rows, loads), ["load_id", "column_name"], "left")
    )


def findings(report: DataFrame) -> DataFrame:
    """(load_id, column_name, finding) from :func:`compare_loads`.

    ``nulls`` and ``shift`` come from the columns that the classifiers propose. A null share that differs by d is a total variation of d, and the best
    discrimination of two loads that far apart is at least (1 + d) / 2; of a total variation d among valid values, with valid shares p and q, at least half of
    d times the lesser share is one of all values. A column is proposed if its own discrimination, or what the full model loses without it, is at least half as far above chance, give or take ERRORS
    standard errors of the area under the curve, so small loads are mostly proposed and large ones hardly without reason. The exact
    share is then compared in whole numbers. A column without a discrimination is not proposed.
    """
    c = F.col
    wide = lambda x: c(x).cast("decimal(19,0)")
    a, b = c("n_rows").cast("double"), c("prev_n_rows").cast("double")
    seen = F.greatest(c("auc_alone"), 0.5 + c("auc_full") - c("auc_without")) + ERRORS * F.sqrt((a + b + 1) / (12 * a * b))
    told = lambda effect: F.coalesce(seen >= 0.5 + effect / 4, F.lit(False))
    share = F.least(c("n_valid") / a, c("prev_n_valid") / b) / 2
    pattern = (c("n_rows") > c("n_null")) & (c("n_invalid") * 100 >= INVALID_PERCENT * (c("n_rows") - c("n_null")))
    nulls = told(F.lit(NULLS_PERCENT / 100)) & (F.abs(wide("n_null") * wide("prev_n_rows") - wide("prev_n_null") * wide("n_rows")) * 100 >= wide("n_rows") * wide("prev_n_rows") * NULLS_PERCENT)
    shift = told(share * (SHIFT_PERCENT / 100)) & (c("n_valid") > 0) & (c("prev_n_valid") > 0) & (c("shift_rows") * 50 >= wide("n_valid") * wide("prev_n_valid") * SHIFT_PERCENT)
    distinct = (c("n_distinct") > 2 * c("prev_n_distinct")) | (2 * c("n_distinct") < c("prev_n_distinct"))
    named = F.array(*(F.when(rule, F.lit(name)) for name, rule in (("pattern", pattern), ("nulls", nulls), ("shift", shift), ("distinct", distinct))))
    return report.select("load_id", "column_name", F.explode(F.array_compact(named)).alias("finding"))


def _kind(dtype: str) -> str:
    if dtype.startswith("timestamp"):
        return "time"
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "whole"
    return {"string": "text", "double": "real", "float": "real"}.get(dtype, "nested")


def profile(rows: DataFrame, key: str = "load_id") -> DataFrame:
    """One row per group and column: rows, nulls, distinct values and range.

    The range of a string is that of its length in characters, of a time that of its microseconds. Nested columns
    have nulls only. Distinct values are counted by a 64-bit hash after one aggregation over (group, column, hash).
    """
    kinds = {f.name: _kind(f.dataType.simpleString()) for f in rows.schema.fields if f.name != key}
    scalar = [c for c, k in kinds.items() if k != "nested"]
    number = {c: {"time": F.unix_micros(F.col(c).cast("timestamp")), "text": F.length(c), "whole": F.col(c), "real": F.col(c)}.get(k) for c, k in kinds.items()}
    flat = rows.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        *(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in kinds),
        *(F.min(number[c]).cast("double").alias(f"low_{c}") for c in scalar),
        *(F.max(number[c]).cast("double").alias(f"high_{c}") for c in scalar),
    )
    parts = ", ".join(f"'{c}', `nulls_{c}`, " + (f"`low_{c}`, `high_{c}`" if c in scalar else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)") for c in kinds)
    wide = flat.select(key, "n_rows", F.expr(f"stack({len(kinds)}, {parts}) AS (column_name, n_null, low, high)"))
    hashed = ", ".join(f"'{c}', IF(`{c}` IS NULL, NULL, xxhash64(`{c}`))" for c in scalar)
    seen = rows.select(key, F.expr(f"stack({len(scalar)}, {hashed}) AS (column_name, h)")).where("h IS NOT NULL").groupBy(key, "column_name", "h").agg(F.lit(1).alias("one"))
    distinct = seen.groupBy(key, "column_name").agg(F.count("*").alias("n_distinct"))
    return wide.join(distinct, [key, "column_name"], "left").select(key, "column_name", "n_rows", "n_null", F.when(F.col("column_name").isin(*scalar), F.coalesce("n_distinct", F.lit(0))).alias("n_distinct"), "low", "high")
