"""Validation of run logs: closed vocabularies, time stamps, what a detail may not carry, and the open-cleared rule.

Input: log_id, trial_id, ts, event_name, stage, event_class, state, detail. Repeated lines count once; each null field is a violation of
its own rule. An empty log has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import vocabulary as V

#: What a detail may not carry, and how it is told.
CARRIERS = (
    ("path", r"(?:^|[\s\"'(=:,])(?:(?:/[\w.+@-]+){2,}|~/\w|[A-Za-z]:\\\w)"),
    ("credential", r"\b(?:(?:sk|pk|uk|gh[a-z]|github_pat|xox[a-z])[-_]|AKIA|eyJ)[\w-]{8,}"),
    ("email", r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"),
    ("identifier", r"(?i)(?<![0-9a-z])(?:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{16,}|(?=[a-z]*[0-9])[0-9a-z]{20,})(?![0-9a-z])"),
    ("url", r"(?i)\b[a-z][a-z0-9+.-]*://[^\s/]"),
    ("host", r"(?i)(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<![\w.-])(?:[a-z0-9-]+\.)+(?:com|net|org|io|ai|dev)(?![\w-])"),
    ("quotation", r"(?<![\p{L}\p{N}])([\"'])(?:(?!\1).){25,}\1(?![\p{L}\p{N}])|“[^”]{25,}”|‘[^’]{25,}’|«[^»]{25,}»"),
)
FIELDS = ("log_id", "trial_id", "ts", "event_name", "stage", "event_class", "state", "detail")


def lines(log: DataFrame) -> DataFrame:
    return log.select(*FIELDS).distinct()


def known_class() -> Column:
    rule = F.lit(False)
    for event, names in V.RUN_LOG_CLASSES.items():
        rule = rule | ((F.col("event_name") == event) & F.col("event_class").isin(*names))
    return F.coalesce(rule, F.lit(False))


def well_formed() -> Column:
    return known_class() & F.coalesce(F.col("stage").between(1, 8), F.lit(False)) & F.coalesce(F.col("state").isin(*V.RUN_LOG_STATES), F.lit(False))


def violations(log: DataFrame) -> DataFrame:
    """(log_id, rule): every rule that a line breaks on its own, but for leaks."""
    known_event = F.coalesce(F.col("event_name").isin(*V.RUN_LOG_CLASSES), F.lit(False))
    detail = F.coalesce(F.regexp_replace("detail", r"(?U)^\s+|\s+$", ""), F.lit(""))
    rules = (
        ("ts", ~F.coalesce(F.col("ts").rlike(r"\A[0-9]{8}T[0-9]{6}Z\z"), F.lit(False))),
        ("event", ~known_event),
        ("stage", ~F.coalesce(F.col("stage").between(1, 8), F.lit(False))),
        ("class", known_event & ~known_class()),
        ("state", ~F.coalesce(F.col("state").isin(*V.RUN_LOG_STATES), F.lit(False))),
        ("detail-empty", detail == ""),
        ("detail-long", (detail != "") & (F.length("detail") > V.RUN_LOG_DETAIL_LIMIT)),
    )
    return lines(log).select("log_id", F.explode(F.array_compact(F.array(*(F.when(r, F.lit(n)) for n, r in rules)))).alias("rule"))


def leaks(log: DataFrame) -> DataFrame:
    """(log_id, leak): what a detail of proper length carries and may not."""
    ok = F.length("detail") <= V.RUN_LOG_DETAIL_LIMIT
    found = F.array_compact(F.array(*(F.when(F.col("detail").rlike(p), F.lit(n)) for n, p in CARRIERS)))
    return lines(log).where(ok).select("log_id", F.explode(found).alias("leak"))


def state_rule(log: DataFrame) -> DataFrame:
    """(log_id): cleared lines whose identity's line before, in the same trial's log, is not open."""
    w = Window.partitionBy("trial_id", "event_name", "stage", "event_class").orderBy("log_id")
    last = lines(log).where(well_formed()).withColumn("before", F.lag("state").over(w))
    return last.where("state = 'cleared' AND coalesce(before, '') <> 'open'").select("log_id")


def summary(log: DataFrame) -> DataFrame:
    """Per trial: lines, lines that break a rule, and identities still open."""
    bad = violations(log).select("log_id").unionByName(state_rule(log)).unionByName(leaks(log).select("log_id")).distinct().withColumn("bad", F.lit(1))
    open_now = lines(log).where(well_formed()).groupBy("trial_id", "event_name", "stage", "event_class").agg(F.max_by("state", "log_id").alias("s")).groupBy("trial_id").agg(F.count_if(F.col("s") == "open").alias("standing"))
    return lines(log).join(bad, "log_id", "left").groupBy("trial_id").agg(F.count("*").alias("n_lines"), F.count("bad").alias("bad_lines")).join(open_now, "trial_id", "left").select("trial_id", "n_lines", "bad_lines", F.coalesce("standing", F.lit(0)).alias("standing"))
