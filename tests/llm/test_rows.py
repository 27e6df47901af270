"""Operators over labelled rows against brute force, with nulls, empty tables, ties, copies and clashing columns."""

import collections
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.llm import filters, formatting, groups, ledger, overlap, quota, row_plans
from sieveline.session import cut_counted
from tests.helpers import DATA, clashing, rows, same_as_sql


@pytest.mark.parametrize("name", sorted(row_plans.SQL))
def test_same_as_sql(spark, name):
    same_as_sql(spark, row_plans.QUERIES[name], row_plans.SQL[name])


def test_overlap_against_all_pairs(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(rng.choice([2, 3, 8, 20, 40]))] for _ in range(60)]
    texts = []
    for w in base:
        for _ in range(3):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 2])):
                v[rng.randrange(len(v))] = "new"
            texts.append(" ".join(v).upper() if rng.random() < 0.3 else ", ".join(v))
    given = [{"input": t, "output": rng.choice([None, "", "same end"]), "split": rng.choice(["train", " TEST", None, "odd"])} for t in texts]
    given += [{"input": None, "output": None, "split": s} for s in ("train", "test")] + [{"input": "one copy of it", "output": "x", "split": s} for s in ("train", "test") for _ in range(30)]
    df = rows(spark, *given)
    runs, sides = {}, {}
    for i, g in enumerate(given, 1):
        w = re.findall(r"\w+", ((g["input"] or "") + " " + (g["output"] or "")).lower())
        runs[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        sides[i] = {"train": 0, "test": 1}.get((g["split"] or "").strip().lower())
    expected = {(a, b) for a in runs for b in runs if a < b and {sides[a], sides[b]} == {0, 1} and runs[a] and len(runs[a] & runs[b]) * 10 >= 7 * len(runs[a] | runs[b])}
    got = list(map(tuple, overlap.cross_split_pairs(df).collect()))
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 900
    assert set(map(tuple, overlap.cross_split_pairs(clashing(df)).collect())) == expected
    assert overlap.cross_split_pairs(df.limit(0)).collect() == []


def test_overlap_with_a_filter_that_lets_all_pass(spark, monkeypatch):
    given = [{"input": f"row {k} has these few words in it", "output": "and ends", "split": s} for k in range(5) for s in ("train", "test")]
    df = rows(spark, *given, *({"input": "a text that many rows have as it is", "output": "", "split": s} for s in ("train", "test", None) for _ in range(4)))
    pairs = lambda: sorted(map(tuple, overlap.cross_split_pairs(df).collect()))
    counts = lambda: sorted(map(tuple, overlap.overlap_counts(clashing(df)).collect()))
    expected, counted = pairs(), counts()
    assert len(expected) == 5 + 16 and counted == [("heldout", "test", None, 9, 21), ("tuning", "train", None, 9, 21)]
    monkeypatch.setattr(filters.Bits, "_place", lambda self, key: F.lit(0).cast("long"))
    assert pairs() == expected and counts() == counted


def test_filter_keeps_every_key(spark):
    keys = spark.range(0, 30_000, 7)
    bits = filters.Bits(keys, "id")
    marked = bits.marked(spark.range(60_000).union(spark.sql("SELECT CAST(NULL AS LONG)")), "id", "m").groupBy(F.expr("id % 7 = 0 AND id < 30000").alias("there"), "m").count()
    n = {(r.there, r.m): r["count"] for r in marked.collect()}
    assert n[True, True] == 4286 and (True, False) not in n and n.get((False, True), 0) < 0.06 * 60_000 and n[None, False] == 1


def test_ledger_is_stable_and_grows(spark, tmp_path):
    given = [{"id": rng_id} for rng_id in [f"w{k % 70}" for k in range(150)] + [None, "", " \t"] * 10]
    df = rows(spark, *given)
    a = ledger.extend(df.where("row_id <= 80"), str(tmp_path / "a"), 1)
    first = {r.key for r in a.collect()}
    keys = {ledger_key(g, i) for i, g in enumerate(given, 1)}
    assert len(first) == math.ceil(len({ledger_key(g, i) for i, g in enumerate(given, 1) if i <= 80}) * 0.1)
    b = ledger.extend(clashing(df.repartition(7)), str(tmp_path / "a"), 2)
    assert first <= {r.key for r in b.collect()} and b.count() == math.ceil(len(keys) * 0.1)
    again = ledger.extend(df, str(tmp_path / "a"), 3)
    assert again.count() == b.count()
    # Rerun under the same number, with any rows: each step gives what it gave.
    for step, kept in ((1, first), (2, {r.key for r in b.collect()}), (3, {r.key for r in again.collect()}), (1, first)):
        assert {r.key for r in ledger.extend(df if step == 1 else df.where("row_id > 90"), str(tmp_path / "a"), step).collect()} == kept
    with pytest.raises(ValueError):
        ledger.extend(df, str(tmp_path / "a"), 0)
    assert ledger.extend(df.where("row_id <= 80").repartition(5), str(tmp_path / "c"), 1).count() == len(first)
    assert ledger.extend(df.limit(0), str(tmp_path / "e"), 1).collect() == []
    chosen = {(r.row_id, r.step) for r in ledger.sample(df, b).collect()}
    assert {i for i, _ in chosen} == {i for i, g in enumerate(given, 1) if ledger_key(g, i) in {r.key for r in b.collect()}}


def test_ledger_after_a_write_that_broke_off(spark, tmp_path):
    df = rows(spark, *({"id": f"k{k}"} for k in range(40)))
    path = tmp_path / "l"
    (path / "_draft-1").mkdir(parents=True)
    (path / "_draft-1" / "part-0.parquet").write_bytes(b"broken")
    first = {r.key for r in ledger.extend(df, str(path), 1).collect()}
    assert len(first) == 4
    # Another run that puts the same step in place first wins.
    book = ledger.Ledger(spark, str(path))
    book.add(spark.createDataFrame([("id:other",)], "key string"), 1)
    assert {r.key for r in book.read(1).collect()} == first and not [p for p in path.iterdir() if p.name.startswith("_draft") and p.name != "_draft-1"]


def ledger_key(g, i):
    t = (g["id"] or "").strip()
    return f"id:{t}" if t else f"row:{i}"


def test_groups_against_union_find(spark):
    rng = random.Random(2)
    given = [{"id": f"x_w{k:08d}", "input": f"acct AB {k:06d} and cd-{k + 1:06d}", "split": "train" if k % 9 else "test"} for k in range(40)]  # one long chain
    given += [{"id": f"W{rng.randrange(100, 130):08d}/1", "input": rng.choice(["", f"A{rng.choice('bB')}{rng.randrange(500, 520):06d}."]), "split": rng.choice(["train", "test", None])} for _ in range(120)]
    given += [{"id": "w00000900", "input": f"ZZ_{k:06d}", "split": "tune"} for k in range(200)]  # one hub
    given += [{"id": None, "input": None, "split": "test"}, {"id": "w123456789", "input": "AB1234567 XAB123456", "split": "train"}]
    df = rows(spark, *given)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, g in enumerate(given, 1):
        keys = re.findall(r"(?<![^\W_])[wW](\d{8})(?!\d)", g["id"] or "") + [a.upper() + b for a, b in re.findall(r"(?<![^\W_])([A-Za-z]{2})[\W_]*(\d{6})(?![^\W_])", g["input"] or "")]
        for k in keys:
            parent[find(k)] = find(i)
    members = collections.defaultdict(list)
    for i in range(1, len(given) + 1):
        members[find(i)].append(i)
    side = lambda i: {"train": "t", "tune": "t", "test": "h"}.get(given[i - 1]["split"])
    expected = {(i, min(m)) for m in members.values() if {"t", "h"} <= set(map(side, m)) for i in m}
    assert set(map(tuple, groups.parted(df).collect())) == expected and expected
    assert set(map(tuple, groups.parted(clashing(df)).collect())) == expected
    dealt = groups.assign(df).collect()
    assert len(dealt) == len(given)
    of = {}
    for r in dealt:
        assert of.setdefault(r.group_id, r.assigned) == r.assigned
    assert {r.row_id: r.group_id for r in dealt} == {i: min(m) for m in members.values() for i in m}
    forest = groups.components(groups.keyed(df))[1].collect()
    nodes = {x for r in forest for x in (r.a, r.b)}
    trees = {find(k) for k in parent if not isinstance(k, int)}
    assert len(forest) <= len(nodes) - 1 and len({(r.a, r.b) for r in forest}) == len(forest) and trees
    assert groups.parted(df.limit(0)).collect() == [] and groups.assign(df.limit(0)).collect() == []


def test_contraction_of_many_rounds_takes_few_jobs(spark):
    """Chains in random order take several rounds; what each job leaves on the driver piles up."""
    order = random.Random(5)
    links = [(k, k + 1) for k in range(150)] + [(k, k + 1) for k in range(200, 230)] + [(k, k + 1) for k in range(300, 340, 2)]
    order.shuffle(links)
    keys = spark.createDataFrame([(i, "tuning" if i % 2 else "heldout", list(link)) for i, link in enumerate(links, 1)], "row_id long, side string, keys array<long>")
    sc = spark.sparkContext
    sc.setJobGroup("contraction", "")
    nodes, forest = groups.components(keys)
    jobs = len(sc.statusTracker().getJobIdsForGroup("contraction"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    whole = lambda k: 0 if k <= 150 else 200 if k <= 230 else k - k % 2
    members = collections.defaultdict(list)
    for i, (a, _) in enumerate(links, 1):
        members[whole(a)].append(i)
    got = nodes.select("node", "group_id", "n_rows").collect()
    assert {r.node: (r.group_id, r.n_rows) for r in got} == {k: (min(members[whole(k)]), len(members[whole(k)])) for link in links for k in link} and len(got) == 151 + 31 + 40
    assert sorted((r.a, r.b, r.w) for r in forest.collect()) == sorted((a, b, i) for i, (a, b) in enumerate(links, 1))
    assert jobs <= 100


def test_rows_are_counted_as_they_are_cut(spark):
    odd = spark.range(20).where("id % 2 = 1")
    for df, condition, n in ((odd, "id > 10", 5), (odd, "id > 99", 0), (odd.where("id < 0"), "true", 0), (odd.groupBy("id").count(), "count = 1", 10), (spark.range(0).join(odd.hint("merge"), "id"), "true", 0), (odd.select(F.lit(None).cast("boolean").alias("b")), "b", 0)):
        kept, met = cut_counted(df, condition)
        assert met == n and kept.columns == df.columns and sorted(kept.collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="x"):
        cut_counted(odd.select(F.raise_error(F.lit("x")).alias("x")), "true")


def test_groups_meet_the_proportions(spark):
    df = rows(spark, *({"id": f"w{k:08d}", "input": ""} for k in range(2000)))
    n = collections.Counter(r.assigned for r in groups.assign(df).collect())
    assert abs(n["train"] - 1600) <= 10 and abs(n["test"] - 200) <= 10 and abs(n["validation"] - 200) <= 10


def test_quota_draws_what_is_feasible(spark):
    given = [{"split": "train", "difficulty": d} for d in ["easy"] * 50 + ["very_hard", " Very-Hard "] * 2 + [None] * 6] + [{"split": "test", "coverage": "a"}] * 5
    targets = spark.createDataFrame([(1, "tuning", "difficulty", "easy", 50, 5, 40), (2, "tuning", "difficulty", "very-hard", 50, 3, 40), (3, "heldout", "coverage", "a", 10, 4, 50), (4, "heldout", "coverage", "none", 0, 0, 50)], "target_id long, side string, category_field string, category string, share_pct int, min_rows int, sample_pct int")
    df = rows(spark, *given)
    got = {r.target_id: (r.pool_rows, r.n, r.needed, r.available, r.taken, r.exhausted) for r in quota.report(quota.counts(quota.reservoirs(df, targets)), targets).collect()}
    assert got == {1: (60, 24, 12, 50, 12, False), 2: (60, 24, 12, 4, 4, True), 3: (5, 2, 4, 5, 4, False), 4: (5, 2, 0, 0, 0, False)}
    drawn = collections.Counter(r.target_id for r in quota.draw(clashing(df), targets).collect())
    assert drawn == {1: 12, 2: 4, 3: 4}
    assert sorted(map(tuple, quota.draw(df.repartition(6), targets).collect())) == sorted(map(tuple, quota.draw(df, targets).collect()))
    assert [r.available for r in quota.report(quota.counts(quota.reservoirs(df.limit(0), targets)), targets).collect()] == [0] * 4
    assert quota.draw(df.limit(0), targets).collect() == []


@pytest.mark.parametrize("together", [False, True])
def test_reservoirs_are_trimmed_and_stay_exact(spark, together):
    """Also where all rows of a category come together in one task, whose reservoir then has dropped too many."""
    from sieveline.operators.priority import priority

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 200)
    given = [{"split": "train", "difficulty": "hard"}] * 3000 + [{"split": "train", "difficulty": "easy"}] * 27000
    df = rows(spark, *given)
    df = df.coalesce(1) if together else df.repartition(5)
    targets = spark.createDataFrame([(1, "tuning", "difficulty", "hard", 40, 0, 10), (2, "tuning", "difficulty", "easy", 60, 5, 10)], "target_id long, side string, category_field string, category string, share_pct int, min_rows int, sample_pct int")
    kept = quota.reservoirs(df, targets).where("row_id IS NOT NULL").groupBy("category").count().collect()
    n = {r.category: r["count"] for r in kept}
    assert n["easy"] < 0.4 * 27000 and n["hard"] < 1200
    got = sorted(map(tuple, quota.draw(df, targets).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = [r.row_id for r in df.select("row_id").orderBy(priority(quota.SEED, F.col("row_id")), "row_id").collect()]
    hard = {i for i, g in enumerate(given, 1) if g["difficulty"] == "hard"}
    assert got == sorted([(1, i) for i in [i for i in order if i in hard][:1200]] + [(2, i) for i in [i for i in order if i not in hard][:1800]])


def test_formatting_against_brute_force(spark):
    obj = {"a": 1.25, "B": {"x": [1, "Two!"], "y": None}, "c": True}
    swapped = '{ "c":true,"B":{"y":null,"x":[ 1,"two"]}, "a":1.25}'
    given = [("Hello, World", "x"), ("hello world!", "X "), ("hello  wörld", "x"), (json.dumps(obj), "y"), (swapped, "Y"), (swapped.replace('1,"two"', '"two",1'), "y"), (swapped.replace("1.25", "1.250"), "y"), (swapped[:-1], "y"), (swapped[1:-1], "y")]
    given += [(None, None), ("", " "), ("-", "{}"), ("İx", "straße"), ("ix", "STRASSE"), ("[1]", "1"), ("1", "[1]"), ('{"a":1}', "a1"), ("a1", '{"a":1}'), ("a" * 100_000, "q"), ("A" * 100_000, "q?"), ('{"k": {"a": 1}}', "z"), ("\n {\"k\":{\"a\":1}}", "z.")]

    def norm(t):
        t = t or ""
        try:
            o = json.loads(t, parse_int=str, parse_float=str)
            if isinstance(o, dict):
                return repr(canon(o))
        except ValueError:
            pass
        return "".join(c for c in t.lower() if c.isalnum())

    def canon(o):
        if isinstance(o, dict):
            return ("o", sorted((k, canon(v)) for k, v in o.items()))
        if isinstance(o, list):
            return ["l", *map(canon, o)]
        return "".join(c for c in {True: "true", None: "null"}.get(o, str(o)).lower() if c.isalnum())

    same = collections.defaultdict(list)
    for i, (a, b) in enumerate(given, 1):
        same[norm(a), norm(b)].append(i)
    expected = {(m[0], x) for m in same.values() for x in m[1:]}
    df = rows(spark, *({"input": a, "output": b} for a, b in given))
    assert set(map(tuple, formatting.copies(df).collect())) == expected and {(1, 2), (4, 5)} <= expected
    assert set(map(tuple, formatting.copies(clashing(df)).collect())) == expected
    assert {r.row_id: r.copies for r in formatting.collapsed(df).collect()} == {m[0]: len(m) for m in same.values()}
    assert formatting.copies(df.limit(0)).collect() == []


def test_digest_ignores_the_order_of_fields_only():
    a, b, c = (formatting.parsed(t) for t in ('{"a": 1, "b": {"c": 2, "d": 3}}', '{"b": {"d": 3, "c": 2}, "a": 1}', '{"b": {"d": 2, "c": 3}, "a": 1}'))
    assert formatting.digest(a) == formatting.digest(b) != formatting.digest(c)
    deep = "{\"a\":" * 3000 + "1" + "}" * 3000
    assert formatting.form(formatting.parsed(deep))[0] in "ot"


def test_leaves_have_the_same_digest_in_both_engines(spark):
    df = rows(spark, {"input": "Hello, World", "output": "Ünï 1"}, {"input": "{no object, hello world", "output": "ünï1"}, {"input": "hello world", "output": "ünï1"})
    roots = [bytes(r.root) for r in formatting.digested(df).orderBy("row_id").collect()]
    assert roots[0] == roots[2] != roots[1]
    import hashlib

    assert roots[0] == hashlib.md5(formatting.digest("helloworld") + formatting.digest("ünï1")).digest()


def test_digests_that_clash_are_told_apart(spark, monkeypatch):
    given = [("a", "b"), ("c", "d"), ("A!", "b"), ("e", "f")]
    df = rows(spark, *({"input": a, "output": b} for a, b in given))
    monkeypatch.setattr(formatting, "digested", lambda r: r.select("row_id", F.when(F.col("row_id") < 4, F.lit(b"x")).otherwise(F.lit(b"y")).alias("root")))
    assert [tuple(r) for r in formatting.copies(df).collect()] == [(1, 3)]


@pytest.mark.parametrize("name", ["p2_counts", "p5_found", "p5_splits", "p5_forest", "p7_found", "p7_collapsed"])
def test_queries_run(spark, name):
    row_plans.QUERIES[name](spark, DATA).collect()
