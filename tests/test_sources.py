import hashlib

import pytest
from pyspark.sql import functions as F

from sieveline.functions import scalar, sqlsig
from sieveline.operators import disclosure
from sieveline.plans import surface_plans
from sieveline.session import table
from sieveline.sources import jsonl, sinks
from tests.helpers import DATA


def test_permissive_scan(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": {"b": 1}, "id": null}\n\n[1]\n{"a"\n  \n{"a": {"b": null}}\n"x"\n', encoding="utf-8")
    s = jsonl.scan(spark, str(p))
    assert [(r.line_no, r.error) for r in s.orderBy("line_no").collect()] == [(1, None), (3, "row is not an object"), (4, "invalid JSON"), (6, None), (7, "row is not an object")]
    assert sorted(tuple(r)[:3] for r in jsonl.error_summary(s).collect()) == [("invalid JSON", 1, 4), ("row is not an object", 2, 3)]
    r = F.col("row")
    got = s.where("error IS NULL").orderBy("line_no").select(jsonl.field(r, "a.b").alias("v"), jsonl.present(r, "a.b").alias("p"), jsonl.present(r, "a.c").alias("q"), jsonl.field(r, "a.").alias("e"), jsonl.present(r, "id").alias("i")).collect()
    assert [tuple(x) for x in got] == [("1", True, False, None, True), (None, True, False, None, False)]
    assert [r.id for r in jsonl.mapped(s, {"id": "id"}).orderBy("line_no").collect()] == ["line-1", "line-6"]
    with pytest.raises(Exception, match="row is not an object"):
        jsonl.strict(spark, str(p)).where("line_no = 3").collect()


def test_lines_of_many_blocks(spark, tmp_path):
    p = tmp_path / "b.jsonl"
    p.write_text("".join(f'{{"k": {i}}}\n' for i in range(1, 20_001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        s = jsonl.scan(spark, str(p)).select("line_no", jsonl.field(F.col("row"), "k", "long").alias("k"))
        assert s.where("line_no <> k").count() == 0 and s.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_sources(spark, tmp_path):
    (tmp_path / "env").write_text("# c\nA=1\nexport B='x y'\nC = z # note\nbad line\n")
    assert [(r.key, r.value) for r in jsonl.dotenv(spark, str(tmp_path / "env")).orderBy("line_no").collect()] == [("A", "1"), ("B", "x y"), ("C", "z")]
    (tmp_path / "req").write_text("Foo_Bar==1.2 ; x\nbaz>=1\n")
    assert [tuple(r) for r in jsonl.requirements(spark, str(tmp_path / "req")).collect()] == [("foo-bar", "1.2")]
    assert jsonl.fingerprints(spark, str(tmp_path / "req")).first().sha256 == hashlib.sha256((tmp_path / "req").read_bytes()).hexdigest()
    (tmp_path / "empty").write_text("")
    assert jsonl.scan(spark, str(tmp_path / "empty")).collect() == []
    assert jsonl.suggest(["question", "row_id", "label", "x"]) == {"input": ["question"], "expected": ["label"], "id": ["row_id"]}


def test_transfer_is_verified(spark, tmp_path):
    best = spark.createDataFrame([(1, "a=1", 0.5), (2, "a=2", 0.25)], "project_id int, config string, mean_score double")
    sinks.write_transfer(best, str(tmp_path / "t"))
    assert all(r.accepted for r in sinks.read_transfer(spark, str(tmp_path / "t")).collect())
    spark.read.json(str(tmp_path / "t")).withColumn("config", F.lit("a=9")).write.json(str(tmp_path / "u"))
    assert not any(r.accepted for r in sinks.read_transfer(spark, str(tmp_path / "u").replace("u", "u")).collect())
    assert sinks.as_table(best).first().line == "1 | a=1 | 0.5"


def test_scalars(spark):
    df = spark.createDataFrame([("https://u:p@Host.io:81/x?k=1",), (" eu-west-1 ",), ("http://h/y",)], "v string")
    assert [r[0] for r in df.select(scalar.route_display(F.col("v"))).collect()] == ["https://host.io:81", "eu-west-1", "http://h"]
    assert scalar.permuted("a  b\tc") == "c  b\ta" and scalar.permuted("a a") is None and scalar.permuted("x") is None and scalar.permuted("a b a") == "b a a"
    assert scalar._canonical('{"b": 1, "a": [true, null]}') == '{"a":[true,null],"b":1}' and scalar._canonical("NaN") is None


def test_signature_depth_and_totality():
    assert sqlsig.structural_signature("SELECT " + "(" * 60 + "1" + ")" * 60) is None
    assert sqlsig.structural_match(None, None) == 0.0 and sqlsig.structural_match(5, 5) == 0.0
    assert sqlsig.structural_match("SELECT a FROM (t)", "SELECT a FROM t") == 1.0
    assert sqlsig.structural_match("SELECT a FROM t UNION SELECT b FROM u INTERSECT SELECT c FROM v", "SELECT a FROM t UNION (SELECT b FROM u INTERSECT SELECT c FROM v)") == 0.0


def test_disclosure_reads_case_and_escapes(spark):
    hidden = ["trainee", "A TraineE.", "tr%61inee", "tr%2561inee", "\\u0074rainee", "\\U00000074rainee", "\\x74rainee", "\\u{74}rainee", "\\164rainee", "&#116;rainee", "&amp;#x74;rainee", "\\N{LATIN SMALL LETTER T}rainee", "\\74 rainee", "\\tra\\inee"]
    texts = [(i, t) for i, t in enumerate(hidden)] + [(50, None), (51, ""), (52, "train ee \\ud83d %"), (53, "%" + "25" * 9 + "74rainee")]
    digests = spark.createDataFrame([(hashlib.sha256(b"trainee").hexdigest(), 7)], "digest string, n_bytes int")
    got = {(r.k, r.digest is None) for r in disclosure.disclosed(spark.createDataFrame(texts, "k long, t string"), "k", "t", digests).collect()}
    assert got == {(i, False) for i in range(len(hidden))} | {(53, True)}


def test_whole_tables_of_the_sql_surface(spark, tmp_path):
    run = lambda name, d=DATA: surface_plans.QUERIES[name](spark, d)
    n = table(spark, DATA, "lineitem").count()
    assert run("sql_arithmetic_whole").count() == n
    r = table(spark, DATA, "lineitem").groupBy("l_quantity").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") != "R").alias("b"))
    assert run("sql_intersect_all_whole").count() == r.agg(F.sum(F.least("a", "b"))).first()[0]
    docs = table(spark, DATA, "documents").select("doc_id", F.when(F.col("doc_id") % 50 != 0, F.lit("en")).alias("lang"))
    docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000)).write.parquet(str(tmp_path / "documents.parquet"))
    got = run("sql_order_nulls_whole", str(tmp_path)).collect()
    assert len(got) == 2 * docs.count() > 100 and got[-1].lang is None and got[0].lang == "en"


def test_windows_are_never_broadcast(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a trainee"), (2, "none")], "k long, t string").write.parquet(str(tmp_path / "t"))
    digests = spark.createDataFrame([(hashlib.sha256(b"trainee").hexdigest(), 7)], "digest string, n_bytes int")
    for most, join in ((disclosure.BROADCAST_DIGESTS, "BuildRight"), (0, "SortMergeJoin")):
        monkeypatch.setattr(disclosure, "BROADCAST_DIGESTS", most)
        found = disclosure.disclosed(spark.read.parquet(str(tmp_path / "t")), "k", "t", digests)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert join in plan and "BuildLeft" not in plan
        assert [r.k for r in found.collect()] == [1]


def test_chains_of_any_depth(spark, tmp_path):
    links = [(i, i - 1 if i > 1 else None) for i in range(1, 251)] + [(300, 299), (310, 311), (311, 310), (320, 320), (250, 249), (400, None)]
    spark.createDataFrame(links, "load_id long, prev_load_id long").write.parquet(str(tmp_path / "loads.parquet"))
    got = sorted(map(tuple, surface_plans.QUERIES["sql_with_recursive"](spark, str(tmp_path)).collect()))
    assert got == sorted([(i, i - 1) for i in range(1, 251)] + [(250, 249), (400, 0)])
