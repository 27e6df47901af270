import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import priority as P


@pytest.fixture(scope="module")
def ranked(spark):
    rng = random.Random(6)
    given = [(k, "%032x" % (rng.getrandbits(128) if k % 3 else 5)) for k in range(300)]  # a third shares one priority
    return spark.createDataFrame(given, "id long, priority string"), [k for k, _ in sorted(given, key=lambda x: (x[1], x[0]))]


@pytest.mark.parametrize("k", [0, 1, 99, 100, 101, 250, 300, 1000])
def test_first_is_exact(ranked, k):
    df, order = ranked
    assert sorted(r.id for r in P.first(df, k, "id").collect()) == sorted(order[:k])


def test_lowest_of_each_group(ranked, spark):
    df, order = ranked
    grouped = df.withColumn("g", F.col("id") % 4)
    quotas = spark.createDataFrame([(0, 10), (1, 0), (2, 500)], "g long, quota long")
    ends = P.boundaries(P.shard_counts(grouped, ["g"]), quotas, ["g"])
    got = {g: sorted(r.id for r in P.lowest(grouped, ends, ["g"], "id").where(F.col("g") == g).collect()) for g in range(4)}
    of = lambda g: [k for k in order if k % 4 == g]
    assert got == {0: sorted(of(0)[:10]), 1: [], 2: sorted(of(2)), 3: []}


def test_empty(spark):
    assert P.first(spark.createDataFrame([], "id long, priority string"), 5, "id").collect() == []
