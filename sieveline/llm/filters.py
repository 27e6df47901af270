"""A filter of fixed size that says of most keys outside a set that they are not in it, so that a join needs to move little.

One bit per hashed key, in slices that are built by aggregation on the executors and broadcast: at most MOST_BITS, 32 MB, whatever the
number of keys. A key of the set always passes; how many others do depends on how full the filter is, and a join behind it decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import cut

LEAST_BITS, MOST_BITS, SLICE_BITS, BITS_PER_KEY = 1 << 16, 1 << 28, 1 << 16, 32


class Bits:
    """The filter of a column ``key`` of ``keys``, which is read twice."""

    def __init__(self, keys: DataFrame, key: str):
        n = keys.count()
        self.bits = max(LEAST_BITS, min(MOST_BITS, 1 << (n * BITS_PER_KEY - 1).bit_length() if n else 0))
        at = keys.select(self._place(F.col(key)).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("x"))
        each = SLICE_BITS // 64
        sliced = words.groupBy(F.expr(f"w div {each}").alias("slice")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"CAST(w % {each} AS INT)"), "x"))).alias("m"))
        self.slices = cut(sliced.select(F.col("slice").alias("_slice"), F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("_words")))

    def _place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits).cast("long"))

    def marked(self, df: DataFrame, key: str, flag: str) -> DataFrame:
        """``df`` with a boolean: whether the key may be in the set; false for null."""
        place = self._place(F.col(key))
        joined = df.withColumn("_at", place).withColumn("_slice", F.expr(f"_at div {SLICE_BITS}")).join(F.broadcast(self.slices), "_slice", "left")
        word = F.coalesce(F.get("_words", F.expr(f"CAST((_at % {SLICE_BITS}) div 64 AS INT)")), F.lit(0).cast("long"))
        hit = F.col(key).isNotNull() & (F.getbit(word, F.expr("CAST(_at & 63 AS INT)")) == 1)
        return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_at", "_slice", "_words")
