"""Checks of labelled datasets. Every function is one lazy plan over all datasets at once, keyed by ``project_id``.

Input: rows with project_id, row_id, line_no, id, input, output, split, difficulty, coverage, source, output_source and
metadata; further columns are ignored. A null column is an absent field, for which ``metadata`` is asked. Rows with a null
project form a dataset of their own where grouping keeps it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import text as X
from sieveline.functions import vocabulary as V
from sieveline.session import cut, ship, written

KEY = "project_id"
#: Bits of a run's hash that its count goes by, 16 MB at most; and those that are counted together.
COUNTED_BITS, SLICE_BITS = 24, 13
#: Classes whose keys may be broadcast; beyond it both sides are shuffled.
BROADCAST_CLASSES = 200_000


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def fallback(name: str) -> Column:
    """A field of the row, else of its metadata."""
    return F.coalesce(F.col(name), F.col("metadata")[name])


def provenance(row_side: bool = True) -> Column:
    """The declared origin of a row, or of its expected output."""
    a, b = ("provenance", "source") if row_side else ("output_provenance", "output_source")
    return first_non_empty(F.col("metadata")[a], F.col(b), F.col("metadata")[b])


def origin(word: Column) -> Column:
    """collected, synthesised or undeclared; synthesised is tested first."""
    w = X.strip(F.lower(word))
    starts = lambda names: F.lit(False) if not names else F.greatest(*(w.startswith(n) for n in names))
    return F.when(word.isNull() | (w == "") | w.isin(*V.UNDECLARED), "undeclared").when(starts(V.SYNTHESISED), "synthesised").when(starts(V.COLLECTED), "collected").otherwise("undeclared")


def recognised(word: Column) -> Column:
    w = X.strip(F.lower(word))
    return word.isNull() | (w == "") | w.isin(*V.UNDECLARED) | F.greatest(*(w.startswith(n) for n in (*V.SYNTHESISED, *V.COLLECTED)))


def labelled() -> Column:
    return F.coalesce(X.strip(F.col("output")) != "", F.lit(False))


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an input and a label."""
    return rows.where(F.col("input").isNotNull() & labelled())


def normalized_identity(rows: DataFrame) -> DataFrame:
    return rows.where("input IS NOT NULL").select("row_id", F.md5(X.identity(F.col("input"))).alias("identity"), F.size(X.words(F.col("input"))).alias("n_words"))


def token_stats(rows: DataFrame) -> DataFrame:
    """Words, distinct words and near-duplicate index size (runs) of each dataset's usable inputs."""
    w = usable(rows).select(KEY, X.words(F.col("input")).alias("w"))
    n = w.groupBy(KEY).agg(F.count("*").alias("n_rows"), F.sum(F.size("w")).cast("long").alias("n_words"), F.sum(F.when(F.size("w") == 0, 0).otherwise(F.greatest(F.lit(1), F.size("w") - 2))).cast("long").alias("n_runs"))
    vocabulary = w.select(KEY, F.explode("w").alias("x")).groupBy(KEY, "x").count().groupBy(KEY).agg(F.count("*").alias("n_distinct"))
    return n.join(vocabulary, KEY, "left").select(KEY, "n_rows", "n_words", "n_runs", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Groups of usable rows with one normalised input."""
    return usable(rows).groupBy(KEY, F.md5(X.identity(F.col("input"))).alias("identity")).agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row")).where("n_rows > 1")


def duplicate_summary(rows: DataFrame) -> DataFrame:
    g = usable(rows).groupBy(KEY, X.identity(F.col("input")).alias("i")).agg(F.count("*").alias("n"))
    return g.groupBy(KEY).agg(F.sum("n").alias("scoreable_rows"), F.count("*").alias("distinct_rows"), F.count_if(F.col("n") > 1).alias("groups"))


def similar_classes(rows: DataFrame) -> DataFrame:
    """(project_id, class_id, row_id): rows of one dataset whose inputs have the same words in order; the smallest row names the class."""
    keyed = usable(rows).select(KEY, "row_id", X.normal_text(F.col("input")).alias("t"))
    names = keyed.groupBy(KEY, F.md5("t").alias("m")).agg(F.min("row_id").alias("class_id"))
    return keyed.select(KEY, "row_id", F.md5("t").alias("m")).join(names, [KEY, "m"]).select(KEY, "class_id", "row_id")


def similar_pairs(rows: DataFrame, numerator: int = 7, denominator: int = 10, size: int = 3) -> DataFrame:
    """(project_id, class_a, class_b, shared, either): all pairs of classes with Jaccard of word runs of at least 7/10, exactly.

    Prefix filter: of a class with n runs the n - floor(7 n / 10) + 1 rarest ones are joined; two classes over the
    threshold share one of them, whatever the order of runs, as long as it is the same for all. Here it is by a table of
    counts of fixed size (then by run), so that runs need not be shuffled to learn how often they occur; a count may be too
    high, which costs candidates and no pair, and a count of one is right. Candidates whose parity bits differ in more places than
    so similar classes can differ in runs are dropped, the others are verified on their whole texts. Classes without words are
    equal, hence one class; a class of fewer words than a run has one run that no other class has.
    """
    ship(rows.sparkSession)
    keyed = usable(rows).select(KEY, "row_id", X.normal_text(F.col("input")).alias("t"))
    # Read three times below: written once to the shared folder. Texts take a third of the space of their runs.
    classes = written(keyed.where(F.col(KEY).isNotNull()).groupBy(KEY, "t").agg(F.min("row_id").alias("c")).where(F.size(F.split("t", " ")) >= size), "classes")
    # Words are hashed in a step of their own: within the one below it would be done again for every run.
    runs = classes.select(KEY, "c", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h")).select(KEY, "c", _runs(F.col("h"), size).alias("runs"))
    counts = rows.sparkSession.sparkContext.broadcast(_run_counts(runs, classes.agg(F.sum(F.size(F.split("t", " ")))).first()[0] or 0))
    prefix = runs.mapInArrow(_prefixes(counts, numerator, denominator), T.StructType([*runs.schema.fields[:2], *(T.StructField(n, T.LongType()) for n in ("r", "n", "low", "high"))]))
    a, b = prefix.alias("a"), prefix.alias("b")
    # Half of the sum of sizes less the differing runs are shared, and each differing bit is at least one such run.
    fits = F.expr(f"""a.c < b.c AND least(a.n, b.n) * {denominator} >= {numerator} * greatest(a.n, b.n)
      AND (bit_count(a.low ^ b.low) + bit_count(a.high ^ b.high)) * {denominator + numerator} <= (a.n + b.n) * {denominator - numerator}""")
    # The planner can't know how many runs a text has: nothing here is broadcast unless it was counted.
    joined = a.join(b.hint("merge"), (F.col(f"a.{KEY}") == F.col(f"b.{KEY}")) & (F.col("a.r") == F.col("b.r")) & fits)
    candidates = cut(joined.select(F.col("a.c").alias("x"), F.col("b.c").alias("y")).distinct())
    asked = candidates.select(F.explode(F.array("x", "y")).alias("c")).distinct()
    few = asked.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    texts = runs.join(asked.hint("broadcast" if few else "merge"), "c", "left_semi")
    of = lambda c: texts.select(F.col(KEY).alias(f"p{c}"), F.col("c").alias(c), F.col("runs").alias(f"runs_{c}")).hint("merge")
    common = candidates.join(of("x"), "x").join(of("y"), "y").where("px = py").withColumn("shared", F.size(F.array_intersect("runs_x", "runs_y")).cast("long"))
    return common.withColumn("either", F.size("runs_x") + F.size("runs_y") - F.col("shared")).where(f"shared * {denominator} >= {numerator} * either").select(F.col("px").alias(KEY), F.col("x").alias("class_a"), F.col("y").alias("class_b"), "shared", "either")


def _runs(words: Column, size: int) -> Column:
    """Distinct hashes of the runs of ``size`` hashed words of a list that has one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size)))))


def _run_counts(runs: DataFrame, n: int) -> np.ndarray:
    """How often runs occur, by their last bits: at most COUNTED_BITS of them, a byte each; from 128 on the byte grows with the logarithm.

    Runs of other datasets count along. Counts are added up in slices on the executors; the slices alone come to the driver, at most 16 MB.
    """
    bits = min(COUNTED_BITS, max(SLICE_BITS, (4 * n).bit_length()))
    mask, width = (1 << bits) - 1, 1 << SLICE_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, times = np.unique(batch.column(0).flatten().to_numpy() & mask, return_counts=True)
            slices, begin = np.unique(at >> SLICE_BITS, return_index=True)
            ends = [*begin[1:].tolist(), len(at)]
            parts = [((at[i:j] & (width - 1)).astype(np.uint16).tobytes(), times[i:j].astype(np.uint32).tobytes()) for i, j in zip(begin.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([p for p, _ in parts], pa.binary()), pa.array([t for _, t in parts], pa.binary())], names=["slice", "at", "times"])

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for at, times in zip(batch.column("at").to_pylist(), batch.column("times").to_pylist()):
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(times, np.uint32)
        codes = np.where(total < 128, total, np.minimum(255, 128 + 8 * np.log2(np.maximum(total, 128) / 128))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([codes.tobytes()], pa.binary())], names=["slice", "codes"])

    slices = runs.select("runs").mapInArrow(counted, "slice long, at binary, times binary").groupBy("slice").applyInArrow(added, "slice long, codes binary")
    out = np.zeros(mask + 1, np.uint8)
    for r in slices.collect():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["codes"], np.uint8)
    return out


def _prefixes(counts: Broadcast, numerator: int, denominator: int):
    """Of each class the rarest runs that others may have, with its number of runs and 128 parity bits of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            lists = batch.column(2)
            n = np.diff(lists.offsets.to_numpy())
            begin = np.cumsum(n) - n
            r, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            f = table[r & (len(table) - 1)]
            order = np.lexsort((r, f, row))
            at = np.arange(len(r)) - begin[row]
            kept = order[(at < (n - numerator * n // denominator + 1)[row]) & (f[order] > 1)]
            place = r >> 40 & 127
            bit = np.left_shift(np.int64(1), place & 63)
            low, high = (np.bitwise_xor.reduceat(np.where(place >> 6 == k, bit, 0), begin) if len(r) else r for k in (0, 1))
            own = row[kept]
            ids = batch.select([0, 1]).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*ids.columns, *(pa.array(x, pa.int64()) for x in (r[kept], n[own], low[own], high[own]))], names=[*ids.schema.names, "r", "n", "low", "high"])

    return run


def split_overlap(rows: DataFrame) -> DataFrame:
    """Normalised inputs on both sides of a dataset's split, with their rows."""
    s = X.side(fallback("split"))
    g = rows.where("input IS NOT NULL").groupBy(KEY, F.md5(X.identity(F.col("input"))).alias("identity")).agg(F.count_if(s == "tuning").alias("tuning_rows"), F.count_if(s == "heldout").alias("heldout_rows"))
    return g.where("tuning_rows > 0 AND heldout_rows > 0")


def split_sizes(rows: DataFrame) -> DataFrame:
    """Per side: rows, labelled rows, distinct inputs, distinct labelled inputs."""
    i = X.identity(F.col("input"))
    return rows.where("input IS NOT NULL").groupBy(KEY, F.coalesce(X.side(fallback("split")), F.lit("none")).alias("side")).agg(
        F.count("*").alias("n_rows"), F.count_if(labelled()).alias("labelled_rows"), F.count_distinct(i).alias("distinct_inputs"), F.count_distinct(F.when(labelled(), i)).alias("distinct_scoreable")
    )


def split_vocabulary(rows: DataFrame) -> DataFrame:
    """Split names outside the vocabulary."""
    s = fallback("split")
    return rows.where(s.isNotNull() & (s != "") & X.side(s).isNull()).groupBy(KEY, X.strip(F.lower(s)).alias("split_name")).agg(F.count("*").alias("n_rows"))


def holdout_resolution(rows: DataFrame) -> DataFrame:
    """What one held-out example is worth in points."""
    n = rows.where(X.side(fallback("split")) == "heldout").groupBy(KEY).agg(F.count("*").alias("holdout_rows"), F.count_if(labelled()).alias("labelled_rows"))
    return n.withColumn("points_each", F.round(100 / F.when(F.col("labelled_rows") > 0, F.col("labelled_rows")), 1))


def drawable(rows: DataFrame) -> DataFrame:
    """(project_id, identity, n_rows, scope): equal-input groups of the tuning side, or of the whole dataset where it has none."""
    s = X.side(fallback("split"))
    g = usable(rows).groupBy(KEY, F.md5("input").alias("identity")).agg(F.count_if(s == "tuning").alias("t"), F.count("*").alias("n"))
    has = g.groupBy(KEY).agg((F.max("t") > 0).alias("tuned"))
    scoped = g.join(has, KEY).withColumn("n_rows", F.when(F.col("tuned"), F.col("t")).otherwise(F.col("n")))
    return scoped.where("n_rows > 0").select(KEY, "identity", "n_rows", F.when(F.col("tuned"), "tuning").otherwise("dataset").alias("scope"))


def question_cap(rows: DataFrame, tuning_rows: int = 18) -> DataFrame:
    """How many whole groups fit into the first run, smallest first; and the fewest and most rows that so many groups have.

    Groups are counted by size first, so each dataset is a short list of sizes.
    """
    sizes = drawable(rows).groupBy(KEY, "scope", "n_rows").agg(F.count("*").alias("m"))
    w = Window.partitionBy(KEY, "scope").orderBy("n_rows").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("used", F.coalesce(F.sum(F.col("n_rows") * F.col("m")).over(w), F.lit(0)))
    fits = F.greatest(F.lit(0), F.least("m", F.floor((tuning_rows - F.col("used")) / F.col("n_rows"))))
    capped = before.groupBy(KEY, "scope").agg(F.sum(fits).cast("long").alias("questions"), F.sum("m").alias("distinct_questions"), F.sum(F.col("m") * F.col("n_rows")).alias("scoped_rows"))
    # The last group of a size that fits only in part ends the run of smaller ones.
    return capped.withColumn("questions", F.least("questions", F.lit(tuning_rows).cast("long")))


def row_bounds(rows: DataFrame) -> DataFrame:
    """Rows of the q smallest and the q largest groups, q the question cap."""
    sizes = drawable(rows).groupBy(KEY, "n_rows").agg(F.count("*").alias("m")).join(question_cap(rows).select(KEY, "questions"), KEY)

    def taken(order: Column) -> Column:
        w = Window.partitionBy(KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        done = F.coalesce(F.sum("m").over(w), F.lit(0))
        return F.greatest(F.lit(0), F.least(F.col("m"), F.col("questions") - done)) * F.col("n_rows")

    each = sizes.select(KEY, "questions", taken(F.col("n_rows").asc()).alias("lo"), taken(F.col("n_rows").desc()).alias("hi"))
    return each.groupBy(KEY, "questions").agg(F.sum("lo").alias("rows_fewest"), F.sum("hi").alias("rows_most"))


def family_offset(rows: DataFrame, percent: int = 90) -> DataFrame:
    """First word position whose commonest word opens fewer than 90 % of a dataset's distinct inputs, else 0."""
    distinct = _sided_inputs(rows).groupBy(KEY, "t", "side").count().select(KEY, F.split("t", " ").alias("w"))
    total = distinct.groupBy(KEY).agg(F.count("*").alias("n"))
    words = distinct.select(KEY, F.posexplode("w").alias("pos", "x")).where("x <> ''")
    modal = words.groupBy(KEY, "pos", "x").agg(F.count("*").alias("c")).groupBy(KEY, "pos").agg(F.max("c").alias("c"))
    first = modal.join(total, KEY).where(F.col("c") * 100 < percent * F.col("n")).groupBy(KEY).agg(F.min("pos").alias("offset"))
    return total.join(first, KEY, "left").select(KEY, F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def _sided_inputs(rows: DataFrame) -> DataFrame:
    s = X.side(fallback("split"))
    return rows.where(F.col("input").isNotNull() & s.isNotNull()).select(KEY, s.alias("side"), X.normal_text(F.col("input")).alias("t"))


def family_partition(rows: DataFrame, tokens: int = 2, least_rows: int = 2, coverage: int = 80) -> DataFrame:
    """Whether the split follows the leading words of the inputs: SKIP, PASS or WARN with families and shared families."""
    distinct = _sided_inputs(rows).groupBy(KEY, "side", "t").count().drop("count").join(family_offset(rows), KEY)
    signature = F.array_join(F.slice(F.split("t", " "), F.col("offset").cast("int") + 1, tokens), " ")
    signed = distinct.select(KEY, "side", signature.alias("s"))
    sides = signed.groupBy(KEY).agg(F.count_if(F.col("side") == "tuning").alias("nt"), F.count_if(F.col("side") == "heldout").alias("nh"))
    g = signed.where("s <> ''").groupBy(KEY, "s").agg(F.count_if(F.col("side") == "tuning").alias("t"), F.count_if(F.col("side") == "heldout").alias("h")).where(F.col("t") + F.col("h") >= least_rows)
    met = g.groupBy(KEY).agg(F.count("*").alias("families"), F.count_if((F.col("t") > 0) & (F.col("h") > 0)).alias("shared_families"), F.sum("t").alias("ct"), F.sum("h").alias("ch"))
    j = sides.join(met, KEY, "left").na.fill(0, ["families", "shared_families", "ct", "ch"])
    thin = (F.col("nt") == 0) | (F.col("nh") == 0) | (F.col("ct") * 100 < coverage * F.col("nt")) | (F.col("ch") * 100 < coverage * F.col("nh"))
    return j.select(KEY, F.when((F.col("families") == 0) | thin, "SKIP").when(F.col("shared_families") > 0, "PASS").otherwise("WARN").alias("status"), "families", "shared_families")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(X.strip(F.col("id")) != "", F.lit(False))).groupBy(KEY, "id").agg(F.count("*").alias("n_rows"), F.min("line_no").alias("first_line")).where("n_rows > 1")


def missing_ids(rows: DataFrame) -> DataFrame:
    missing = ~F.coalesce(X.strip(F.col("id")) != "", F.lit(False))
    made = origin(provenance()) == "synthesised"
    return rows.groupBy(KEY).agg(F.count("*").alias("n_rows"), F.count_if(missing).alias("rows_without_id"), F.count_if(missing & made).alias("generated_rows_without_id"))


def id_digests(rows: DataFrame) -> DataFrame:
    """Published digest of each row's id; a row without one is named by its line."""
    shown = F.when(F.coalesce(X.strip(F.col("id")) != "", F.lit(False)), F.col("id")).otherwise(F.concat(F.lit("line-"), F.col("line_no").cast("string")))
    return rows.select(KEY, F.substring(F.sha2(shown, 256), 1, 16).alias("digest")).distinct()


def provenance_counts(rows: DataFrame) -> DataFrame:
    o = origin(provenance())
    return rows.where("input IS NOT NULL").groupBy(KEY).agg(
        F.count("*").alias("n_rows"), F.count_if(labelled()).alias("labelled"), F.count_if(o == "collected").alias("collected"), F.count_if(o == "synthesised").alias("synthesised"), F.count_if(o == "undeclared").alias("undeclared"),
        F.count_if(labelled() & (origin(provenance(False)) == "synthesised")).alias("generated_answer"), F.round(F.count_if(o == "synthesised") / F.count("*"), 4).alias("synthesised_share"),
    )


def unrecognised_words(rows: DataFrame) -> DataFrame:
    p = provenance()
    return rows.where(F.col("input").isNotNull() & ~recognised(p)).groupBy(KEY, p.alias("word")).agg(F.count("*").alias("n_rows"))


def provenance_points(rows: DataFrame) -> DataFrame:
    """Average points of the rows' origin, and the ceiling of a strict majority."""
    c = provenance_counts(rows)
    made = F.col("collected") - F.col("answered")
    per = rows.where("input IS NOT NULL").groupBy(KEY).agg(F.count_if((origin(provenance()) == "collected") & labelled() & (origin(provenance(False)) == "synthesised")).alias("answered"))
    j = c.join(per, KEY)
    points = (made * 10 + F.col("answered") * 6 + F.col("synthesised") * 3 + F.col("undeclared") * 3) / F.col("n_rows")
    most = lambda x: F.col(x) * 2 > F.col("n_rows")
    ceiling = F.when(most("synthesised"), 65).when(most("undeclared"), 70).when((F.col("synthesised") + F.col("undeclared")) * 2 > F.col("n_rows"), 74).when(most("answered"), 74)
    return j.select(KEY, F.round(points, 4).alias("points"), ceiling.alias("ceiling"))


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(KEY).agg(F.count("*").alias("candidate_rows"), F.count_if(F.col("input").isNull()).alias("without_input"), F.count_if(~labelled()).alias("unlabelled_rows"), F.count_if(labelled() & F.col("input").isNotNull()).alias("scoreable_rows"))


def placeholder_outputs(rows: DataFrame) -> DataFrame:
    return usable(rows).groupBy(KEY).agg(F.count("*").alias("n_rows"), F.count_if(X.normal_text(F.col("output")) == "").alias("placeholder_rows"))


def dominance(counts: DataFrame) -> DataFrame:
    """Verdict on (key, value, n): a share of 9/10, too few rows to tell, an excess of 1/3 over chance; in whole numbers."""
    g = counts.groupBy(*[c for c in counts.columns if c not in ("value", "n")]).agg(F.sum("n").alias("n"), F.max("n").alias("m"), F.count("*").alias("k"))
    verdict = F.when(F.col("m") * 10 >= F.col("n") * 9, "WARN").when(F.col("n") < 2 * F.col("k"), "SKIP").when(3 * (F.col("m") * F.col("k") - F.col("n")) >= F.col("n") * (F.col("k") - 1), "WARN").otherwise("PASS")
    return g.withColumn("status", verdict)


def answer_dominance(rows: DataFrame) -> DataFrame:
    return dominance(usable(rows).groupBy(KEY, X.identity(F.col("output")).alias("value")).agg(F.count("*").alias("n")))


def distinct_outputs(rows: DataFrame) -> DataFrame:
    g = usable(rows).groupBy(KEY).agg(F.count("*").alias("n_rows"), F.count_distinct(X.identity(F.col("output"))).alias("k"))
    return g.withColumn("status", F.when(F.col("n_rows") == 0, "FAIL").when(F.col("n_rows") < 2, "SKIP").when(F.col("k") == 1, "WARN").otherwise("PASS"))


def outcome_fields(rows: DataFrame) -> DataFrame:
    """Per dataset the first common field that is a scalar in every output, and its dominance."""
    v = F.try_parse_json("output")
    got = usable(rows).select(KEY, *(F.try_variant_get(v, f"$.{f}", "string").alias(f) for f in V.OUTCOME_FIELDS))
    every = got.groupBy(KEY).agg(*(F.min(F.col(f).isNotNull()).alias(f) for f in V.OUTCOME_FIELDS))
    chosen = every.select(KEY, F.coalesce(*(F.when(F.col(f), F.lit(f)) for f in V.OUTCOME_FIELDS)).alias("field")).where("field IS NOT NULL")
    value = F.coalesce(*(F.when(F.col("field") == f, F.col(f)) for f in V.OUTCOME_FIELDS))
    return dominance(got.join(chosen, KEY).groupBy(KEY, "field", value.alias("value")).agg(F.count("*").alias("n")))


def input_types(rows: DataFrame) -> DataFrame:
    """Runtime types of the inputs; an input that parses as an object or array counts as one."""
    kind = F.when(F.col("input").rlike(r"^\s*[\{\[]"), F.schema_of_variant(F.try_parse_json("input")))
    name = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("string")
    return rows.where("input IS NOT NULL").groupBy(KEY, name.alias("kind")).agg(F.count("*").alias("n_rows"))


def difficulty_band() -> Column:
    return F.replace(F.lower(first_non_empty(fallback("difficulty"))), F.lit("_"), F.lit("-"))


def difficulty_coverage(rows: DataFrame) -> DataFrame:
    """Tagged rows, bands present and expected ones missing, and the verdict on difficulty."""
    base = usable(rows).withColumn("band", difficulty_band())
    synthetic = F.min(origin(provenance()) == "synthesised")
    g = base.groupBy(KEY).agg(F.count("*").alias("total_rows"), F.count("band").alias("tagged_rows"), *(F.count_if(F.col("band") == b).alias(b.replace("-", "_")) for b in V.DIFFICULTIES), F.count_distinct("band").alias("bands"), synthetic.alias("synthetic"))
    missing = F.lit(0)
    for b in V.DIFFICULTIES:
        missing = missing + (F.col(b.replace("-", "_")) == 0).cast("int")
    g = g.withColumn("missing_bands", missing.cast("long"))
    only_easy = (F.col("tagged_rows") > 0) & (F.col("easy") == F.col("tagged_rows"))
    none_hard = ~F.col("synthetic") & (F.col("tagged_rows") > 0) & (F.col("hard") == 0) & (F.col("very_hard") == 0)
    return g.select(KEY, "total_rows", "tagged_rows", "bands", "missing_bands", F.when(F.col("missing_bands") == 0, "PASS").otherwise("WARN").alias("coverage_status"), F.when(only_easy | none_hard, "WARN").when(F.col("missing_bands") == 0, "PASS").when(F.col("synthetic"), "WARN").otherwise("NONE").alias("difficulty_status"))


def scenario_coverage(rows: DataFrame) -> DataFrame:
    c = first_non_empty(fallback("coverage"))
    g = usable(rows).groupBy(KEY).agg(F.count_distinct(c).alias("scenarios"), F.min(origin(provenance()) == "synthesised").alias("synthetic"))
    return g.select(KEY, "scenarios", F.when(~F.col("synthetic"), "NONE").when(F.col("scenarios") < 4, "WARN").otherwise("PASS").alias("status"))


def size_gates(rows: DataFrame) -> DataFrame:
    g = usable(rows).groupBy(KEY).agg(F.count("*").alias("n_rows"), F.count_if(X.side(fallback("split")) == "tuning").alias("tuning_rows"))
    return g.select(KEY, "n_rows", "tuning_rows", F.when(F.col("n_rows") < 10, "WARN").otherwise("PASS").alias("size_status"), F.when(F.col("tuning_rows") < 10, "WARN").otherwise("PASS").alias("tuning_status"))


def check_report(rows: DataFrame) -> DataFrame:
    """One row per dataset and check: PASS, WARN, FAIL or SKIP with its main count."""
    row = lambda df, check, status, count: df.select(KEY, F.lit(check).alias("check"), status.alias("status"), count.cast("long").alias("count"))
    c = F.col
    when = lambda bad, status: F.when(bad, status).otherwise("PASS")
    parts = [
        row(label_counts(rows), "dataset-integrity", when(c("unlabelled_rows") > 0, "FAIL"), c("unlabelled_rows")),
        row(duplicate_summary(rows), "dataset-duplicates", when(c("groups") > 0, "WARN"), c("distinct_rows")),
        row(missing_ids(rows).join(duplicate_ids(rows).groupBy(KEY).agg(F.count("*").alias("d")), KEY, "left").na.fill(0, ["d"]), "dataset-ids", F.when(c("d") > 0, "FAIL").when(c("rows_without_id") > 0, "WARN").otherwise("PASS"), c("rows_without_id")),
        row(provenance_counts(rows), "dataset-provenance", when(c("synthesised") * 2 > c("n_rows"), "WARN"), c("synthesised")),
        row(distinct_outputs(rows), "dataset-outputs", c("status"), c("k")),
        row(answer_dominance(rows), "dataset-ceiling-risk", c("status"), c("m")),
        row(placeholder_outputs(rows), "dataset-output-placeholders", when(c("placeholder_rows") > 0, "WARN"), c("placeholder_rows")),
        row(label_counts(rows).select(KEY).join(split_overlap(rows).groupBy(KEY).agg(F.count("*").alias("n")), KEY, "left").na.fill(0, ["n"]), "dataset-split", when(c("n") > 0, "FAIL"), c("n")),
        row(family_partition(rows), "dataset-split-family", c("status"), c("families")),
        row(difficulty_coverage(rows), "dataset-difficulty-coverage", c("coverage_status"), c("tagged_rows")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicate_counts(rows: DataFrame) -> DataFrame:
    """(project_id, pairs): pairs of usable rows whose inputs are similar, equal ones included."""
    base = usable(rows)
    sizes = base.groupBy(KEY, X.normal_text(F.col("input")).alias("t")).agg(F.min("row_id").alias("c"), F.count("*").alias("m")).where("t <> ''").select(KEY, "c", "m")
    side = lambda x: sizes.select(F.col("c").alias(f"class_{x}"), F.col("m").alias(f"m_{x}"))
    across = similar_pairs(rows).join(side("a"), "class_a").join(side("b"), "class_b").select(KEY, F.expr("m_a * m_b").alias("pairs"))
    within = sizes.select(KEY, F.expr("m * (m - 1) div 2").alias("pairs"))
    return across.unionByName(within).unionByName(base.select(KEY, F.lit(0).cast("long").alias("pairs"))).groupBy(KEY).agg(F.sum("pairs").alias("pairs"))


def check_report_whole(rows: DataFrame) -> DataFrame:
    """``check_report`` with the other checks of the survey's catalogue.

    As there, size, both vocabularies, outcome field, difficulty and coverage have a row only where they say something, and shape passes only
    without invalid rows. The ceiling risk is the worse of the outputs' and the outcome field's.
    Every check ends in a few rows for a dataset, and is run by itself: one plan of all of them takes more memory than a driver may have.
    """
    row = lambda df, check, status, count: df.select(KEY, F.lit(check).alias("check"), status.alias("status"), count.cast("long").alias("count"))
    c = F.col
    when = lambda bad, status: F.when(bad, status).otherwise("PASS")
    sides, outcome = split_sizes(rows), outcome_fields(rows)
    risks = answer_dominance(rows).select(KEY, "status", "m").unionByName(outcome.select(KEY, "status", "m"))
    severity = F.when(c("status") == "WARN", 2).when(c("status") == "SKIP", 1).otherwise(0)
    words = lambda df: df.groupBy(KEY).agg(F.count("*").alias("words"))
    out = cut(check_report(rows).where(c("check") != "dataset-ceiling-risk"))
    for p in (
        row(risks.groupBy(KEY).agg(F.max(F.struct(severity.alias("v"), "m", "status")).alias("x")), "dataset-ceiling-risk", c("x.status"), c("x.m")),
        row(label_counts(rows).where("scoreable_rows = 0 OR (without_input = 0 AND unlabelled_rows = 0)"), "dataset-shape", when(c("scoreable_rows") == 0, "FAIL"), c("scoreable_rows")),
        row(size_gates(rows).where("size_status = 'WARN'"), "dataset-size", c("size_status"), c("n_rows")),
        row(question_cap(rows), "dataset-first-run-rows", when(c("questions") == 0, "WARN"), c("questions")),
        row(words(input_types(usable(rows))), "dataset-input-shape", when(c("words") > 1, "FAIL"), c("words")),
        row(words(unrecognised_words(rows)), "dataset-provenance-vocabulary", F.lit("WARN"), c("words")),
        row(near_duplicate_counts(rows), "dataset-near-duplicates", when(c("pairs") > 0, "WARN"), c("pairs")),
        row(outcome.where("status <> 'WARN'"), "dataset-outcome-field", F.lit("PASS"), c("k")),
        row(words(split_vocabulary(rows)), "dataset-split-vocabulary", F.lit("WARN"), c("words")),
        row(sides.where("side = 'tuning'"), "dataset-tuning-size", when(c("labelled_rows") < 10, "WARN"), c("n_rows")),
        row(sides.where("side = 'heldout'"), "dataset-holdout-resolution", when(c("labelled_rows") < 10, "WARN"), c("n_rows")),
        row(difficulty_coverage(rows).where("difficulty_status <> 'NONE'"), "dataset-difficulty", c("difficulty_status"), c("bands")),
        row(scenario_coverage(rows).where("status <> 'NONE'"), "dataset-coverage", c("status"), c("scenarios")),
    ):
        out = out.unionByName(cut(p))
    return out


def row_count_bounds(rows: DataFrame) -> DataFrame:
    """Checks whose row counts exceed their dataset's candidate rows: none, unless a check is wrong."""
    counted = check_report(rows).where(F.col("check").isin("dataset-integrity", "dataset-duplicates", "dataset-ids", "dataset-provenance", "dataset-difficulty-coverage"))
    return counted.join(label_counts(rows).select(KEY, "candidate_rows"), KEY).select(KEY, "check", (F.col("count") <= F.col("candidate_rows")).alias("ok"))
