"""Same or near-same records on opposite sides of a split.

Two rows belong together if their sets of three-word runs have a Jaccard similarity of at least 7/10. Rows with the
same words in the same order form a class; classes, not rows, are compared. The set of a class gets 96 minimum hashes, put into 24 bands
of four, and a sketch of 64 bits. Two classes meet if a band agrees and they stand on opposite sides; the sketches
discard what is far apart, and what is left is verified on the sets themselves. A pair at exactly 0.7 is missed with a
probability of 0.0015 by the bands and 0.0001 by the sketch; both fall quickly above it.

Nulls count as empty texts; rows without a side or with under three words pair with nothing; repeated rows are one class and come out as
their pairs; very long texts are taken whole; an empty table gives no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import side
from sieveline.llm.filters import Bits
from sieveline.session import cut

SIZE, BANDS, ROWS_PER_BAND = 3, 24, 4
NUMERATOR, DENOMINATOR = 7, 10
#: Differing sketch bits that are still compared: 64 fair bits of which a share of (1 - J) / 2 differs.
SKETCH_BITS = 21
CACHED_WORDS = 500_000

_rng = np.random.default_rng(20240607)
MULTIPLIERS = (_rng.integers(0, 2**32, BANDS * ROWS_PER_BAND, dtype=np.uint64) | 1).astype(np.uint32)
ADDENDS = _rng.integers(0, 2**32, BANDS * ROWS_PER_BAND, dtype=np.uint64).astype(np.uint32)


def canonical(*texts: str) -> Column:
    """The lower-case words of several columns, joined by one space."""
    joined = F.concat_ws(" ", *(F.coalesce(F.col(t), F.lit("")) for t in texts))
    return F.trim(F.lower(F.regexp_replace(joined, r"[^\p{L}\p{N}_]+", " ")))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Runs:
    """64-bit hashes of the word runs of many texts; the hashes of words are kept between batches."""

    def __init__(self, size: int = SIZE):
        self.size, self.known = size, {}

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs in order, and for each run the index of its text."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, size = self.known, self.size
        words = [t.split(" ") if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        for w in set(flat).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        hashes = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        of_text = np.repeat(np.arange(len(words)), lengths)
        n = len(flat) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        run = np.zeros(n, np.uint64)
        for k in range(size):
            run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
        inside = of_text[:n] == of_text[size - 1 :]
        return run[inside], of_text[:n][inside]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = Runs()
    for batch in batches:
        texts = batch.column("words").to_pylist()
        h, at = runs.of(texts)
        keep, starts = np.unique(at, return_index=True)
        if not len(keep):
            continue
        x = (h >> np.uint64(32)).astype(np.uint32)
        low = np.empty((len(keep), BANDS * ROWS_PER_BAND), np.uint32)
        room = np.empty_like(x)
        for k in range(BANDS * ROWS_PER_BAND):
            np.multiply(x, MULTIPLIERS[k], out=room)
            np.add(room, ADDENDS[k], out=room)
            low[:, k] = np.minimum.reduceat(room, starts)
        bands = np.empty((len(keep), BANDS), np.uint64)
        for b in range(BANDS):
            v = np.full(len(keep), b + 1, np.uint64)
            for r in range(ROWS_PER_BAND):
                v = _mix(v * np.uint64(0x9E3779B97F4A7C15) + low[:, b * ROWS_PER_BAND + r])
            # 48 bits tell bands apart and leave less to shuffle.
            bands[:, b] = v >> np.uint64(16)
        bits = _mix(low[:, :64].astype(np.uint64) + np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(1)
        sketch = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        offsets = pa.array(np.arange(len(keep) + 1, dtype=np.int32) * BANDS)
        taken = batch.take(pa.array(keep))
        sides = taken.column("tuning").to_numpy(zero_copy_only=False).astype(np.int32) + 2 * taken.column("heldout").to_numpy(zero_copy_only=False).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [taken.column("rep"), pa.array(sides), pa.array(sketch.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))], names=["rep", "sides", "sketch", "bands"]
        )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = Runs()
    for batch in batches:
        sets = []
        for name in ("words_t", "words_h"):
            h, at = runs.of(batch.column(name).to_pylist())
            cuts = np.searchsorted(at, np.arange(batch.num_rows + 1))
            sets.append([set(h[cuts[i] : cuts[i + 1]].tolist()) for i in range(batch.num_rows)])
        ok = []
        for a, b in zip(*sets):
            both = len(a & b)
            ok.append(bool(both) and both * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - both))
        yield batch.filter(pa.array(ok, pa.bool_())).select(["t", "h"])


class Classes(NamedTuple):
    """What is known of the rows with the same words."""

    pairs: DataFrame  #: (t, h): representatives of near-same classes, t with rows on the tuning side, h on the held-out side
    members: DataFrame  #: (row_id, side, rep): the rows of classes of several


def near_classes(rows: DataFrame) -> Classes:
    """The near-same classes of opposite sides.

    Texts stay where they are but for those of repeated rows, one for each class and task, and of rows with a candidate. Which rows these are is
    told by a filter of fixed size; what it lets pass by chance is sorted out by the join or aggregation behind it.
    """
    sided = rows.select("row_id", side(F.col("split")).alias("side"), "input", "output").where("side IS NOT NULL")
    words = canonical("input", "output")
    tuning, heldout = F.max(F.col("side") == "tuning").alias("tuning"), F.max(F.col("side") == "heldout").alias("heldout")
    keys = cut(sided.select("row_id", "side", F.xxhash64(words).alias("k1"), F.xxhash64(F.lit(1), words).alias("k2")))
    several = keys.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("row_id").alias("rep")).where("n > 1").drop("n")
    several = cut(several)
    members = cut(Bits(several, "k1").marked(keys, "k1", "again").where("again").join(several, ["k1", "k2"]).select("row_id", "side", "rep"))
    marked = Bits(members, "row_id").marked(sided, "row_id", "again")
    single = marked.where("NOT again").select(F.col("row_id").alias("rep"), (F.col("side") == "tuning").alias("tuning"), (F.col("side") == "heldout").alias("heldout"), words.alias("words"))
    again = marked.where("again").select("row_id", "side", words.alias("words")).withColumn("k1", F.xxhash64("words")).withColumn("k2", F.xxhash64(F.lit(1), "words"))
    merged = again.groupBy("k1", "k2").agg(F.min("row_id").alias("rep"), tuning, heldout, F.first("words").alias("words")).drop("k1", "k2")
    signed = single.unionByName(merged).mapInArrow(_signed, "rep long, sides int, sketch long, bands array<long>")
    # One shuffle of the bands serves both sides of the join: the sides are told apart behind it.
    placed = signed.select("rep", "sides", "sketch", F.explode("bands").alias("band")).repartition("band")
    sides = placed.select("band", "rep", "sketch", F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda s: F.col("sides").bitwiseAND(s) > 0)).alias("one"))
    t = sides.where("one = 1").select("band", F.col("rep").alias("t"), F.col("sketch").alias("st"))
    h = sides.where("one = 2").select("band", F.col("rep").alias("h"), F.col("sketch").alias("sh"))
    near = F.bit_count(F.col("st").bitwiseXOR(F.col("sh"))) <= SKETCH_BITS
    # A class on both sides is a pair with itself; it needs no verification.
    candidates = cut(t.join(h, "band").where(near).select("t", "h").distinct())
    apart = candidates.where("t <> h")
    ids = cut(apart.select(F.explode(F.array("t", "h")).alias("row_id")).distinct())
    # Texts that pass by chance meet no candidate below.
    texts = cut(Bits(ids, "row_id").marked(sided, "row_id", "asked").where("asked").select("row_id", words.alias("words")))
    compared = apart.join(texts.select(F.col("row_id").alias("t"), F.col("words").alias("words_t")), "t").join(texts.select(F.col("row_id").alias("h"), F.col("words").alias("words_h")), "h")
    return Classes(compared.select("t", "h", "words_t", "words_h").mapInArrow(_verified, "t long, h long").unionByName(candidates.where("t = h")), members)


def cross_split_pairs(rows: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), the smaller first: all pairs of near-same rows of opposite sides."""
    pairs, members = near_classes(rows)
    # A class of one row stands for itself, others for their members of the side.
    left = members.where("side = 'tuning'").select(F.col("rep").alias("t"), F.col("row_id").alias("mt"))
    right = members.where("side = 'heldout'").select(F.col("rep").alias("h"), F.col("row_id").alias("mh"))
    out = pairs.join(left, "t", "left").join(right, "h", "left").select(F.coalesce("mt", "t").alias("a"), F.coalesce("mh", "h").alias("b"))
    return out.select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))


def overlap_counts(rows: DataFrame) -> DataFrame:
    """Per side, split and source: rows with a partner on the other side, and their pairs; counted by class sizes, without making the pairs of rows."""
    pairs, members = near_classes(rows)
    pairs = cut(pairs)
    size = members.groupBy("rep", "side").agg(F.count("*").alias("size"))

    def partners(mine: str, other: str, name: str, across: str) -> DataFrame:
        """(rep, side, n): of a class on one side, its rows' partners on the other."""
        sized = pairs.join(size.where(F.col("side") == across).select(F.col("rep").alias(other), "size"), other, "left")
        return sized.groupBy(F.col(mine).alias("rep")).agg(F.sum(F.coalesce("size", F.lit(1))).alias("n")).withColumn("side", F.lit(name))

    n = cut(partners("t", "h", "tuning", "heldout").unionByName(partners("h", "t", "heldout", "tuning")))
    many = members.join(n, ["rep", "side"]).select("row_id", "n")
    alone = n.join(members.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("row_id"), "n")
    return rows.select("row_id", side(F.col("split")).alias("side"), "split", "source").join(many.unionByName(alone), "row_id").groupBy("side", "split", "source").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_pairs"))
