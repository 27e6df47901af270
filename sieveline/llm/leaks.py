"""Evaluation items inside training text, verbatim or with other numbers and names.

Both sides are read as words; numbers, codes, names and units become typed placeholders, so that every window of ten words
has a template. Which words are names is learned from the items: words with a capital inside a sentence that the items
never write small. A window's slots are the words behind its placeholders; its pattern says which slots are equal.
Windows meet by a hash join on template and pattern, which is the consistency check of slots: where slots are the
same in one text they must be the same in the other. Equal slot values on top make a verbatim leak; different
ones a re-parameterised question.

A null text or input counts as empty; an item with fewer than ten words has no window; texts are taken whole; repeated items
and texts are reported each; copies of a window in one text count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.overlap import _mix
from sieveline.session import cut

WINDOW = 10
#: Templates of items that are sent to the tasks as a filter; more than that are joined by shuffle alone.
FILTERED = 500_000
#: Names, and their bytes, that are sent to the tasks; more are joined with the words of each text, with the same result.
NAMES, NAMES_BYTES = 100_000, 4_000_000
CACHED_WORDS = 500_000
WORD = re.compile(r"\w+")
# Units of money, time and measure.
UNITS = frozenset("usd eur chf gbp jpy pln brl € $ £ percent prozent hours hour days day minutes minute seconds weeks week months month years year kg g km m cm mm mb gb tb".split())
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def placeholder(word: str, names: frozenset[str]) -> str | None:
    """The type of a word that a template leaves open, or None."""
    if any(map(str.isdigit, word)):
        return "<number>" if word.isdigit() else "<code>"
    return "<unit>" if word in UNITS else "<name>" if word in names else None


def _h(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class Windows:
    """Hashes of the words and templates of texts; words are kept between batches."""

    def __init__(self, names: frozenset[str] | None):
        """``names`` holds for all texts; without it each text comes with its own."""
        self.names, self.known = names, {}

    def words(self, text: str, own: frozenset[str] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word its hash, the hash of what its template shows, and whether it is a slot."""
        known, names = (self.known, self.names) if self.names is not None else ({}, own)
        if len(known) > CACHED_WORDS:
            known.clear()
        rows = []
        for w in WORD.findall(text):
            got = known.get(w)
            if got is None:
                low = w.lower()
                kind = placeholder(low, names)
                got = known[w] = (_h(low), _h(kind or low), kind is not None)
            rows.append(got)
        if not rows:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
        exact, shown, slot = zip(*rows)
        return np.array(exact, np.uint64), np.array(shown, np.uint64), np.array(slot, bool)

    @staticmethod
    def rolled(h: np.ndarray) -> np.ndarray:
        n = len(h) - WINDOW + 1
        out = np.zeros(max(0, n), np.uint64)
        for k in range(WINDOW if n > 0 else 0):
            out = _mix(out * _GOLDEN + h[k : k + n])
        return out

    def of(self, text: str, wanted: np.ndarray | None, own: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
        """(key, slots, start) of the windows whose template is among the sorted ``wanted`` ones (all, if None).

        ``key`` hashes template and pattern, ``slots`` the slot values.
        """
        exact, shown, slot = self.words(text, own)
        template = self.rolled(shown)
        if not len(template):
            return []
        if wanted is None:
            at = np.arange(len(template))
        else:
            near = np.searchsorted(wanted, template)
            at = np.flatnonzero((near < len(wanted)) & (wanted[np.minimum(near, len(wanted) - 1)] == template)) if len(wanted) else np.empty(0, np.int64)
        out = []
        for i in at.tolist():
            values = exact[i : i + WINDOW][slot[i : i + WINDOW]].tolist()
            first: dict[int, int] = {}
            pattern = bytes(first.setdefault(v, len(first)) for v in values)
            key = xxhash.xxh64_intdigest(int(template[i]).to_bytes(8, "little") + pattern)
            slots = xxhash.xxh64_intdigest(b"".join(v.to_bytes(8, "little") for v in values))
            out.append((key, slots, i))
        return out


def names(items: DataFrame) -> DataFrame:
    """(name): names by the items' own spelling."""
    text = F.coalesce(F.col("input"), F.lit(""))
    seen = items.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<![.!?:]\s{1,3}|^)(?<![\p{L}\p{N}_])(\p{L}+)(?![\p{L}\p{N}_])"), 1)).alias("w"))
    judged = seen.groupBy(F.lower("w").alias("name")).agg(F.count_if(F.col("w").rlike(r"^\p{Lu}\p{Ll}")).alias("big"), F.count("*").alias("n"))
    return judged.where("big = n").select("name")


def with_names(df: DataFrame, key: str, text: str, known: DataFrame | None) -> DataFrame:
    """(key, text, own): each text with the names among its words, found by a join; ``own`` is null where all texts share one set.

    Words leave a text once each, so what is gathered again is bounded by the text; equal keys share their names, as they share nothing else.
    """
    only = df.select(key, text)
    if known is None:
        return only.withColumn("own", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({w.lower() for w in WORD.findall(t or "")}) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([w for f in found for w in f], pa.string())], names=[key, "name"])

    mine = only.mapInArrow(run, f"{key} long, name string").join(known, "name").groupBy(key).agg(F.collect_set("name").alias("own"))
    return only.join(mine, key, "left").select(key, text, F.coalesce("own", F.array().cast("array<string>")).alias("own"))


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _windows(named: DataFrame, key: str, text: str, known, wanted) -> DataFrame:
    """(key column, k, s, at) of the windows of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Windows(known.value)
        only = wanted.value if wanted is not None else None
        for batch in batches:
            ids, ks, ss, at = [], [], [], []
            for i, t, own in zip(*(batch.column(c).to_pylist() for c in (key, text, "own"))):
                found = maker.of(t or "", only, frozenset(own or ()))
                ids += [i] * len(found)
                for a, b, c in found:
                    ks.append(a)
                    ss.append(b)
                    at.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _signed(ks), _signed(ss), pa.array(at, pa.int32())], names=[key, "k", "s", "at"])

    return named.mapInArrow(run, f"{key} long, k long, s long, at int")


def _templates(named: DataFrame, known) -> DataFrame:
    """(t): distinct templates of the items' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Windows(known.value)
        for batch in batches:
            all_of = [maker.rolled(maker.words(t or "", frozenset(own or ()))[1]) for t, own in zip(batch.column("input").to_pylist(), batch.column("own").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(all_of) if all_of else np.empty(0, np.uint64)).view(np.int64))], names=["t"])

    return named.mapInArrow(run, "t long").distinct()


def matched(items: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of items (item_id, k, s, at), and the windows of documents (doc_id, k, s, at) whose template an item has."""
    sc = items.sparkSession.sparkContext
    listed = cut(names(items))
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).alias("bytes")).first()
    few = size.n <= NAMES and size.bytes <= NAMES_BYTES
    known = sc.broadcast(frozenset(r.name for r in listed.collect()) if few else None)
    mine = with_names(items, "item_id", "input", None if few else listed)
    theirs = with_names(documents, "doc_id", "text", None if few else listed)
    found = _templates(mine, known).limit(FILTERED + 1).toPandas()["t"].to_numpy(np.int64)
    wanted = sc.broadcast(np.sort(found.view(np.uint64))) if len(found) <= FILTERED else None
    return cut(_windows(mine, "item_id", "input", known, None)), cut(_windows(theirs, "doc_id", "text", known, wanted).dropDuplicates(["doc_id", "k", "s"]))


def verbatim(sides: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(item_id, doc_id): ten consecutive words of the item occur in the document."""
    mine, theirs = sides
    return theirs.select("doc_id", "k", "s").join(mine.select("item_id", "k", "s").distinct(), ["k", "s"]).select("item_id", "doc_id").distinct()


def changed(sides: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(doc_id, item_id, windows): windows of a document that have the item's template and pattern but no item's slot values.

    Items that share a template are reported each; an item has a row with every document that has one of its templates.
    """
    mine, theirs = sides
    other = theirs.join(mine.select("k", "s").distinct(), ["k", "s"], "left_anti").select("doc_id", "k", "s")
    return other.join(mine.select("k", "item_id").distinct(), "k").groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"))
