"""Column expressions for text: words, normal forms, shingles. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"

# The names of the two sides of a split.
TUNING = ("tune", "tuning", "train", "search")
HELDOUT = ("holdout", "held-out", "heldout", "held_out", "test", "validation", "validate")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def side(c: Column) -> Column:
    """``tuning``, ``heldout`` or null, by the trimmed lower-case split name."""
    name = F.lower(strip(c))
    return F.when(name.isin(*TUNING), "tuning").when(name.isin(*HELDOUT), "heldout")


def fold(c: Column) -> Column:
    """Lower case with the two letters whose case folding differs from it."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")


def words(c: Column) -> Column:
    """Maximal runs of letters, digits and underscores, lower-cased; none for null."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(WORD), 1), F.array().cast("array<string>"))


def normal_text(c: Column) -> Column:
    """The words joined by one space; empty for null. One pass, without an array of words."""
    return F.coalesce(F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_]+", " ")), F.lit(""))


def identity(c: Column) -> Column:
    """Normal text; where a text has no word, its trimmed lower-case form, so that ``+`` and ``-`` differ."""
    n = normal_text(c)
    return F.when(n != "", n).otherwise(F.lower(strip(c)))


def shingles(w: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` words; a shorter non-empty list is one shingle, an empty one has none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.array_distinct(F.when(F.size(w) >= size, runs).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))
