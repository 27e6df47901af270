"""Records that differ only in how they are written.

Every text becomes a tree: a text that parses as a JSON object is a node of named, unordered fields, any other a
single leaf. Leaves are normalised (letters and digits only, lower case), a node's digest is made from the sorted
digests of its children, a record's from those of its two texts, and rows are grouped by it. Rows whose digest is shared are read again and confirmed by comparing
their full normalised trees, written out in one canonical form. A group of any size is one aggregation; members are never gathered.

Null counts as empty; texts without letters and digits are equal to each other; repeated rows are copies; a JSON
object never equals plain text; of a repeated field name the last value counts, as in the parser.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.filters import Bits
from sieveline.session import cut

_DROPPED = re.compile(r"[\W_]+")


def _leaf(value) -> str:
    text = {True: "true", False: "false", None: "null"}[value] if value is None or isinstance(value, bool) else str(value)
    return _DROPPED.sub("", text.lower())


def _ordered(pairs: list) -> dict:
    return dict(sorted(dict(pairs).items()))


def parsed(text: str) -> dict | str:
    """The normalised tree of a text: a dict with its fields in order of their names, or a leaf."""
    try:
        value = json.loads(text, parse_int=str, parse_float=str, parse_constant=str, object_pairs_hook=_ordered)
    except (ValueError, RecursionError):
        value = None

    def clean(node):
        if isinstance(node, dict):
            return {k: clean(v) for k, v in node.items()}
        return [clean(v) for v in node] if isinstance(node, list) else _leaf(node)

    try:
        return clean(value) if isinstance(value, dict) else _DROPPED.sub("", text.lower())
    except RecursionError:
        return _DROPPED.sub("", text.lower())


def form(tree: dict | str) -> str:
    """The whole tree as one text; equal for equal trees only."""
    if isinstance(tree, str):
        return "t" + tree
    return "o" + json.dumps(tree, ensure_ascii=False, separators=(",", ":"))


def digest(node: dict | list | str) -> bytes:
    """Merkle digest: a leaf hashes its text, a node the sorted digests of its fields, a list those of its items in order."""
    if isinstance(node, str):
        return hashlib.md5(b"t" + node.encode("utf-8", "surrogatepass")).digest()
    if isinstance(node, dict):
        return hashlib.md5(b"o" + b"".join(sorted(hashlib.md5(k.encode("utf-8", "surrogatepass") + b"\0" + digest(v)).digest() for k, v in node.items()))).digest()
    return hashlib.md5(b"a" + b"".join(map(digest, node))).digest()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("input").to_pylist(), batch.column("output").to_pylist())
        roots = [hashlib.md5(digest(parsed(a or "")) + digest(parsed(b or ""))).digest() for a, b in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(roots, pa.binary())], names=["row_id", "root"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([form(parsed(x or "")) for x in batch.column(name).to_pylist()] for name in ("input", "output"))
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array([f"{len(x)} {x}{y}" for x, y in zip(a, b)])], names=["row_id", "form"])


def _plain(c: str) -> Column:
    return F.concat(F.lit("t"), F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+", ""))


def _structured() -> Column:
    return F.coalesce(F.col("input").rlike(r"\A\s*\{"), F.lit(False)) | F.coalesce(F.col("output").rlike(r"\A\s*\{"), F.lit(False))


def digested(rows: DataFrame) -> DataFrame:
    """(row_id, root): the Merkle root of each row.

    Rows in which neither text opens with a brace have two leaves; the JVM normalises and digests them alike. The others are parsed.
    """
    narrow = rows.select("row_id", "input", "output")
    root = F.unhex(F.md5(F.concat(F.unhex(F.md5(_plain("input"))), F.unhex(F.md5(_plain("output"))))))
    flat = narrow.where(~_structured()).select("row_id", root.alias("root"))
    return flat.unionByName(narrow.where(_structured()).mapInArrow(_roots, "row_id long, root binary"))


def formed(rows: DataFrame) -> DataFrame:
    """(row_id, form): the full canonical form of each row."""
    narrow = rows.select("row_id", "input", "output")
    flat = narrow.where(~_structured()).select("row_id", _plain("input").alias("a"), _plain("output").alias("b")).select("row_id", F.concat(F.length("a").cast("string"), F.lit(" "), "a", "b").alias("form"))
    return flat.unionByName(narrow.where(_structured()).mapInArrow(_forms, "row_id long, form string"))


def copies(rows: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): the smallest row of each set of equal records with each other one."""
    roots = cut(digested(rows))
    several = roots.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    shared = cut(roots.join(several, "root"))
    again = Bits(shared, "row_id").marked(rows.select("row_id", "input", "output"), "row_id", "shared").where("shared")
    forms = formed(again).join(shared, "row_id")
    trees = cut(forms.groupBy("root", "form").agg(F.min("row_id").alias("row_id_a"), F.count("*").alias("n")).withColumn("of_root", F.count("*").over(Window.partitionBy("root"))))
    # A root with one tree, as all have but for a clash of digests, is confirmed: its rows need no further look at their texts.
    one = shared.join(trees.where("of_root = 1").select("root", "row_id_a"), "root").select("row_id_a", F.col("row_id").alias("row_id_b"))
    clash = forms.join(trees.where("of_root > 1 AND n > 1").select("root", "form", "row_id_a"), ["root", "form"]).select("row_id_a", F.col("row_id").alias("row_id_b"))
    pairs = one if trees.where("of_root > 1").isEmpty() else one.unionByName(clash)
    return pairs.where("row_id_a <> row_id_b")


def collapsed(rows: DataFrame) -> DataFrame:
    """(row_id, copies): one row per record, its smallest row and how many rows it stands for."""
    extra = copies(rows)
    more = extra.groupBy(F.col("row_id_a").alias("row_id")).agg((F.count("*") + 1).alias("n"))
    kept = rows.select("row_id").join(extra.select(F.col("row_id_b").alias("row_id")), "row_id", "left_anti")
    return kept.join(more, "row_id", "left").select("row_id", F.coalesce("n", F.lit(1)).cast("long").alias("copies"))
