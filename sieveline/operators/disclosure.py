"""Texts that hold a secret known only by its digest: every window of the digests' lengths is hashed and joined.

A text is read as a consumer reads it: URL, HTML, language, JSON and Markdown escapes are decoded until nothing changes, at most
PASSES times, CSS escapes as texts of their own, and the case is folded. The result names digests, never a part of a text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSES = 8
#: Digests that may be broadcast; beyond it both sides are shuffled.
BROADCAST_DIGESTS = 100_000
_LONG, _SHORT, _HEX = (re.compile(p, re.I) for p in (r"\\U([0-9a-f]{8})", r"\\u([0-9a-f]{4})", r"\\x([0-9a-f]{2})"))
_POINT, _NAMED, _OCTAL = re.compile(r"\\u\{([0-9a-f]{1,6})\}", re.I), re.compile(r"\\N\{([^}]+)\}"), re.compile(r"\\([0-7]{1,3})")
_CSS_POINT, _CSS = re.compile(r"\\(?:([0-9a-f]{6})|([0-9a-f]{1,5})(?:[ \t\r\n\f]|(?=[^0-9a-f]|$)))", re.I), re.compile(r"\\([^0-9a-f\r\n\f])", re.I)


def _point(m: re.Match[str]) -> str:
    value = int(m[1] or m[2], 16)
    return chr(value) if value <= 0x10FFFF else m[0]


def _named(m: re.Match[str]) -> str:
    try:
        return unicodedata.lookup(m[1])
    except KeyError:
        return m[0]


def decoded(text: str) -> tuple[str, bool, set[str]]:
    """The text without escapes, whether some are left after all passes, and the texts in which CSS escapes may stand."""
    css = set()
    for _ in range(PASSES):
        new = text
        for pattern in (_LONG, _SHORT, _HEX, _POINT):
            new = pattern.sub(_point, new)
        new = unquote(unescape(_NAMED.sub(_named, new).replace("\\-", "-")))
        if "\\" in new:
            css.add(new)
        new = _OCTAL.sub(lambda m: chr(int(m[1], 8)), new)
        if new == text:
            return text, False, css
        text = new
    return text, True, css


def readings(text: str) -> tuple[set[bytes], bool]:
    """Bytes of a text as it stands and of all its readings, and whether escapes nest too deep to be read."""
    out, deep, seen, front = {text.encode("utf-8", "surrogatepass")}, False, {text}, [text]
    for level in range(PASSES + 1):
        further = []
        for t in front:
            plain, left, css = decoded(t)
            deep |= left
            out.add(plain.casefold().encode("utf-8", "surrogatepass"))
            further += {_CSS.sub(r"\1", _CSS_POINT.sub(_point, c)) for c in css} - {plain}
        front = sorted(set(further) - seen)
        seen.update(front)
    return out, deep or bool(front)


def disclosed(texts: DataFrame, key: str, text: str, digests: DataFrame) -> DataFrame:
    """(key, digest) where a window of ``n_bytes`` bytes of a reading of the text has that SHA-256. ``digests``: (digest, n_bytes) of case-folded secrets.

    A text whose escapes nest deeper than is read has a row with a null digest. The lengths are few and end up in the plan; windows are hashed in
    the JVM and leave a task only if their digest joins: the digests are broadcast, up to BROADCAST_DIGESTS of them, and never the windows,
    whose number the planner can't know. Null and short texts have no window.
    """
    lengths = sorted(r.n_bytes for r in digests.select("n_bytes").distinct().limit(65).collect())
    if len(lengths) > 64:
        raise ValueError("more than 64 lengths of digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raws, deep = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t is not None:
                    read, left = readings(t)
                    raws += read
                    at += [i] * len(read)
                    deep += [left] * len(read)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(raws, pa.binary()), pa.array(deep, pa.bool_())], names=[key, "raw", "deep"])

    only = texts.select(key, text)
    read = only.mapInArrow(run, T.StructType([only.schema[0], T.StructField("raw", T.BinaryType()), T.StructField("deep", T.BooleanType())]))
    raw, n = F.col("raw"), F.octet_length("raw")

    def hashed(k: int):
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.sha2(F.substring(raw, i, F.lit(k)), 256)))

    windows = F.flatten(F.array_compact(F.array(*map(hashed, lengths)))) if lengths else F.array().cast("array<string>")
    wanted = digests.select("digest").distinct()
    few = wanted.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    found = read.select(key, F.explode(windows).alias("digest")).join(wanted.hint("broadcast" if few else "merge"), "digest").select(key, "digest")
    return found.unionByName(read.where("deep").select(key, F.lit(None).cast("string").alias("digest"))).distinct()
