"""Byte-level BPE ids of whole texts, with vectorised pre-tokenisation.

The pre-tokens are those of the tokenizer's pattern: English contractions, an optional space with a run of letters, digits or
other marks, white space up to the last of a run, and other white space. No regular expression is used: every
code point of a batch is looked up in a class array; each class is a function from the state before a character to the state
after it; these functions form a finite monoid, whose elements are numbered and multiplied by a table. An inclusive
scan in doubling steps composes them, and since most are constant it ends after a few steps. A pre-token starts where
the state before and the character say so. The slices are looked up in a cache of merged pieces.

Null and empty texts have the empty list of ids. Texts are taken whole, whatever their length; a piece of any length is merged
with a heap in O(n log n). Special tokens have no meaning: their strings are ordinary text. Repeated rows get the same ids.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
CACHED_PIECES = 400_000
#: Code points handled at once; a longer text is still one piece of work.
BATCH_POINTS = 1 << 20

# Classes of code points.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE1, QUOTE2 = range(7)
# States: what the character before left; INSIDE1 and INSIDE2 have so many letters of a contraction to come, DONE has none.
S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_INSIDE1, S_INSIDE2, S_DONE = range(8)
# What follows the apostrophe of a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def _step(state: int, kind: int) -> int:
    if state == S_INSIDE2:
        return S_INSIDE1
    if state == S_INSIDE1:
        return S_DONE
    if kind in (QUOTE1, QUOTE2):
        if state in (S_OTHER, S_BLANK):
            return S_OTHER
        return S_INSIDE1 if kind == QUOTE1 else S_INSIDE2
    return {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER, BLANK: S_BLANK, SPACE: S_SPACE}[kind]


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each class's function, product table, image of the start state (that after white space), and which are constant."""
    generators = [tuple(_step(s, k) for s in range(8)) for k in range(7)]
    elements = list(dict.fromkeys(generators)) + [(c,) * 8 for c in range(8) if (c,) * 8 not in generators]
    elements = list(dict.fromkeys(elements))
    at = 0
    while at < len(elements):
        for g in generators:
            product = tuple(g[s] for s in elements[at])
            if product not in elements:
                elements.append(product)
        at += 1
    number = {e: i for i, e in enumerate(elements)}
    # Products of products stay inside: elements are words over the generators and the constants.
    table = np.array([[number[tuple(b[s] for s in a)] for b in elements] for a in elements], np.uint16)
    return np.array([number[g] for g in generators], np.uint16), table, np.array([e[S_SPACE] for e in elements], np.uint8), np.array([len(set(e)) == 1 for e in elements])


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letters and numbers by general category, white space by its Unicode property."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    out[32] = BLANK
    return out


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points start a pre-token; ``first`` marks the first code point of each text."""
    n = len(points)
    kind = classes()[points]
    last = np.empty(n, bool)
    last[:-1], last[-1:] = first[1:], True
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        one = np.zeros(len(quotes), bool)
        two = np.zeros(len(quotes), bool)
        n1, n2 = np.minimum(quotes + 1, n - 1), np.minimum(quotes + 2, n - 1)
        has1 = ~last[quotes]
        has2 = has1 & ~last[n1]
        one = has1 & np.isin(points[n1], [ord(c) for c in SHORT])
        for a, b in LONG:
            two |= has2 & (points[n1] == ord(a)) & (points[n2] == ord(b))
        kind[quotes[one]], kind[quotes[two]] = QUOTE1, QUOTE2
    generators, table, image, constant = monoid()
    f = generators[kind]
    # A text starts as after white space that was closed: its first function is made constant.
    constants = {s: i for i, (s, c) in enumerate(zip(image, constant)) if c}
    f[first] = np.array([constants[int(s)] if int(s) in constants else 0 for s in image[generators]], np.uint16)[kind[first]]
    reach = 1
    while reach < n and not constant[f].all():
        g = f.copy()
        g[reach:] = table[f[:-reach], f[reach:]]
        f, reach = g, reach * 2
    after = image[f]
    before = np.empty(n, np.uint8)
    before[1:], before[:1] = after[:-1], S_SPACE
    white = (kind == BLANK) | (kind == SPACE)
    next_white = np.empty(n, bool)
    next_white[:-1] = white[1:]
    next_white[-1:] = True
    next_white |= last  # the end of a text closes a run as white space does
    was_white = (before == S_BLANK) | (before == S_SPACE)
    inside = (before == S_INSIDE1) | (before == S_INSIDE2)
    same = ((kind == LETTER) & (before == S_LETTER)) | ((kind == NUMBER) & (before == S_NUMBER)) | ((after == S_OTHER) & (before == S_OTHER))
    # White space: starts after anything else; the last of a run that something follows stands apart.
    start_white = white & (~was_white | ~next_white)
    # Others: a single blank before them belongs to them, other white space does not.
    start_other = ~white & ~inside & ~same & (before != S_BLANK)
    return (start_white & ~inside) | start_other | first


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the neighbouring pair of lowest rank is merged, the leftmost first, until none is known."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left, j = parts[i], after[i]
            if left is None or j >= len(parts) or len(left) + len(parts[j]) != size:
                continue
            merged = left + parts[j]
            parts[i], parts[j], after[i] = merged, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (r := ranks.get(merged + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, size + len(parts[after[i]])))
            if (p := before[i]) >= 0 and (r := ranks.get(parts[p] + merged)) is not None:
                heapq.heappush(heap, (r, p, len(parts[p]) + size))
        return tuple(ranks[p] for p in parts if p is not None)

    def piece(self, text: str) -> tuple[int, ...]:
        got = self.pieces.get(text)
        if got is None:
            got = self.merge(text.encode("utf-8", "replace"))
            if len(text) <= 64:
                if len(self.pieces) >= CACHED_PIECES:
                    self.pieces.clear()
                self.pieces[text] = got
        return got

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text, and the code point at which each pre-token starts."""
        ids: list[list[int]] = [[] for _ in texts]
        offsets: list[list[int]] = [[] for _ in texts]
        group, size = [], 0
        for k, t in enumerate(texts):
            if t:
                group.append(k)
                size += len(t)
            if group and (size >= BATCH_POINTS or k == len(texts) - 1):
                self._group([texts[g] for g in group], group, ids, offsets)
                group, size = [], 0
        if group:
            self._group([texts[g] for g in group], group, ids, offsets)
        return ids, offsets

    def _group(self, texts: list[str], where: list[int], ids: list[list[int]], offsets: list[list[int]]) -> None:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        first = np.zeros(len(points), bool)
        first[ends - lengths] = True
        starts = np.flatnonzero(boundaries(points, first))
        cuts = np.searchsorted(starts, np.concatenate([[0], ends]))
        known, piece = self.pieces, self.piece
        for k, text in enumerate(texts):
            local = (starts[cuts[k] : cuts[k + 1]] - (ends[k] - lengths[k])).tolist()
            out = ids[where[k]]
            for a, b in zip(local, [*local[1:], len(text)]):
                token = text[a:b]
                got = known.get(token)
                out.extend(got if got is not None else piece(token))
            offsets[where[k]] = local


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(documents: DataFrame, offsets: bool = False, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document, with ``offsets`` also (starts): where in the text each pre-token starts."""
    path = f"{tokenizers}/{NAME}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(path)
        for batch in batches:
            ids, starts = mine.encode([t or "" for t in batch.column("text").to_pylist()])
            columns, names = [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            if offsets:
                columns.append(pa.array(starts, pa.list_(pa.int32())))
                names.append("starts")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", starts array<int>" * offsets)


def decode(ids: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of encoded documents."""
    path = f"{tokenizers}/{NAME}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {v: k for k, v in encoder(path).ranks.items()}
        for batch in batches:
            texts = [b"".join(map(known.__getitem__, x or ())).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
