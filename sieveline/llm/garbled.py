"""Texts that were decoded with a wrong character encoding, and their restoration.

Smoothed character trigram models are trained on clean records. Every token with a character beyond ASCII is encoded back and decoded anew in
all pairs of encodings, and what comes out again, as long as it pays: a step of a chain goes on if it reads UTF-8, which is no chance, or
if it makes the record likelier by more than its cost and more of the tokens that it can read likelier than not. The gain of a chain is the difference of log likelihoods, summed over the record's tokens. A
replacement character stands for lost bytes: its chain is the likeliest filling of the gaps, which tells the mistake though not the text. A record is
garbled if the gain of its best chain less the chain's cost reaches a margin, which is validated on clean records held out of training: it lies above
what any of them gains but one in two hundred. All clean records train, and all are held out once: texts fall into FOLDS parts by their hash, and each
is judged for the margin by the model of the other parts. The model that judges in the end counts all of them.

Tokens are first made distinct over all records, with their digits masked, so that the first step is judged once for each. Its gains are
joined back and summed, in whole millionths, by record and step; records in which a first step pays are then judged whole, chain by chain.

Models are tables of gram counts, summed by aggregation over all records, whole texts. Sorted, they go as a file to every node, where workers map it
into memory and share its pages; nothing of them is held by the driver but a partition at a time. Up to LOCAL_CHARS characters in all, the driver
learns by itself, with the same result. HTML entities, escapes and percent codes are ASCII and never touched. Null, empty and plain ASCII texts are
clean; repeated rows get the same result.
"""

from __future__ import annotations

import atexit
import mmap
import re
import shutil
import tempfile
import uuid
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.filters import Bits
from sieveline.session import cut, written

#: Parts of the clean texts, each held out of training once.
FOLDS = 5
#: Characters of all texts up to which the driver learns by itself; beyond it the same is done by aggregation.
LOCAL_CHARS = 300_000
LEAST_MARGIN, CACHED_TOKENS, CACHED_LENGTH = 4.0, 150_000, 200
#: Tokens and grams that a task counts before it passes them on.
COUNTED_TOKENS, COUNTED_GRAMS = 50_000, 500_000
#: Log probabilities of grams that are kept.
CACHED_GRAMS = 600_000
#: Gains are added in whole numbers of this part, so that sums do not depend on their order.
MICRO = 1_000_000
#: Log likelihood that a step of a chain must outweigh.
STEP_COST, RARE_COST = 0.5, 5.0
# Encodings in which text may have been written and, by mistake, read.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1251", "cp1250", "iso8859-2", "iso8859-15", "cp852", "cp866", "koi8-r", "cp932", "gbk", "cp1254", "mac-cyrillic", "cp1253", "big5", "euc-jp")
WRITTEN_AS = ("utf-8", "cp1252", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp866", "cp932", "euc-jp", "cp850", "cp437", "mac-roman", "cp852", "gbk")

#: A bit for each step.
BIT = {(read, written): 1 << k for k, (read, written) in enumerate((r, w) for r in READ_AS for w in WRITTEN_AS)}
#: Encodings that the plain checks put texts back into.
PLAIN = ("cp1252", "cp437", "cp850", "mac-roman", "cp1251", "koi8-r")
MANY_BYTES = ("cp932", "gbk", "big5", "euc-jp")

_DIGIT = re.compile(r"\d+")
_PIECE = re.compile(r"[^ \t\r\n]+")
_CONTROL, _LATE_CONTROL = re.compile("[\x00-\x1f\x7f]"), re.compile("[\x80-\x9f]")
#: The chain of a text whose bytes are lost, and the characters tried in their place, commonest first.
LOST, FILLINGS = (("lost", "utf-8"),), 60


def _table(encoding: str) -> dict[str, bytes] | None:
    """Character to byte of a one-byte encoding; bytes it leaves undefined are read as the control of that number."""
    try:
        made = {}
        for b in range(256):
            try:
                made[bytes([b]).decode(encoding)] = bytes([b])
            except UnicodeDecodeError:
                made[chr(b)] = bytes([b])
        return None if encoding in MANY_BYTES else made
    except LookupError:
        return None


_TABLES = {e: _table(e) for e in READ_AS}


def _back(text: str, encoding: str) -> bytes | None:
    table = _TABLES[encoding]
    try:
        return text.encode(encoding) if table is None else b"".join([table[c] for c in text])
    except (KeyError, UnicodeEncodeError):
        return None


# A gram's key has 21 bits for each of its three characters. In place of the first, numbers beyond Unicode mark what is summed over grams: by their
# first two characters, by their last two, by the last, by the middle one; and the number of texts.
PAIR, BI, ONE, LEFT, TEXTS = (n << 42 for n in range(0x110000, 0x110005))
#: Columns of a table of grams: key, count in all texts, count less that of each fold.
COLUMNS = 2 + FOLDS


def grams(tokens: Counter) -> Counter:
    """The counts of a model's keys, given those of tokens as they are written."""
    tri, out = Counter(), Counter()
    for token, n in tokens.items():
        p = f"\x02\x02{_DIGIT.sub('0', token)}\x03"
        for k in range(len(p) - 2):
            tri[p[k : k + 3]] += n
    for gram, n in tri.items():
        a, b, c = map(ord, gram)
        out[a << 42 | b << 21 | c] = n
        out[PAIR | a << 21 | b] += n
        out[BI | b << 21 | c] += n
        out[ONE | c] += n
        out[LEFT | b] += n
    return out


def fold_of(text: str) -> int:
    """The part of the clean texts that a text belongs to; copies of a text belong to the same."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS


class Model:
    """Interpolated trigram model of the characters of tokens, over a table of grams sorted by key: of all texts (column 0) or of all but those of a fold (its number and 1)."""

    def __init__(self, rows: bytes | mmap.mmap, column: int = 0, parts: int = 1, name: str | None = None):
        flat = memoryview(rows).cast("q")
        self.rows, self.keys, self.counts = rows, flat[::COLUMNS], flat[1 + column :: COLUMNS]
        self.name, self.parts, self.cached = name, parts, CACHED_GRAMS // parts
        self.cache: dict[str, float] = {}
        self.one, self.left = self._by_character(ONE), self._by_character(LEFT)
        self.total = sum(self.one.values())
        self.common = [c for c, _ in sorted(self.one.items(), key=lambda x: (-x[1], x[0])) if c.isalpha()][:FILLINGS]

    def count(self, key: int) -> int:
        at = bisect_left(self.keys, key)
        return self.counts[at] if at < len(self.keys) and self.keys[at] == key else 0

    def _by_character(self, mark: int) -> dict[str, int]:
        found = range(bisect_left(self.keys, mark), bisect_left(self.keys, mark + (1 << 42)))
        return {chr(self.keys[k] - mark): self.counts[k] for k in found if self.counts[k]}

    def log(self, gram: str) -> float:
        got = self.cache.get(gram)
        if got is None:
            if len(self.cache) > self.cached:
                self.cache.clear()
            # Nearly all grams of wrong readings are unknown: what no pair of them has is not looked up.
            a, b, c = map(ord, gram)
            n, left = self.one.get(gram[2], 0), self.left.get(gram[1], 0)
            one = (n + 0.02) / (self.total + 0.02 * 40_000)
            bi = self.count(BI | b << 21 | c) if n and left else 0
            two = (bi + 3.0 * one) / (left + 3.0)
            pair = self.count(PAIR | a << 21 | b) if left else 0
            tri = self.count(a << 42 | b << 21 | c) if bi and pair else 0
            got = self.cache[gram] = log((tri + 2.0 * two) / (pair + 2.0))
        return got

    def above(self, token: str, least: float) -> float | None:
        """The log likelihood of a token, or None if it is not above ``least``: it only falls as characters are read."""
        known, p, total = self.cache.get, f"\x02\x02{token}\x03", 0.0
        for k in range(len(p) - 2):
            gram = p[k : k + 3]
            one = known(gram)
            total += self.log(gram) if one is None else one
            if total <= least:
                return None
        return total

    def score(self, token: str) -> float:
        return self.above(token, float("-inf"))  # type: ignore[return-value]

    def filled(self, token: str) -> str:
        """A token with the likeliest character for each replacement character, from left to right."""
        while (at := token.find("\ufffd")) >= 0:
            left = f"\x02\x02{token[:at]}"[-2:]
            right = token[at + 1 : at + 2].replace("\ufffd", "") or "\x03"
            best = max(self.common, key=lambda c: self.log(left + c) + self.log(left[1] + c + right), default="?")
            token = token[:at] + best + token[at + 1 :]
        return token


def fit(texts: list[str]) -> bytes:
    """The table of grams of all texts."""
    tokens, parts = [Counter() for _ in range(FOLDS)], Counter(map(fold_of, texts))
    for text in texts:
        tokens[fold_of(text)].update(_PIECE.findall(text))
    found = [grams(t) for t in tokens]
    for fold, n in parts.items():
        found[fold][TEXTS] = n
    each = np.array([[k, *(f.get(k, 0) for f in found)] for k in sorted(set().union(*found))], np.int64).reshape(-1, 1 + FOLDS)
    return _packed(each[:, 0], each[:, 1:])


def _packed(keys: np.ndarray, folds: np.ndarray) -> bytes:
    total = folds.sum(axis=1, keepdims=True)
    return np.hstack([keys[:, None], total, total - folds]).astype(np.int64).tobytes()


def suspicious(text: str) -> bool:
    """Whether a text has a replacement or control character, or a line most of whose tokens are valid UTF-8 when put back into one-byte encoding.

    A single token may be so by chance in the rarer encodings; in cp1252 it counts by itself.
    """
    if text.isascii():
        return False
    if re.search("[�\x80-\x9f]", text):
        return True
    for line in text.splitlines():
        if line.isascii():
            continue
        reads = [(_reads_kept if len(t) <= CACHED_LENGTH else _reads)(t) for t in set(tokens_of(line))]
        if any(reads):
            for k, encoding in enumerate(PLAIN):
                valid = sum(r >> k & 1 for r in reads)
                if valid and (encoding == "cp1252" or 2 * valid > len(reads)):
                    return True
    return False


def _reads(token: str) -> int:
    """A bit for each of the commoner encodings: whether a token put back into it is valid UTF-8."""
    found = 0
    for k, encoding in enumerate(PLAIN):
        raw = _back(token, encoding)
        try:
            found |= (raw is not None and raw.decode("utf-8") != token) << k
        except UnicodeDecodeError:
            pass
    return found


_reads_kept = lru_cache(CACHED_TOKENS)(_reads)

Chain = tuple[tuple[str, str], ...]


def cost(chain: Chain) -> float:
    """What a chain must gain to be believed: little for UTF-8 read as something else, more for other mistakes."""
    return sum(STEP_COST if written == "utf-8" else RARE_COST for _, written in chain)


def named(chain: Chain) -> str:
    return " + ".join(f"{written} read as {read}" for read, written in chain)


class Judge:
    """Gains of tokens under all chains; kept by token with its digits masked."""

    def __init__(self, model: Model):
        self.model, self.near, self.scores = model, {}, {}
        self.cached = CACHED_TOKENS // model.parts

    def _steps(self, token: str, score: float) -> tuple[list[tuple[float, tuple[str, str], str, bool]], int]:
        """Every reading of a token that is likelier than it is or valid UTF-8, and whether a chain may end there; and the bits of the steps whose reading is neither. Kept by token."""
        got = self.near.get(token)
        if got is not None:
            return got
        out, refused, raws, scores = [], 0, {}, {}
        for read in READ_AS:
            raw = _back(token, read)
            if raw is not None:
                raws.setdefault(raw, read)
        for raw, read in raws.items():
            for written in WRITTEN_AS:
                if written == read:
                    continue
                try:
                    new = raw.decode(written)
                except UnicodeDecodeError:
                    continue
                if new == token:
                    continue
                if "\ufffd" in new or _CONTROL.search(new):
                    refused |= BIT[read, written]
                    continue
                ends = not _LATE_CONTROL.search(new)
                # Valid UTF-8 is no chance: it goes on even if it is less likely, as the middle of a chain may be.
                valid = written == "utf-8"
                if not (valid or ends):
                    refused |= BIT[read, written]
                    continue
                if (new, valid) not in scores:
                    scores[new, valid] = self.model.above(_DIGIT.sub("0", new), float("-inf") if valid else score)
                value = scores[new, valid]
                if value is not None:
                    out.append((value - score, (read, written), new, ends))
                else:
                    refused |= BIT[read, written]
        if len(self.near) > self.cached:
            self.near.clear()
        if len(token) <= CACHED_LENGTH:
            self.near[token] = out, refused
        return out, refused

    def score(self, text: str) -> float:
        """Log likelihood of a token, its digits masked; kept."""
        got = self.scores.get(text)
        if got is None:
            if len(self.scores) > self.cached:
                self.scores.clear()
            got = self.scores[text] = self.model.score(_DIGIT.sub("0", text))
        return got

    def first_steps(self, masked: str) -> list[tuple[str, int, int]]:
        """(step, gain less nothing, cost) of the readings of a token; those that go on whatever they gain cost nothing."""
        found = [(named((step,)), round(gain * MICRO), 0 if step[1] == "utf-8" else round(RARE_COST * MICRO)) for gain, step, _, _ in self._steps(masked, self.score(masked))[0]]
        return [(named(LOST), 0, 0), *found] if "\ufffd" in masked else found

    def judge(self, text: str) -> tuple[float, Chain, dict[str, str]]:
        """The best chain of a text, its summed gain less its cost, and the tokens it restores. There is no bound on a chain's length but that each step pays or reads UTF-8, which leaves fewer characters."""
        tokens = masked_tokens(text)
        if not tokens:
            return 0.0, (), {}
        first = {m: self.score(m) for m in tokens}
        results: dict[Chain, tuple[int, dict[str, str]]] = {}

        def net(chain: Chain, reached: dict[str, str]) -> int:
            """The gain of a chain less its cost; tokens that it makes likelier are kept with it."""
            gains = {m: round((self.score(new) - first[m]) * MICRO) for m, new in reached.items()}
            kept = {m: reached[m] for m, g in gains.items() if g > 0}
            if kept:
                results[chain] = sum(gains[m] * tokens[m] for m in kept) - round(cost(chain) * MICRO), kept
            return results[chain][0] if kept else -round(cost(chain) * MICRO)

        gaps = {m: self.model.filled(m) for m in tokens if "\ufffd" in m}
        if gaps:
            net(LOST, gaps)
        front: list[tuple[Chain, dict[str, str], int]] = [((), {m: m for m in tokens}, 0)]
        done = set()
        while front:
            further = []
            for chain, texts, so_far in front:
                moved: dict[tuple[str, str], dict[str, tuple[str, bool]]] = defaultdict(dict)
                against = []
                for m, t in texts.items():
                    better, refused = self._steps(t, self.score(t))
                    for _, step, new, ends in better:
                        moved[step][m] = new, ends
                    against.append((tokens[m], refused))
                for step, readings in sorted(moved.items()):
                    longer = (*chain, step)
                    now = net(longer, {m: new for m, (new, ends) in readings.items() if ends})
                    reached = {m: new for m, (new, _) in readings.items()}
                    key = frozenset(reached.items())
                    # Different chains to the same texts continue alike.
                    if key not in done and (step[1] == "utf-8" or (now > so_far and sum(tokens[m] for m in readings) > sum(n for n, refused in against if refused & BIT[step]))):
                        done.add(key)
                        further.append((longer, reached, now))
            front = further
        if not results:
            return 0.0, (), {}
        chain = min(results, key=lambda c: (-results[c][0], len(c), named(c)))
        return results[chain][0] / MICRO, chain, self.restorations(text, chain, results)

    def restorations(self, text: str, chain: Chain, results: dict[Chain, tuple[int, dict[str, str]]]) -> dict[str, str]:
        """The tokens of a text that its chain, or where that does not fit their own, restores."""
        restored = {}
        for token in set(tokens_of(text)):
            masked = _DIGIT.sub("0", token)
            kept = results[chain][1].get(masked)
            new = _refilled(token, kept) if kept is not None else valid(token, chain)
            if new is None:
                # Another mistake in the same text: the token's own best chain, if it pays for itself.
                mine = {c: self.score(k[masked]) - self.score(masked) - cost(c) for c, (_, k) in results.items() if masked in k}
                own = min(mine, key=lambda c: (-mine[c], len(c), named(c)), default=None)
                if own is not None and mine[own] >= LEAST_MARGIN:
                    new = _refilled(token, results[own][1][masked])
            if new is not None:
                restored[token] = new
        return restored


def tokens_of(text: str) -> list[str]:
    """The pieces between blanks and line ends that have a character beyond ASCII."""
    return [t for t in _PIECE.findall(text) if not t.isascii() and t.strip()]


def masked_tokens(text: str) -> Counter:
    """How many distinct tokens beyond ASCII there are for each masked one."""
    return Counter(_DIGIT.sub("0", t) for t in set(tokens_of(text)))


def mended(text: str, restored: dict[str, str]) -> str:
    return _PIECE.sub(lambda m: restored.get(m[0], m[0]), text)


def valid(token: str, chain: Chain) -> str | None:
    """A token by a chain that ends in UTF-8, where it can be read so; valid UTF-8 is proof without a gain."""
    if chain == LOST or any(written != "utf-8" for _, written in chain):
        return None
    for read, written in chain:
        raw = _back(token, read)
        try:
            new = raw.decode(written) if raw is not None else token
        except UnicodeDecodeError:
            return None
        if new == token:
            return None
        token = new
    return token


def _refilled(token: str, masked: str) -> str:
    """The digits of ``token`` put back into a masked text."""
    digits = iter(_DIGIT.findall(token))
    return _DIGIT.sub(lambda m: next(digits, m[0]), masked)


def train(documents: DataFrame, records: DataFrame | None = None) -> tuple[Model, float]:
    """The model and the margin, from all texts; ``records`` are their tokens beyond ASCII, if they are known.

    A first model strikes garbled records that the plain checks do not see; the second counts what is left. Every clean record is judged on its whole
    text, as every record is, by the second model less the record's own fold; the margin lies above the gains of all of them but one in two hundred.
    """
    texts = documents.where(F.col("text").rlike(r"\S")).select("doc_id", "text")
    if (texts.agg(F.sum(F.length("text"))).head()[0] or 0) <= LOCAL_CHARS:
        return learned([r.text for r in texts.select("text").collect()])
    return learned_apart(texts, tokens_by_record(texts) if records is None else records)


def learned(texts: list[str]) -> tuple[Model, float]:
    plain = [t for t in texts if not suspicious(t)]
    first = Judge(Model(fit(plain)))
    clean = [t for t in plain if first.judge(t)[0] < 2 * LEAST_MARGIN]
    rows = fit(clean)
    judges = [Judge(Model(rows, 1 + fold, FOLDS)) for fold in range(FOLDS)]
    gains = sorted((round(judges[fold_of(t)].judge(t)[0] * MICRO) for t in clean), reverse=True)
    return Model(rows), margin(gains[_rank(len(gains))] if gains else 0)


def margin(gain: int) -> float:
    return max(LEAST_MARGIN, 1.2 * gain / MICRO)


def _rank(n: int) -> int:
    """The place, from 0 and from the highest, of the gain that all of ``n`` clean texts but one in two hundred stay below."""
    return min(n - 1, n - n * 995 // 1000)


def learned_apart(texts: DataFrame, records: DataFrame) -> tuple[Model, float]:
    """As ``learned``, by aggregation over (doc_id, text) and their tokens beyond ASCII."""
    spark, plain = texts.sparkSession, records.where("plain")
    sums = [F.sum(f"n{f}").alias(f"n{f}") for f in range(FOLDS)]
    counts = written(texts.select("text").mapInArrow(_counts, COUNTS).groupBy("key").agg(*sums), "grams")
    first = sent(spark, counts)
    asked = cut(paying(plain.withColumn("column", F.lit(0)), first))
    struck = written(plain_gains(texts, asked, first, folded=False).where(F.col("gain") >= round(2 * LEAST_MARGIN * MICRO)), "struck")
    less = struck.select("text").mapInArrow(_counts, COUNTS).select("key", *((-F.col(f"n{f}")).alias(f"n{f}") for f in range(FOLDS)))
    second = sent(spark, counts.unionByName(less).groupBy("key").agg(*sums))
    clean = plain.withColumn("column", F.col("fold") + 1)
    gains = plain_gains(texts, cut(paying(clean, second)), second, folded=True).select("doc_id", "gain")
    gains = written(gains.join(struck.select("doc_id"), "doc_id", "left_anti"), "gains")
    model = opened(second)
    n = model.count(TEXTS)
    return model, margin(nth_gain(gains, _rank(n)) if n else 0)


def nth_gain(gains: DataFrame, rank: int) -> int:
    """The gain at a place, from 0 and from the highest, of those above nothing; 0 beyond them. Counts by ever narrower intervals, some thousand at a time, decide."""
    low, high = 0, None
    for width in (1000 * MICRO, MICRO, 1000, 1):
        within = gains.where((F.col("gain") >= low) & (F.lit(True) if high is None else F.col("gain") < high))
        for at, n in sorted(map(tuple, within.groupBy(F.expr(f"gain div {width}").alias("at")).count().collect()), reverse=True):
            if rank < n:
                low, high = at * width, (at + 1) * width
                break
            rank -= n
        else:
            return 0
    return low


COUNTS = "key long, " + ", ".join(f"n{f} long" for f in range(FOLDS))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts by fold of the texts that are not suspicious."""
    tokens, found = [Counter() for _ in range(FOLDS)], [Counter() for _ in range(FOLDS)]

    def counted() -> None:
        for t, f in zip(tokens, found):
            f.update(grams(t))
            t.clear()

    def passed_on() -> pa.RecordBatch:
        keys = sorted(set().union(*found))
        columns = [keys, *([f.get(k, 0) for k in keys] for f in found)]
        for f in found:
            f.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", *(f"n{f}" for f in range(FOLDS))])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not suspicious(text):
                fold = fold_of(text)
                tokens[fold].update(_PIECE.findall(text))
                found[fold][TEXTS] += 1
                if sum(map(len, tokens)) > COUNTED_TOKENS:
                    counted()
                    if sum(map(len, found)) > COUNTED_GRAMS:
                        yield passed_on()
    counted()
    yield passed_on()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        yield pa.RecordBatch.from_arrays([pa.array([_packed(columns[0], np.column_stack(columns[1:]))], pa.binary())], names=["rows"])


def sent(spark: SparkSession, counts: DataFrame) -> str:
    """The name of the file of a table of grams, which every node is sent."""
    known = counts.where(" + ".join(f"n{f}" for f in range(FOLDS)) + " > 0").select("key", *(f"n{f}" for f in range(FOLDS)))
    return sent_rows(spark, (bytes(r.rows) for r in known.orderBy("key").mapInArrow(_pack, "rows binary").toLocalIterator()))


def sent_rows(spark: SparkSession, rows: Iterable[bytes]) -> str:
    folder = tempfile.mkdtemp(prefix="sieveline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, f"grams-{uuid.uuid4().hex}")
    with path.open("wb") as out:
        for some in rows:
            out.write(some)
    spark.sparkContext.addFile(str(path))
    return path.name


def opened(name: str, column: int = 0, parts: int = 1) -> Model:
    with open(SparkFiles.get(name), "rb") as f:
        return Model(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.seek(0, 2) else b"", column, parts, name)


class Judges(dict):
    """The judges of a file's columns, opened as they are asked for."""

    def __init__(self, name: str, parts: int):
        super().__init__()
        self.name, self.parts = name, parts

    def __missing__(self, column: int) -> Judge:
        self[column] = made = Judge(opened(self.name, column, self.parts))
        return made


def _of_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            found = masked_tokens(text)
            if found:
                n = len(found)
                for column, values in zip(out, ([doc] * n, [fold_of(text)] * n, [not suspicious(text)] * n, found, found.values())):
                    column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64()))], names=["doc_id", "fold", "plain", "token", "n"])


def beyond_ascii(texts: DataFrame) -> DataFrame:
    return texts.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("doc_id", "text")


def tokens_by_record(texts: DataFrame) -> DataFrame:
    """(doc_id, fold, plain, token, n): how often each record has each masked token beyond ASCII, and whether it passes the plain checks."""
    return written(beyond_ascii(texts).mapInArrow(_of_records, "doc_id long, fold int, plain boolean, token string, n long"), "tokens")


def paying(records: DataFrame, name: str) -> DataFrame:
    """(doc_id): the records in which a first step pays for itself, reads UTF-8 or fills a gap, by the model's ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = Judges(name, FOLDS)
        for batch in batches:
            given = list(zip(batch.column("column").to_pylist(), batch.column("token").to_pylist()))
            flat = [(c, t, *s) for c, t in given for s in judges[c].first_steps(t)]
            columns = list(zip(*flat)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["column", "token", "step", "gain", "cost"])

    distinct = records.select("column", "token").distinct()
    # Few bytes but much work: spread over all cores.
    spread = distinct.repartition(records.sparkSession.sparkContext.defaultParallelism, "column", "token")
    judged = cut(spread.mapInArrow(run, "column int, token string, step string, gain long, cost long"))
    each = records.join(judged, ["column", "token"])
    return each.groupBy("doc_id", "step", "cost").agg(F.sum(F.col("n") * F.col("gain")).alias("gain")).where("cost = 0 OR gain > cost").select("doc_id").distinct()


def plain_gains(texts: DataFrame, asked: DataFrame, name: str, folded: bool) -> DataFrame:
    """(doc_id, gain, text) of the records asked for, and of others by chance, that pass the plain checks and gain; ``folded``: by the model of the other folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = Judges(name, FOLDS if folded else 1)
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not suspicious(text):
                    gain = round(judges[1 + fold_of(text) if folded else 0].judge(text)[0] * MICRO)
                    if gain > 0:
                        for column, value in zip(out, (doc, gain, text)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "gain", "text"])

    return Bits(asked, "doc_id").marked(beyond_ascii(texts), "doc_id", "asked").where("asked").select("doc_id", "text").mapInArrow(run, "doc_id long, gain long, text string")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, restorable, chain, gain, restored) of every garbled record; ``restored`` is null where bytes are lost."""
    texts = beyond_ascii(documents)
    records = tokens_by_record(texts)
    model, least = train(documents, records)
    name = model.name or sent_rows(documents.sparkSession, [model.rows])
    asked = cut(paying(records.withColumn("column", F.lit(0)), name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(opened(name))
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                gain, chain, restored = judge.judge(text)
                if gain >= least:
                    lost = "\ufffd" in text
                    for column, value in zip(out, (doc, not lost, named(chain), gain, None if lost else mended(text, restored))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.string()))], names=["doc_id", "restorable", "chain", "gain", "restored"])

    # What the filter lets pass by chance is judged like the rest.
    return Bits(asked, "doc_id").marked(texts, "doc_id", "asked").where("asked").select("doc_id", "text").mapInArrow(run, "doc_id long, restorable boolean, chain string, gain double, restored string")
