"""Languages of texts by the letter trigrams of their words, with a model trained on labelled documents.

A word's vector is the sum of the log probabilities of its trigrams per language (additive smoothing); a text's
vector is the sum of its words' vectors. Training uses a bounded sample: of each language the TEXTS_EACH labelled texts of lowest hash priority, whole.
A label is a code of two letters, of which there are at most 676. A few texts with a wrong label weigh little: probabilities are smoothed by what a label has.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.priority import priority

#: Labelled texts of each language that the model is fitted on, chosen by hash.
TEXTS_EACH = 400
_WORD = re.compile(r"[^\W\d_]+")
CACHED = 300_000


class Languages:
    def __init__(self, names: list[str], grams: dict[str, np.ndarray], floor: np.ndarray):
        self.names, self.grams, self.floor, self.known = names, grams, floor, {}

    def word(self, w: str) -> np.ndarray:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > CACHED:
                self.known.clear()
            p = f"^{w}$"
            got = self.known[w] = sum((self.grams.get(p[k : k + 3], self.floor) for k in range(len(p) - 2)), np.zeros(len(self.names), np.float32))
        return got

    def score(self, text: str) -> np.ndarray:
        """Log likelihoods by language; zero without words."""
        total = np.zeros(len(self.names), np.float32)
        for w in _WORD.findall(text.lower()):
            total += self.word(w)
        return total

    def best(self, score: np.ndarray, margin: float) -> str | None:
        """The likeliest language, or None if it leads by less than ``margin``."""
        if len(score) < 2:
            return None
        values = score.tolist()
        k = values.index(max(values))
        lead = values[k]
        values[k] = float("-inf")
        return self.names[k] if lead - max(values) >= margin else None

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log likelihoods of many texts at once, a row each."""
        words = [_WORD.findall(t.lower()) for t in texts]
        distinct = sorted({w for ws in words for w in ws})
        out = np.zeros((len(texts), len(self.names)), np.float32)
        if not distinct or not self.names:
            return out
        at = {w: i for i, w in enumerate(distinct)}
        table = np.stack([self.word(w) for w in distinct])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = table[np.fromiter((at[w] for ws in words for w in ws), np.int64, int(lengths.sum()))]
        some = np.flatnonzero(lengths)
        out[some] = np.add.reduceat(flat, (np.cumsum(lengths) - lengths)[some], axis=0)
        return out

    def __getstate__(self):
        return {"names": self.names, "grams": self.grams, "floor": self.floor, "known": {}}


def fit(labelled: list[tuple[str, str]]) -> Languages:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in labelled:
        for w in _WORD.findall(text.lower()):
            p = f"^{w}$"
            counts[lang].update(p[k : k + 3] for k in range(len(p) - 2))
    names = sorted(counts)
    vocabulary = sorted(set().union(*counts.values())) if counts else []
    totals = np.array([sum(counts[n].values()) for n in names], np.float64)
    floor = np.log(0.1 / (totals + 0.1 * (len(vocabulary) + 1))) if names else np.zeros(0)
    table = np.array([[counts[n][g] for n in names] for g in vocabulary], np.float64).reshape(len(vocabulary), len(names))
    logs = np.log((table + 0.1) / (totals + 0.1 * (len(vocabulary) + 1))).astype(np.float32)
    return Languages(names, dict(zip(vocabulary, logs)), floor.astype(np.float32))


def train(documents: DataFrame, each: int = TEXTS_EACH) -> Languages:
    """Fit on at most ``each`` documents of a language, chosen by hash; labels are read without case and region."""
    lang = F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2})(?:[-_].*)?\s*$", 1))
    kept = documents.where("text IS NOT NULL").select(lang.alias("lang"), "doc_id", priority("language-1", F.col("doc_id")).alias("priority")).where("lang <> ''")
    # Each task passes on its first ones of a language, without their texts.
    chosen = kept.withColumn("_at", F.row_number().over(Window.partitionBy("lang").orderBy("priority", "doc_id"))).where(F.col("_at") <= each).select("doc_id", "lang", "priority")
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    return fit([(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.priority, r.doc_id))])
