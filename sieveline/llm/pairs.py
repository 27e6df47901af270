"""Defective pairs of question and answer, by a conditional random field over the clauses of the answer.

The answer is cut into clauses; a linear-chain conditional random field tags each as answer, refusal, echo, foreign or
unfinished; the words covered by each tag decide the pair's defect: none at all for an empty answer, more than half for a refusal or another
language or a copy, and any unfinished clause for a truncated answer. Where a defect is defined exactly (copy, cut JSON), what the tags
propose is checked. Its features are the clause's words and its end
(both hashed), the share of its three-word runs that the question has, its language against the question's, and what the
text leaves open at its end.

It is trained here, without hand labels, on a bounded sample of rows, taken whole: answers (``TRAINING_ROWS``, by hash) are kept, cut, replaced by their own
question or by an answer in another language; JSON (``JSON_ROWS``) is kept or cut; refusals are prose in projects whose proper outputs are labels or
JSON, together with the few written below, which name the ways of declining in each language. Each tag is thus known by construction.

Defined results: null, empty and unlettered outputs are ``empty``; a row whose project is unknown can be ``empty`` or
``refusal`` only; repeated rows get the same tag; texts are taken whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import language
from sieveline.operators.priority import first, priority

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
TRAINING_ROWS, REFUSAL_ROWS, JSON_ROWS, EPOCHS, HASHED = 3000, 600, 600, 80, 1 << 13
COVERED = 0.5
CACHED_CLAUSES = 200_000

# Refusals in the languages of the texts, always part of the training.
REFUSALS = (
    "I can't help with this.", "I am unable to answer that question.", "I must decline to respond.", "Sorry, I cannot assist with that.", "I am not allowed to discuss this.",
    "I would rather not comment on this topic.", "I would prefer not to say anything about it.", "I won't be able to provide that.", "My guidelines do not permit me to answer.", "As an assistant I cannot answer this.",
    "Dabei kann ich leider nicht helfen.", "Dazu möchte ich mich nicht äußern.", "Diese Frage darf ich nicht beantworten.",
    "Je ne peux pas vous aider.", "Je préfère ne pas répondre.", "Je préfère ne pas commenter ce sujet.", "Je ne suis pas autorisé à répondre.",
    "No puedo ayudar con eso.", "Prefiero no responder.", "Prefiero no comentar este tema.", "No estoy autorizado a responder.",
    "Não posso ajudar com isso.", "Prefiro não responder.", "Prefiro não comentar este tema.", "Não estou autorizado a responder.",
)
# What a sentence cannot end with, for cut answers.
JOINING = (" and", " but", " because", ", which", " since", " or", " the", " und", " et", " y", " e")
# Stems of language names, by language asked for.
LANGUAGE_STEMS = {
    "en": ("english", "englisch", "anglais", "inglés", "ingles", "inglês", "inglese", "angielsk", "английск", "英語"),
    "de": ("german", "deutsch", "allemand", "alemán", "aleman", "alemão", "niemieck", "немецк", "ドイツ語"),
    "fr": ("french", "französisch", "français", "francais", "francés", "francês", "francuski", "французск", "フランス語"),
    "es": ("spanish", "spanisch", "espagnol", "español", "espanol", "espanhol", "hiszpańsk", "испанск", "スペイン語"),
    "pt": ("portuguese", "portugiesisch", "portugais", "portugués", "português", "portugalsk", "португальск", "ポルトガル語"),
    "ja": ("japanese", "japanisch", "japonais", "japonés", "japonês", "japońsk", "японск", "日本語"),
    "ru": ("russian", "russisch", "russe", "ruso", "russo", "rosyjsk", "русск", "ロシア語"),
    "pl": ("polish", "polnisch", "polonais", "polaco", "polonês", "polsk", "польск", "ポーランド語"),
}
ASKS = re.compile(r"(answer|reply|replie|respon|write|antwort|schreib|répon|repon|écri|contest|escrib|escrev|odpowie|ответ|答え|回答)[^.!?\n]{0,40}$")

# A line end inside a sentence is white space like any other.
_CLAUSE = re.compile(r"(?<=[.!?;…。！？])\s+|\n\s*\n|\n(?=```)")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_WORDS = re.compile(r"\w+")
_WORTH = re.compile(r"[^\W_]")
_ENDED = re.compile(r"(?:[.!?。！？][\"'”’»)\]]*|```|[”»\")\]}])\s*$")
_ELLIPSIS = re.compile(r"(?:\.{2,}|…)[\"'”’»)\]]*\s*$")


def clauses(text: str) -> list[str]:
    return [c for c in (x.strip() for x in _CLAUSE.split(text)) if c]


def _runs(text: str) -> set[tuple[str, ...]]:
    w = _WORDS.findall(text.lower())
    return set(zip(w, w[1:], w[2:]))


def copied(question: str, answer: str) -> bool:
    """At least 80 % of the answer's distinct three-word runs occur in the question."""
    a = _runs(answer)
    return bool(a) and len(a & _runs(question)) * 100 >= 80 * len(a)


def left_open(text: str) -> int:
    """What the end of a text leaves open: 0 nothing, 1 no final mark, 2 an ellipsis, 3 a code block, 4 a bracket or quotation."""
    t = text.rstrip()
    if _ELLIPSIS.search(t):
        return 2
    if t.count("```") % 2:
        return 3
    prose = re.sub(r"```.*?```", " ", t, flags=re.S)
    if prose.count("(") > prose.count(")") or prose.count("[") > prose.count("]") or prose.count("{") > prose.count("}") or prose.count('"') % 2 or (prose.count("„") > prose.count("“") if "„" in prose else prose.count("“") > prose.count("”")) or prose.count("«") > prose.count("»"):
        return 4
    return 0 if _ENDED.search(t) else 1


def json_cut(text: str) -> bool:
    """Whether a text opens a JSON value and ends before it is closed."""
    t = text.strip()
    if not t or t[0] not in "{[":
        return False
    try:
        json.loads(t)
        return False
    except (ValueError, RecursionError):
        pass
    depth, inside, escaped = 0, False, False
    for ch in t:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
    return inside or depth > 0


def requested(question: str) -> set[str]:
    """Languages that a question asks to be answered in."""
    q = question.lower()
    found = set()
    for lang, stems in LANGUAGE_STEMS.items():
        for stem in stems:
            at = q.find(stem)
            while at >= 0:
                if ASKS.search(q[max(0, at - 60) : at]):
                    found.add(lang)
                at = q.find(stem, at + 1)
    return found


def _hash(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) % HASHED


def lexical(masked: str) -> list[int]:
    return sorted({_hash("w" + w) for w in masked.split()})


def ending(masked: str) -> list[int]:
    t = masked.split()
    return [_hash("e1 " + " ".join(t[-1:])), _hash("e2 " + " ".join(t[-2:])), _hash("e3 " + " ".join(t[-3:]))]


# Context features follow the hashed ones: echo bins, language relations, what is left open (last clause), first and last.
ECHO_AT, LANG_AT, OPEN_AT, FIRST_AT, LAST_AT = HASHED, HASHED + 4, HASHED + 8, HASHED + 13, HASHED + 14
FEATURES = HASHED + 15


class Clause(NamedTuple):
    """What is known of a clause by itself."""

    masked: str
    score: np.ndarray
    tongue: str | None


class Reader:
    """Clauses and features of pairs; what depends on a clause alone is kept by its masked text."""

    def __init__(self, languages: language.Languages):
        self.languages, self.seen = languages, {}

    def clause(self, text: str) -> Clause:
        masked = _NUMBER.sub("0", text.lower())
        got = self.seen.get(masked)
        if got is None:
            if len(self.seen) > CACHED_CLAUSES:
                self.seen.clear()
            score = self.languages.score(masked)
            got = self.seen[masked] = Clause(masked, score, self.languages.best(score, 6.0))
        return got

    def tongue(self, text: str) -> str | None:
        return self._whole([self.clause(c) for c in clauses(text)])

    def _whole(self, read: list[Clause]) -> str | None:
        if len({c.tongue for c in read}) == 1 and read[0].tongue:
            return read[0].tongue
        return self.languages.best(sum((c.score for c in read), np.zeros(len(self.languages.names))), 3.0)

    def pairs(self, questions: list[str], answers: list[str], compare: list[bool]) -> list[list[tuple[str, int, tuple[int, ...]]]]:
        """(masked clause, words, context features) for each clause of each answer."""
        scores = self.languages.scores([q if c else "" for q, c in zip(questions, compare)])
        return [self._pair(q, a, c, s) for q, a, c, s in zip(questions, answers, compare, scores)]

    def _pair(self, question: str, answer: str, compare: bool, score: np.ndarray) -> list[tuple[str, int, tuple[int, ...]]]:
        parts = clauses(answer)
        read = [self.clause(p) for p in parts]
        runs: set = set()
        expected: set[str | None] = set()
        whole = None
        if compare and parts:
            runs = _runs(question)
            own = self.languages.best(score, 4.0)
            if own:
                whole = self._whole(read)
                expected = {own}
                if whole != own or any(c.tongue != own for c in read):
                    expected |= requested(question)
        out, last = [], len(parts) - 1
        for i, (part, known) in enumerate(zip(parts, read)):
            words = _WORDS.findall(part.lower())
            shared = 0.0
            if runs and len(words) > 2:
                mine = set(zip(words, words[1:], words[2:]))
                shared = len(mine & runs) / len(mine)
            tongue = (known.tongue or whole) if expected else None
            context = [
                ECHO_AT + (3 if shared >= 0.8 else 2 if shared >= 0.4 else 1 if shared > 0 else 0),
                LANG_AT + (0 if tongue is None else 1 if tongue in expected else 2 if whole not in expected else 3),
            ]
            if i == 0:
                context.append(FIRST_AT)
            if i == last:
                context += [LAST_AT, OPEN_AT + left_open(answer)]
            out.append((known.masked, len(words), tuple(context)))
        return out


class Field:
    """Linear-chain conditional random field: feature weights (FEATURES x tags) and transitions."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions, self.known, self.contexts = weights, transitions, {}, {}

    def __getstate__(self):
        return {"weights": self.weights, "transitions": self.transitions, "known": {}, "contexts": {}}

    def context(self, features: tuple[int, ...]) -> np.ndarray:
        got = self.contexts.get(features)
        if got is None:
            got = self.contexts[features] = self.weights[list(features)].sum(axis=0)
        return got

    def lexical(self, masked: str) -> tuple[np.ndarray, np.ndarray]:
        got = self.known.get(masked)
        if got is None:
            if len(self.known) > CACHED_CLAUSES:
                self.known.clear()
            got = self.known[masked] = (self.weights[lexical(masked)].sum(axis=0), self.weights[ending(masked)].sum(axis=0))
        return got

    def emissions(self, pair: list[tuple[str, int, tuple[int, ...]]]) -> np.ndarray:
        out = np.empty((len(pair), len(TAGS)), np.float64)
        for i, (masked, _, context) in enumerate(pair):
            words, end = self.lexical(masked)
            out[i] = words + self.context(context)
            if i == len(pair) - 1:
                out[i] += end
        return out

    def decode(self, pairs: list[list]) -> list[np.ndarray]:
        """Best tags of each pair; pairs of equal length are decoded together."""
        result: list[np.ndarray] = [np.empty(0, np.int64)] * len(pairs)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(pairs):
            by_length.setdefault(len(p), []).append(k)
        for length, ks in by_length.items():
            if not length:
                continue
            e = np.stack([self.emissions(pairs[k]) for k in ks])
            score, back = e[:, 0], []
            for i in range(1, length):
                step = score[:, :, None] + self.transitions[None]
                back.append(step.argmax(axis=1))
                score = step.max(axis=1) + e[:, i]
            tags = np.empty((len(ks), length), np.int64)
            tags[:, -1] = score.argmax(axis=1)
            for i in range(length - 2, -1, -1):
                tags[:, i] = back[i][np.arange(len(ks)), tags[:, i + 1]]
            for k, t in zip(ks, tags):
                result[k] = t
        return result


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class _Chains:
    """Examples of about one length as arrays: the gold tags, and which feature stands at which place."""

    def __init__(self, part: list[tuple[list, list[int]]]):
        self.n, self.longest = len(part), max(len(p) for p, _ in part)
        tag = np.full((self.n, self.longest), -1)
        feature, owner = [], []
        for k, (pair, tags) in enumerate(part):
            tag[k, : len(tags)] = tags
            for i, (masked, _, context) in enumerate(pair):
                f = lexical(masked) + list(context) + (ending(masked) if i == len(pair) - 1 else [])
                feature += f
                owner += [k * self.longest + i] * len(f)
        self.feature, self.owner, self.there = np.array(feature), np.array(owner), tag >= 0
        self.gold = np.zeros((self.n, self.longest, len(TAGS)))
        self.gold[self.there] = np.eye(len(TAGS))[tag[self.there]]
        self.steps = np.einsum("nip,niq->pq", self.gold[:, :-1], self.gold[:, 1:])

    def gradient(self, weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood, by forward and backward sums in log space over padded chains."""
        T, n, longest, there = len(TAGS), self.n, self.longest, self.there
        e = np.stack([np.bincount(self.owner, weights[self.feature, t], n * longest) for t in range(T)], axis=1).reshape(n, longest, T)
        alpha = [e[:, 0]]
        for i in range(1, longest):
            a = _logsumexp(alpha[-1][:, :, None] + trans[None], 1) + e[:, i]
            alpha.append(np.where(there[:, i, None], a, alpha[-1]))
        beta = [np.zeros((n, T))]
        for i in range(longest - 2, -1, -1):
            b = _logsumexp(trans[None] + (e[:, i + 1] + beta[-1])[:, None, :], 2)
            beta.append(np.where(there[:, i + 1, None], b, 0.0))
        beta.reverse()
        z = _logsumexp(alpha[-1], 1)
        node = np.stack([np.exp(a + b - z[:, None]) for a, b in zip(alpha, beta)], axis=1) * there[:, :, None]
        pairs = np.zeros((T, T))
        for i in range(1, longest):
            p = np.exp(alpha[i - 1][:, :, None] + trans[None] + (e[:, i] + beta[i])[:, None, :] - z[:, None, None])
            pairs += (p * there[:, i, None, None]).sum(axis=0)
        gap = (self.gold - node).reshape(-1, T)[self.owner]
        return np.stack([np.bincount(self.feature, gap[:, t], FEATURES) for t in range(T)], axis=1), self.steps - pairs


def fit(examples: list[tuple[list, list[int]]], epochs: int = EPOCHS, ridge: float = 2e-4) -> Field:
    """Maximum likelihood with a ridge, by Adam over all examples; chains of any length, in groups whose lengths differ by less than twice."""
    weights, trans = np.zeros((FEATURES, len(TAGS))), np.zeros((len(TAGS), len(TAGS)))
    groups: dict[int, list] = {}
    for x in examples:
        if x[0]:
            groups.setdefault(len(x[0]).bit_length(), []).append(x)
    if not groups:
        return Field(weights, trans)
    chains = [_Chains(groups[k]) for k in sorted(groups)]
    n = sum(c.n for c in chains)
    m = [np.zeros_like(weights), np.zeros_like(trans)]
    v = [np.zeros_like(weights), np.zeros_like(trans)]
    for epoch in range(1, epochs + 1):
        parts = [c.gradient(weights, trans) for c in chains]
        for k, p in enumerate((weights, trans)):
            g = sum(part[k] for part in parts) / n - ridge * p
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p += 0.1 * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
    return Field(weights, trans)


def structured(outputs: list[str], reader: Reader, seed: int = 11) -> list[tuple[list, list[int]]]:
    """JSON outputs whose last clause is known to be whole or unfinished: every other one is cut somewhere."""
    rng = np.random.default_rng(seed)
    good = [o for o in outputs if o.lstrip()[:1] in ("{", "[") and not json_cut(o)]
    made = [o[: int(rng.integers(1, max(2, len(o.rstrip()))))] if k % 2 else o for k, o in enumerate(good)]
    out = []
    for p, text in zip(reader.pairs([""] * len(made), made, [False] * len(made)), made):
        out.append((p, [ANSWER] * (len(p) - 1) + [UNFINISHED if json_cut(text) else ANSWER]))
    return [x for x in out if x[0]]


def examples(answers: list[tuple[str, str]], refusals: list[str], reader: Reader, seed: int = 7) -> list[tuple[list, list[int]]]:
    """Pairs whose tags are known because they are made here: kept, cut, echoed, foreign and refused answers.

    Real answers that are open at their end, copied, foreign or made of clauses known from refusals are left out.
    """
    rng = np.random.default_rng(seed)
    refusals = [*refusals, *REFUSALS]
    refusing = {reader.clause(c).masked for r in refusals for c in clauses(r)}
    good = []
    for (q, a), p in zip(answers, reader.pairs([q for q, _ in answers], [a for _, a in answers], [True] * len(answers))):
        if p and left_open(a) == 0 and not copied(q, a) and all(LANG_AT + 2 not in c and m not in refusing for m, _, c in p):
            good.append((q, a, reader.tongue(a)))
    if not good:
        return []
    made: list[tuple[str, str, int, bool]] = []
    for q, a, tongue in good:
        kind = rng.random()
        if kind < 0.18:
            end = int(rng.integers(max(1, len(a) // 6), max(2, len(a))))
            cut_at = a[:end].rstrip() if rng.random() < 0.6 else a[:end].rsplit(" ", 1)[0] + ("" if rng.random() < 0.5 else " …" if rng.random() < 0.5 else JOINING[int(rng.integers(len(JOINING)))])
            # Cut just behind a full clause, the text is whole.
            whole = a.startswith(cut_at) and (cut_at == a or a[len(cut_at) :][:1].isspace()) and re.search(r"[.!?。]$", cut_at) is not None and left_open(cut_at) == 0
            made.append((q, cut_at, ANSWER, not whole))
        elif kind < 0.28:
            made.append((q, q if rng.random() < 0.7 else "You asked: " + q, ECHO, False))
        elif kind < 0.40:
            others = (good[int(rng.integers(len(good)))] for _ in range(30))
            other = next((o for o in others if o[2] and tongue and o[2] != tongue and o[2] not in requested(q)), None)
            made.append((q, other[1], FOREIGN, False) if other else (q, a, ANSWER, False))
        elif kind < 0.55:
            made.append((q, refusals[int(rng.integers(len(refusals)))], REFUSAL, False))
        else:
            made.append((q, a, ANSWER, False))
    out = []
    for p, (_, _, tag, cut) in zip(reader.pairs([m[0] for m in made], [m[1] for m in made], [True] * len(made)), made):
        tags = [tag] * len(p)
        if cut and tags:
            tags[-1] = UNFINISHED
        out.append((p, tags))
    return out


def trained(answers: list[tuple[str, str]], refusals: list[str], languages: language.Languages, outputs: list[str] = []) -> Field:  # noqa: B006
    """Fit in two steps: a field of one half of the answers strikes those of the other half that it takes for refusals, then all are fitted."""
    reader = Reader(languages)
    kept = []
    for k in (0, 1):
        judge = fit(examples(answers[k::2], refusals, reader), epochs=EPOCHS // 2)
        mine = answers[1 - k :: 2]
        tags = judge.decode(reader.pairs([q for q, _ in mine], [a for _, a in mine], [True] * len(mine)))
        kept += [x for x, t in zip(mine, tags) if not len(t) or (t == REFUSAL).mean() <= COVERED]
    return fit(examples(kept, refusals, reader) + structured(outputs, reader))


def _in_order(rows: DataFrame) -> list:
    return sorted(rows.collect(), key=lambda r: (r.priority, r.row_id))


def train(rows: DataFrame, kinds: DataFrame, languages: language.Languages) -> Field:
    """Fit the field on a bounded sample of ``rows`` (joined with their project's kind), chosen by hash."""
    picked = rows.join(kinds, "project_id").select("row_id", "input", "output", "task_kind", priority("pairs-1", F.col("row_id")).alias("priority")).where("output IS NOT NULL AND input IS NOT NULL")
    answers = _in_order(first(picked.where("task_kind = 'answer'"), TRAINING_ROWS, "row_id"))
    prose = picked.where("task_kind IN ('routing', 'extraction')").where(F.col("output").rlike(r"\p{L}+ +\p{L}+ +\p{L}+") & ~F.col("output").rlike(r"^\s*[\{\[\"]"))
    refused = _in_order(first(prose, REFUSAL_ROWS, "row_id"))
    written = _in_order(first(picked.where("task_kind = 'extraction'").where(F.col("output").rlike(r"^\s*[\{\[]")), JSON_ROWS, "row_id"))
    return trained([(r.input, r.output) for r in answers], [r.output for r in refused], languages, [r.output for r in written])


def coverage(pair: list, tags: np.ndarray, answer: str) -> np.ndarray:
    """The share of an answer's words that each tag covers; all zero for an answer without a letter or digit."""
    if not len(pair) or not _WORTH.search(answer):
        return np.zeros(len(TAGS))
    words = np.array([max(1, w) for _, w, _ in pair])
    return np.bincount(tags, words, len(TAGS)) / words.sum()


def defects(questions: list[str], answers: list[str | None], kinds: list[str | None], field: Field, reader: Reader) -> list[str | None]:
    """The first defect of each pair, or None, from the coverage of its tags."""
    made = reader.pairs([q or "" for q in questions], [a or "" for a in answers], [k == "answer" for k in kinds])
    out: list[str | None] = []
    for q, a, kind, pair, tags in zip(questions, answers, kinds, made, field.decode(made)):
        a = a or ""
        covered = coverage(pair, tags, a)
        proper = kind == "extraction" and a.lstrip()[:1] in ("{", "[") or kind == "routing" and len(_WORDS.findall(a)) <= 2
        if not covered.any():
            out.append("empty")
        elif kind == "answer" and covered[ECHO] > COVERED and copied(q or "", a):
            out.append("copy")
        elif not proper and covered[REFUSAL] > COVERED:
            out.append("refusal")
        elif kind == "answer" and covered[FOREIGN] > COVERED:
            out.append("language")
        elif covered[UNFINISHED] > 0 and (kind == "answer" or kind == "extraction" and json_cut(a)):
            out.append("truncated")
        else:
            out.append(None)
    return out


def broken_pairs(rows: DataFrame, projects: DataFrame, documents: DataFrame) -> DataFrame:
    """(row_id, defect) of each defective pair. ``documents`` has texts with their language, to train the language model."""
    spark = rows.sparkSession
    kinds = projects.select("project_id", "task_kind").dropDuplicates(["project_id"])
    languages = language.train(documents)
    model = spark.sparkContext.broadcast((train(rows, kinds, languages), languages))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, known = model.value
        reader = Reader(known)
        for batch in batches:
            found = defects(*(batch.column(c).to_pylist() for c in ("input", "output", "task_kind")), field, reader)
            keep = pa.array([d is not None for d in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(found, pa.string())], names=["row_id", "defect"]).filter(keep)

    return rows.join(kinds, "project_id", "left").select("row_id", "input", "output", "task_kind").mapInArrow(tag, "row_id long, defect string")
