"""Operators over documents: the tokenizer's own library, brute force, and texts garbled here."""

import itertools
import random
import re

import duckdb
import pytest

from sieveline.llm import garbled, leaks, text_plans, tokens
from tests.helpers import DATA, clashing, same_as_sql

DOCUMENTS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA.replace('0.001', '0.01')}/documents.parquet'").fetchall()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.NAME}.json")
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_same_ids_as_the_library(texts, library):
    some = [t or "" for t in texts]
    assert tokens.Encoder(f"{tokens.TOKENIZERS}/{tokens.NAME}.tiktoken").encode(some)[0] == library(some)


def test_same_ids_on_odd_texts(library):
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "'ll", "'d", " ", "  ", "\n", "\t", "a", "12", "é", "²", "!", "\u00a0", "\u3000", "日本", "🙏", "ǅ", "\u0301", "Ⅷ", "<|endoftext|>", "\u200b", "\x85", "\x1c", "\r\n", "'M"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["a" * 50_000 + " " * 300 + "x'll" * 2000]
    encoder = tokens.Encoder(f"{tokens.TOKENIZERS}/{tokens.NAME}.tiktoken")
    ids, starts = encoder.encode(some)
    assert ids == library(some)
    for t, s in zip(some, starts):
        assert s == sorted(set(s)) and (s[:1] == [0]) == bool(t)
        assert "".join(t[a:b] for a, b in zip(s, [*s[1:], len(t)])) == t


def test_monoid_is_associative():
    _, table, _, _ = tokens.monoid()
    rng = random.Random(0)
    for _ in range(2000):
        a, b, c = (rng.randrange(len(table)) for _ in range(3))
        assert table[table[a, b], c] == table[a, table[b, c]]


def test_encode_and_decode(spark, texts):
    df = spark.createDataFrame([(1, None, None), (2, "", None), (3, " \n", None), *((k, t, "en") for k, t in enumerate(texts[:80], 10) if t)], DOCUMENTS)
    got = tokens.encode(clashing(df))
    assert {r.doc_id: list(r.ids) for r in got.where("doc_id <= 2").collect()} == {1: [], 2: []}
    assert {r.doc_id: r.text for r in tokens.decode(got).collect()} == {r.doc_id: r.text or "" for r in df.collect()}
    assert tokens.encode(df.limit(0)).collect() == []


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdef" for b in "xyz"] + ["Ruvo", "Telka", "12", "77", "eur"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 9, 10, 14, 25])))) for i in range(12)] + [(90, None), (91, "")]
    docs = [(k, " ".join(rng.choice(words) for _ in range(20))) for k in range(30)]
    for k in range(30, 60):
        w = rng.choice([t for _, t in items if t]).split()
        a = rng.randrange(len(w))
        docs.append((k, "lead in " + ", ".join(w[a : a + rng.choice([9, 10, 12])]).upper() + " out"))
    docs += [(90, None), (91, "")]
    runs = lambda t: {tuple(w[k : k + 10]) for w in [[x.lower() for x in re.findall(r"\w+", t or "")]] for k in range(len(w) - 9)}
    expected = {(i, d) for i, a in items for d, b in docs if runs(a) & runs(b)}
    left = spark.createDataFrame(items, "item_id long, input string")
    right = spark.createDataFrame([(d, t, None) for d, t in docs], DOCUMENTS)
    assert set(map(tuple, leaks.verbatim(leaks.matched(left, clashing(right))).collect())) == expected and expected
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        assert leaks.verbatim(leaks.matched(a, b)).collect() == []


def test_leaks_without_a_filter(spark, monkeypatch):
    left = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, input string")
    right = spark.createDataFrame([(5, "so: One two three four five six seven eight nine TEN", None), (6, "one two three", None)], DOCUMENTS)
    monkeypatch.setattr(leaks, "FILTERED", 0)
    assert [tuple(r) for r in leaks.verbatim(leaks.matched(left, right)).collect()] == [(1, 5)]


def test_changed_slots_must_be_consistent(spark):
    left = spark.createDataFrame([(1, "explain why 20 units of glass cost 55 while 20 others cost nothing at all")], "item_id long, input string")
    same, mixed = "explain why 31 units of glass cost 60 while 31 others cost nothing at all", "explain why 31 units of glass cost 60 while 32 others cost nothing at all"
    right = spark.createDataFrame([(5, same, None), (6, mixed, None), (7, "explain why 20 units of glass cost 55 while 20 others cost nothing at all", None)], DOCUMENTS)
    got = {r.doc_id: r.windows for r in leaks.changed(leaks.matched(left, right)).collect()}
    assert got[5] == 6 and got.get(6, 0) < 6 and 7 not in got


def test_changed_names_every_item_of_a_template(spark):
    left = spark.createDataFrame([(1, "explain why 20 units of glass cost 55 while others cost nothing"), (2, "explain why 40 units of glass cost 80 while others cost nothing at all")], "item_id long, input string")
    right = spark.createDataFrame([(5, "explain why 31 units of glass cost 60 while others cost nothing at all", None)], DOCUMENTS)
    got = {(r.doc_id, r.item_id): r.windows for r in leaks.changed(leaks.matched(left, clashing(right))).collect()}
    assert got == {(5, 1): 3, (5, 2): 5}


def test_names_beyond_what_is_sent(spark, monkeypatch):
    item = "Ask whether old Ruvo paid for seven seats and why young Telka never paid for any of them"
    left = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, input string")
    other = item.replace("Ruvo", "Telka").replace("young Telka", "young Ruvo")
    right = spark.createDataFrame([(5, other, None), (6, item, None), (7, None, None), (8, "nothing of it " * 20, None)], DOCUMENTS)
    run = lambda: (sorted(map(tuple, leaks.changed(leaks.matched(left, clashing(right))).collect())), sorted(map(tuple, leaks.verbatim(leaks.matched(left, right)).collect())))
    few = run()
    assert [r[:2] for r in few[0]] == [(5, 1)] and few[1] == [(1, 6)]
    monkeypatch.setattr(leaks, "NAMES", 0)
    assert run() == few


@pytest.fixture(scope="module")
def learned(texts):
    return garbled.learned([t for t in texts if t])


def test_garbled_texts_are_restored(learned, texts):
    model, margin = learned
    judge = garbled.Judge(model)
    clean = [t for t in texts if t and not t.isascii() and not garbled.suspicious(t)]
    assert sum(judge.judge(t)[0] >= margin for t in clean) <= 0.005 * len(clean) + 3
    tried = found = whole = 0
    for read, written in (("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("mac-roman", "utf-8"), ("cp1251", "utf-8")):
        for t in clean[:150]:
            try:
                bad = t.encode(written).decode(read)
            except UnicodeDecodeError:
                continue
            tried += 1
            gain, _, restored = judge.judge(bad)
            found += gain >= margin
            whole += garbled.mended(bad, restored) == t
    assert tried > 300 and found > 0.97 * tried and whole > 0.9 * tried, (tried, found, whole)


def test_twice_garbled_texts_are_restored(learned, texts):
    judge = garbled.Judge(learned[0])
    clean = [t[:600] for t in texts if t and not t.isascii() and not garbled.suspicious(t) and judge.judge(t)[0] < learned[1]]
    for steps in ((("latin-1", "utf-8"), ("cp1252", "utf-8")), (("cp437", "cp1250"), ("mac-roman", "utf-8"))):
        tried = whole = 0
        for t in clean[:60]:
            bad = t
            try:
                for read, written in steps:
                    bad = bad.encode(written).decode(read)
            except UnicodeError:
                continue
            _, _, restored = judge.judge(bad)
            tried += 1
            whole += garbled.mended(bad, restored) == t
        assert tried > 5 and whole > 0.7 * tried, (steps, tried, whole)


def test_margin_is_validated_on_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(garbled, "learned", lambda texts: texts)
    text = "a few words " * 3000
    assert garbled.train(spark.createDataFrame([(1, text, None), (2, " ", None)], DOCUMENTS)) == [text]


def test_all_records_train_and_are_held_out(spark, monkeypatch):
    # More records than were once sampled; the three letters of each are its own.
    own = ["".join(x) for x in itertools.islice(itertools.product("abcdefghijklmnopqrst", repeat=3), 7000)]
    odd = ["M\u00dcLLER PR\u00dcFT F\u00dcR UNS"] * 40 + ["\u00c9T\u00c9 \u00c0 NO\u00cbL 12 34"] * 40 + ["9 8 7", " ", None, "jusqu\ufffd mardi"]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(own + odd)], DOCUMENTS)
    asked = []
    learned = garbled.learned
    monkeypatch.setattr(garbled, "learned", lambda given: asked.append(len(given)) or learned(given))
    here = garbled.train(df)
    monkeypatch.setattr(garbled, "LOCAL_CHARS", 0)
    for few in (garbled.COUNTED_TOKENS, garbled.COUNTED_GRAMS), (100, 500):
        monkeypatch.setattr(garbled, "COUNTED_TOKENS", few[0])
        monkeypatch.setattr(garbled, "COUNTED_GRAMS", few[1])
        apart = garbled.train(clashing(df))
        assert (bytes(apart[0].rows), apart[1]) == (here[0].rows, here[1])
    assert asked == [len(own) + len(odd) - 2]
    assert all(here[0].count(ord(a) << 42 | ord(b) << 21 | ord(c)) == 1 for a, b, c in own)
    assert here[0].count(garbled.TEXTS) == len(own) + len(odd) - 3


def test_same_model_at_any_size(spark, texts, monkeypatch):
    learned = garbled.learned([t for t in texts if t and t.strip()])
    monkeypatch.setattr(garbled, "LOCAL_CHARS", 0)
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], DOCUMENTS)
    model, margin = garbled.train(df)
    assert bytes(model.rows) == learned[0].rows and margin == learned[1]


def test_gain_at_a_place(spark):
    given = [5, 7, 7, 999, 1000, 1_000_000, 3_000_001, 3_000_000, 12_345_678_901]
    df = spark.createDataFrame([(g,) for g in given], "gain long")
    assert [garbled.nth_gain(df, k) for k in range(11)] == [*sorted(given, reverse=True), 0, 0]


def test_garbled_rows(spark, texts):
    base = [t for t in texts if t and not garbled.suspicious(t)][:400]
    odd = [(1001, None), (1002, ""), (1003, "plain"), (1004, "caf&eacute; %C3%A9 \\u00e9"), (1005, "jusqu\ufffd mardi"), (1006, "M\u00c3\u00bcller, pr\u00c3\u00bcfen f\u00c3\u00bcr"), (1007, "M\u00c3\u00bcller, pr\u00c3\u00bcfen f\u00c3\u00bcr")]
    df = spark.createDataFrame([(k, t, None) for k, t in [*enumerate(base), *odd]], DOCUMENTS)
    got = {r.doc_id: (r.restorable, r.restored) for r in garbled.judged(clashing(df)).where("doc_id > 1000").collect()}
    assert got == {1005: (False, None), 1006: (True, "Müller, prüfen für"), 1007: (True, "Müller, prüfen für")}
    assert garbled.judged(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(text_plans.SQL))
def test_same_as_sql(spark, name):
    same_as_sql(spark, text_plans.QUERIES[name], text_plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(text_plans.QUERIES) - set(text_plans.SQL)))
def test_queries_run(spark, name):
    text_plans.QUERIES[name](spark, DATA).collect()
