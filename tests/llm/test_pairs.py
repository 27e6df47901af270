"""Defective pairs: the parts that read a text, and the field's accuracy on held-out rows whose defects are made here."""

import random

import pytest

from sieveline.llm import language, pairs
from tests.helpers import DATA, clashing, rows

import duckdb


@pytest.mark.parametrize(("text", "state"), [("Done.", 0), ("Done", 1), ("Wait ...", 2), ("so…", 2), ("x:\n```\na", 3), ("x:\n```\na\n```", 0), ('He said "no.', 4), ('He said "no."', 0), ("(see also the", 4), ("„so“.", 0), ("“so", 4), ("何です。", 0)])
def test_left_open(text, state):
    assert pairs.left_open(text) == state


@pytest.mark.parametrize(("text", "cut"), [('{"a": 1}', False), ('{"a": "x', True), ('{"a": {"b": 1}', True), ("{A: TRUE}", False), ("plain", False), ("", False), ('{"a": "}"', True)])
def test_json_cut(text, cut):
    assert pairs.json_cut(text) is cut


def test_requested():
    assert pairs.requested("When? Please answer in German.") == {"de"}
    assert pairs.requested("The German office is closed. Why?") == set()
    assert pairs.requested("Merci de répondre en anglais.") == {"en"}


# None of these is among the sentences that the field is trained on.
HELD_REFUSALS = (
    "I'm afraid I cannot help you with that request.", "I am not able to answer this question.", "Sorry, but I can't assist here.", "I have to decline to answer this.", "I would prefer not to comment.",
    "Leider kann ich diese Frage nicht beantworten.", "Je ne peux pas répondre à cette question.", "No puedo responder a esta pregunta.", "Não posso responder a esta pergunta.",
)


@pytest.fixture(scope="module")
def taught():
    con = duckdb.connect()
    docs = con.sql(f"SELECT lower(substr(lang, 1, 2)), text FROM '{DATA.replace('0.001', '0.01')}/documents.parquet' WHERE text IS NOT NULL AND lang IS NOT NULL").fetchall()
    good = con.sql(f"SELECT input, output FROM '{DATA.replace('0.001', '0.01')}/evaluation_rows.parquet' JOIN '{DATA}/projects.parquet' USING (project_id) WHERE task_kind = 'answer' AND input IS NOT NULL AND length(output) > 60 ORDER BY row_id").fetchall()
    languages = language.fit(docs)
    reader = pairs.Reader(languages)
    good = [(q, a) for q, a in good if pairs.left_open(a) == 0 and not pairs.copied(q, a) and reader.tongue(a) and reader.tongue(a) == languages.best(languages.score(q), 4.0)]
    written = [o for (o,) in con.sql(f"SELECT output FROM '{DATA.replace('0.001', '0.01')}/evaluation_rows.parquet' JOIN '{DATA}/projects.parquet' USING (project_id) WHERE task_kind = 'extraction' AND starts_with(output, '{{') ORDER BY row_id LIMIT 300").fetchall()]
    return languages, pairs.trained(good[:1200], [], languages, written), good[1200:1700]


def test_held_out_accuracy(taught):
    languages, field, held = taught
    rng = random.Random(4)
    reader = pairs.Reader(languages)
    questions, answers, expected = [], [], []
    for k, (q, a) in enumerate(held):
        kind = ("none", "copy", "refusal", "language", "truncated", "empty")[k % 6]
        if kind == "copy":
            a = q
        elif kind == "refusal":
            a = rng.choice(HELD_REFUSALS)
        elif kind == "language":
            a = next(o for _, o in rng.sample(held, len(held)) if reader.tongue(o) != reader.tongue(a))
            if pairs.requested(q):
                continue
        elif kind == "truncated":
            a = a[: rng.randrange(20, len(a) - 5)].rstrip(" .!?")
        elif kind == "empty":
            a = rng.choice([None, "", " - ", "...", "\u200b"])
        questions.append(q)
        answers.append(a)
        expected.append(None if kind == "none" else kind)
    got = pairs.defects(questions, answers, ["answer"] * len(questions), field, reader)
    right = sum(g == e for g, e in zip(got, expected)) / len(expected)
    refused = [g for g, e in zip(got, expected) if e == "refusal"]
    assert refused.count("refusal") >= 0.8 * len(refused), refused
    assert right > 0.95, [(e, g, a) for e, g, a in zip(expected, got, answers) if e != g][:10]


def test_tags_decide(taught):
    """Without the field's tags no row has a defect but an empty one."""
    import numpy as np

    languages, field, held = taught
    blank = pairs.Field(np.zeros_like(field.weights), np.zeros_like(field.transitions))
    reader = pairs.Reader(languages)
    given = [(held[0][0], held[0][0], "answer"), ("q", "I can't help with this.", "answer"), ("q", '{"a": "b', "extraction"), ("q", held[0][1][:40], "answer"), ("q", "__", "answer")]
    run = lambda f: pairs.defects([g[0] for g in given], [g[1] for g in given], [g[2] for g in given], f, reader)
    assert run(field) == ["copy", "refusal", "truncated", "truncated", "empty"] and run(blank) == [None, None, None, None, "empty"]


def test_chains_of_any_length():
    rng = random.Random(0)
    words = {0: "alpha beta gamma", 1: "sorry cannot help"}
    made = [([(words[t], 3, (pairs.FIRST_AT,)) for t in tags], tags) for tags in ([rng.randrange(2) for _ in range(n)] for n in (1, 2, 3, 5, 9, 40, 150) for _ in range(6))]
    field = pairs.fit(made, epochs=40)
    assert all(list(got) == tags for got, (_, tags) in zip(field.decode([p for p, _ in made]), made))


def test_kinds_decide_what_applies(taught):
    languages, field, _ = taught
    reader = pairs.Reader(languages)
    q = "Where do I find the setting for the seat planner before Tuesday, please?"
    given = [("billing", "routing", None), ("BILLING", "routing", None), ('{"a": "b"}', "extraction", None), ('{"a": "b', "extraction", "truncated"), (q, "answer", "copy"), (q, "routing", None), (None, None, "empty"), ("{}", "extraction", "empty"), ("I can't help with this.", "routing", "refusal"), ("The overview page has it, next to the", "answer", "truncated"), ("x " * 20_000 + "end.", None, None)]
    got = pairs.defects([q] * len(given), [g[0] for g in given], [g[1] for g in given], field, reader)
    assert [g for g, (_, _, e) in zip(got, given) if e] == [e for _, _, e in given if e]
    assert got[0] is None and got[2] is None


def test_query(spark):
    from sieveline.llm import row_plans

    assert {r.defect for r in row_plans.p4_found(spark, DATA).collect()} <= {"empty", "copy", "refusal", "language", "truncated"}


def test_untrained_and_empty(spark):
    projects = spark.createDataFrame([(1, "answer")], "project_id int, task_kind string")
    documents = spark.createDataFrame([], "doc_id long, text string, lang string")
    df = rows(spark, {"input": "a", "output": None}, {"input": None, "output": "b."}, {"project_id": 9, "input": "a", "output": "-"}, {"project_id": None})
    assert sorted(map(tuple, pairs.broken_pairs(clashing(df), projects, documents).collect())) == [(1, "empty"), (3, "empty"), (4, "empty")]
    assert pairs.broken_pairs(df.limit(0), projects, documents).collect() == []
