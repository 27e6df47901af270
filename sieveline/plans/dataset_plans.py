"""Queries of the dataset checks, each dataset a project, with their SQL."""

from __future__ import annotations

from sieveline.functions import vocabulary as V
from sieveline.operators import dataset as D
from sieveline.session import table

NAMES = (
    "normalized_identity", "token_stats", "duplicate_groups", "duplicate_summary", "similar_classes", "similar_pairs", "split_overlap", "split_sizes", "split_vocabulary", "holdout_resolution",
    "question_cap", "row_bounds", "family_offset", "family_partition", "duplicate_ids", "missing_ids", "id_digests", "provenance_counts", "unrecognised_words", "provenance_points",
    "label_counts", "placeholder_outputs", "answer_dominance", "distinct_outputs", "outcome_fields", "input_types", "difficulty_coverage", "scenario_coverage", "size_gates", "check_report", "check_report_whole", "row_count_bounds",
)


def _query(name):
    def run(spark, d):
        out = getattr(D, name)(table(spark, d, "evaluation_rows"))
        return out.drop("n", "m", "k") if name == "_" else out

    run.__name__ = name
    run.__doc__ = getattr(D, name).__doc__
    return run


QUERIES = {n: _query(n) for n in NAMES}

#: White space as both engines are told to see it.
SPACES = " \t\n\x0b\f\r\x85\xa0                　"


def fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def words(x: str) -> str:
    return rf"regexp_extract_all({fold(x)}, '[\p{{L}}\p{{N}}_]+')"


def strip(x: str) -> str:
    return f"trim({x}, '{SPACES}')"


def identity(x: str) -> str:
    w = f"array_to_string({words(x)}, ' ')"
    return f"CASE WHEN {w} <> '' THEN {w} ELSE lower({strip(x)}) END"


def side(x: str) -> str:
    return f"CASE WHEN lower({strip(x)}) IN ('tune','tuning','train','search') THEN 'tuning' WHEN lower({strip(x)}) IN ('holdout','held-out','heldout','held_out','test','validation','validate') THEN 'heldout' END"


def _starts(names) -> str:
    return "(" + " OR ".join(f"starts_with(w, '{n}')" for n in names) + ")"


_UNDECLARED = ", ".join(f"'{w}'" for w in V.UNDECLARED)


def origin(x: str) -> str:
    w = f"lower({strip(x)})"
    return f"(CASE WHEN {x} IS NULL OR {w} = '' OR {w} IN ({_UNDECLARED}) THEN 'undeclared' WHEN {_starts(V.SYNTHESISED).replace('(w,', f'({w},')} THEN 'synthesised' WHEN {_starts(V.COLLECTED).replace('(w,', f'({w},')} THEN 'collected' ELSE 'undeclared' END)"


def recognised(x: str) -> str:
    w = f"lower({strip(x)})"
    return f"({x} IS NULL OR {w} = '' OR {w} IN ({_UNDECLARED}) OR {_starts((*V.SYNTHESISED, *V.COLLECTED)).replace('(w,', f'({w},')})"


def origin_flag(x: str, kind: str) -> str:
    return f"({origin(x)} = '{kind}')"


_ROWS = f"""a AS (SELECT *, coalesce(nullif(metadata['provenance'], ''), nullif(source, ''), nullif(metadata['source'], '')) AS prov,
  coalesce(nullif(metadata['output_provenance'], ''), nullif(output_source, ''), nullif(metadata['output_source'], '')) AS oprov,
  coalesce({strip('output')} <> '', false) AS lab, coalesce(split, metadata['split']) AS sp, {words('input')} AS ws FROM evaluation_rows),
r AS (SELECT *, {side('sp')} AS side, array_to_string(ws, ' ') AS nt, {identity('input')} AS ident, {origin('prov')} AS orig, {origin('oprov')} AS oorig,
  replace(lower(coalesce(nullif(coalesce(difficulty, metadata['difficulty']), ''))), '_', '-') AS band, nullif(coalesce(coverage, metadata['coverage']), '') AS cov FROM a),
u AS (SELECT * FROM r WHERE input IS NOT NULL AND lab)"""

_DOM = "CASE WHEN m * 10 >= n * 9 THEN 'WARN' WHEN n < 2 * k THEN 'SKIP' WHEN 3 * (m * k - n) >= n * (k - 1) THEN 'WARN' ELSE 'PASS' END AS status"

_DRAW = """g AS (SELECT project_id, md5(input) AS i, count(*) FILTER (side = 'tuning') AS t, count(*) AS n FROM u GROUP BY ALL),
h AS (SELECT project_id, max(t) > 0 AS tuned FROM g GROUP BY 1),
d AS (SELECT project_id, i, CASE WHEN tuned THEN t ELSE n END AS n_rows, CASE WHEN tuned THEN 'tuning' ELSE 'dataset' END AS scope FROM g JOIN h USING (project_id) WHERE CASE WHEN tuned THEN t ELSE n END > 0),
cap AS (SELECT project_id, scope, least(18, count(*) FILTER (run <= 18)) AS questions, count(*) AS distinct_questions, sum(n_rows)::BIGINT AS scoped_rows FROM
  (SELECT *, sum(n_rows) OVER (PARTITION BY project_id ORDER BY n_rows, i ROWS UNBOUNDED PRECEDING) AS run FROM d) GROUP BY ALL)"""

_FAMILY = """s AS (SELECT DISTINCT project_id, side, nt FROM r WHERE input IS NOT NULL AND side IS NOT NULL),
tot AS (SELECT project_id, count(*) AS n FROM s GROUP BY 1),
pw AS (SELECT project_id, string_split(nt, ' ') AS w FROM s),
pos AS (SELECT project_id, unnest(range(len(w))) AS pos, unnest(w) AS x FROM pw),
md AS (SELECT project_id, pos, max(c) AS c FROM (SELECT project_id, pos, x, count(*) AS c FROM pos WHERE x <> '' GROUP BY ALL) GROUP BY ALL),
off AS (SELECT tot.project_id, coalesce(min(pos) FILTER (c * 100 < 90 * n), 0) AS "offset" FROM tot LEFT JOIN md USING (project_id) GROUP BY ALL),
sg AS (SELECT project_id, side, array_to_string(string_split(nt, ' ')["offset" + 1:"offset" + 2], ' ') AS s FROM s JOIN off USING (project_id)),
sd AS (SELECT project_id, count(*) FILTER (side = 'tuning') AS nt, count(*) FILTER (side = 'heldout') AS nh FROM sg GROUP BY 1),
fg AS (SELECT project_id, s, count(*) FILTER (side = 'tuning') AS t, count(*) FILTER (side = 'heldout') AS h FROM sg WHERE s <> '' GROUP BY ALL HAVING count(*) >= 2),
fm AS (SELECT project_id, count(*) AS families, count(*) FILTER (t > 0 AND h > 0) AS shared_families, sum(t) AS ct, sum(h) AS ch FROM fg GROUP BY 1),
fam AS (SELECT project_id, CASE WHEN coalesce(families, 0) = 0 OR nt = 0 OR nh = 0 OR coalesce(ct, 0) * 100 < 80 * nt OR coalesce(ch, 0) * 100 < 80 * nh THEN 'SKIP' WHEN shared_families > 0 THEN 'PASS' ELSE 'WARN' END AS status,
  coalesce(families, 0) AS families, coalesce(shared_families, 0) AS shared_families FROM sd LEFT JOIN fm USING (project_id))"""

_B = ", ".join(f"count(*) FILTER (band = '{b}') AS b{i}" for i, b in enumerate(V.DIFFICULTIES))
_DIFF = f"""df AS (SELECT project_id, count(*) AS total_rows, count(band) AS tagged_rows, {_B}, count(DISTINCT band) AS bands, min(CASE WHEN orig = 'synthesised' THEN 1 ELSE 0 END) = 1 AS syn FROM u GROUP BY 1),
dc AS (SELECT *, ((b0 = 0)::INT + (b1 = 0)::INT + (b2 = 0)::INT + (b3 = 0)::INT)::BIGINT AS missing_bands FROM df)"""

_DUP = "dup AS (SELECT project_id, sum(n)::BIGINT AS scoreable_rows, count(*) AS distinct_rows, count(*) FILTER (n > 1) AS groups FROM (SELECT project_id, ident, count(*) AS n FROM u GROUP BY ALL) GROUP BY 1)"
_HASID = f"coalesce({strip('id')} <> '', false)"
_COUNTS = "lc AS (SELECT project_id, count(*) AS candidate_rows, count(*) FILTER (input IS NULL) AS without_input, count(*) FILTER (NOT lab) AS unlabelled_rows, count(*) FILTER (lab AND input IS NOT NULL) AS scoreable_rows FROM r GROUP BY 1)"
_PROV = """pc AS (SELECT project_id, count(*) AS n_rows, count(*) FILTER (lab) AS labelled, count(*) FILTER (orig = 'collected') AS collected, count(*) FILTER (orig = 'synthesised') AS synthesised,
  count(*) FILTER (orig = 'undeclared') AS undeclared, count(*) FILTER (lab AND oorig = 'synthesised') AS generated_answer, round(count(*) FILTER (orig = 'synthesised') / count(*), 4) AS synthesised_share,
  count(*) FILTER (orig = 'collected' AND lab AND oorig = 'synthesised') AS answered FROM r WHERE input IS NOT NULL GROUP BY 1)"""
_ANS = f"ad AS (SELECT *, {_DOM} FROM (SELECT project_id, sum(c)::BIGINT AS n, max(c) AS m, count(*) AS k FROM (SELECT project_id, {identity('output')} AS v, count(*) AS c FROM u GROUP BY ALL) GROUP BY 1))"
_OUT = f"douts AS (SELECT project_id, count(*) AS n_rows, count(DISTINCT {identity('output')}) AS k FROM u GROUP BY 1)"
_OVER = "ov AS (SELECT project_id, md5(ident) AS identity, count(*) FILTER (side = 'tuning') AS tuning_rows, count(*) FILTER (side = 'heldout') AS heldout_rows FROM r WHERE input IS NOT NULL GROUP BY ALL HAVING tuning_rows > 0 AND heldout_rows > 0)"
_PLACE = f"pl AS (SELECT project_id, count(*) AS n_rows, count(*) FILTER (len({words('output')}) = 0) AS placeholder_rows FROM u GROUP BY 1)"
_IDS = f"""mi AS (SELECT project_id, count(*) AS n_rows, count(*) FILTER (NOT {_HASID}) AS rows_without_id, count(*) FILTER (NOT {_HASID} AND orig = 'synthesised') AS generated_rows_without_id FROM r GROUP BY 1),
di AS (SELECT project_id, id, count(*) AS n_rows, min(line_no) AS first_line FROM r WHERE {_HASID} GROUP BY ALL HAVING count(*) > 1)"""
_REPORT = f"""{_COUNTS}, {_DUP}, {_IDS}, {_PROV}, {_OUT}, {_ANS}, {_PLACE}, {_OVER}, {_FAMILY}, {_DIFF}, rep AS (
SELECT project_id, 'dataset-integrity' AS "check", CASE WHEN unlabelled_rows > 0 THEN 'FAIL' ELSE 'PASS' END AS status, unlabelled_rows AS count FROM lc
UNION ALL SELECT project_id, 'dataset-duplicates', CASE WHEN groups > 0 THEN 'WARN' ELSE 'PASS' END, distinct_rows FROM dup
UNION ALL SELECT project_id, 'dataset-ids', CASE WHEN project_id IN (SELECT project_id FROM di) THEN 'FAIL' WHEN rows_without_id > 0 THEN 'WARN' ELSE 'PASS' END, rows_without_id FROM mi
UNION ALL SELECT project_id, 'dataset-provenance', CASE WHEN synthesised * 2 > n_rows THEN 'WARN' ELSE 'PASS' END, synthesised FROM pc
UNION ALL SELECT project_id, 'dataset-outputs', CASE WHEN n_rows < 2 THEN 'SKIP' WHEN k = 1 THEN 'WARN' ELSE 'PASS' END, k FROM douts
UNION ALL SELECT project_id, 'dataset-ceiling-risk', status, m FROM ad
UNION ALL SELECT project_id, 'dataset-output-placeholders', CASE WHEN placeholder_rows > 0 THEN 'WARN' ELSE 'PASS' END, placeholder_rows FROM pl
UNION ALL SELECT project_id, 'dataset-split', CASE WHEN count(identity) > 0 THEN 'FAIL' ELSE 'PASS' END, count(identity) FROM lc LEFT JOIN ov USING (project_id) GROUP BY project_id
UNION ALL SELECT project_id, 'dataset-split-family', status, families FROM fam
UNION ALL SELECT project_id, 'dataset-difficulty-coverage', CASE WHEN missing_bands = 0 THEN 'PASS' ELSE 'WARN' END, tagged_rows FROM dc)"""

_FIELDS = ", ".join(f"json_extract_string(j, '$.\"{f}\"') AS f{i}" for i, f in enumerate(V.OUTCOME_FIELDS))
_SCALAR = ", ".join(f"bool_and(coalesce(json_type(j, '$.\"{f}\"') NOT IN ('OBJECT', 'ARRAY', 'NULL'), false)) AS s{i}" for i, f in enumerate(V.OUTCOME_FIELDS))
_CHOSEN = "CASE " + " ".join(f"WHEN s{i} THEN '{f}'" for i, f in enumerate(V.OUTCOME_FIELDS)) + " END"
_VALUE = "CASE field " + " ".join(f"WHEN '{f}' THEN f{i}" for i, f in enumerate(V.OUTCOME_FIELDS)) + " END"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join((_ROWS, *parts)) + " "


SQL = {
    "normalized_identity": f"{_with()} SELECT row_id, md5(ident) AS identity, len(ws) AS n_words FROM r WHERE input IS NOT NULL",
    "token_stats": _with("t AS (SELECT project_id, unnest(ws) AS x FROM u)", "v AS (SELECT project_id, count(DISTINCT x) AS n_distinct FROM t GROUP BY 1)") + "SELECT project_id, count(*) AS n_rows, sum(len(ws))::BIGINT AS n_words, sum(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(ws) - 2) END)::BIGINT AS n_runs, coalesce(any_value(n_distinct), 0) AS n_distinct FROM u LEFT JOIN v USING (project_id) GROUP BY project_id",
    "duplicate_groups": f"{_with()} SELECT project_id, md5(ident) AS identity, count(*) AS n_rows, min(row_id) AS first_row FROM u GROUP BY ALL HAVING count(*) > 1",
    "duplicate_summary": _with(_DUP) + "SELECT * FROM dup",
    "similar_classes": f"{_with()} SELECT project_id, min(row_id) OVER (PARTITION BY project_id, nt) AS class_id, row_id FROM u",
    "similar_pairs": _with(
        "c AS (SELECT project_id, nt, min(row_id) AS c, any_value(ws) AS ws FROM u WHERE nt <> '' GROUP BY project_id, nt)",
        "g AS (SELECT DISTINCT project_id, c, unnest(CASE WHEN len(ws) < 3 THEN [nt] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM c)",
        "n AS (SELECT c, count(*) AS n FROM g GROUP BY c)",
        "p AS (SELECT a.project_id, a.c AS class_a, b.c AS class_b, count(*) AS shared FROM g a JOIN g b ON a.project_id = b.project_id AND a.s = b.s AND a.c < b.c GROUP BY ALL)",
    ) + "SELECT project_id, class_a, class_b, shared, x.n + y.n - shared AS either FROM p JOIN n x ON x.c = class_a JOIN n y ON y.c = class_b WHERE shared * 10 >= 7 * (x.n + y.n - shared)",
    "split_overlap": _with(_OVER) + "SELECT * FROM ov",
    "split_sizes": f"{_with()} SELECT project_id, coalesce(side, 'none') AS side, count(*) AS n_rows, count(*) FILTER (lab) AS labelled_rows, count(DISTINCT ident) AS distinct_inputs, count(DISTINCT CASE WHEN lab THEN ident END) AS distinct_scoreable FROM r WHERE input IS NOT NULL GROUP BY 1, 2",
    "split_vocabulary": f"{_with()} SELECT project_id, lower({strip('sp')}) AS split_name, count(*) AS n_rows FROM r WHERE sp <> '' AND side IS NULL GROUP BY ALL",
    "holdout_resolution": f"{_with()} SELECT project_id, count(*) AS holdout_rows, count(*) FILTER (lab) AS labelled_rows, round(100 / nullif(count(*) FILTER (lab), 0), 1) AS points_each FROM r WHERE side = 'heldout' GROUP BY 1",
    "question_cap": _with(_DRAW) + "SELECT * FROM cap",
    "row_bounds": _with(_DRAW) + """SELECT project_id, any_value(questions) AS questions, sum(n_rows) FILTER (lo <= questions)::BIGINT AS rows_fewest, sum(n_rows) FILTER (hi <= questions)::BIGINT AS rows_most FROM
 (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n_rows, i) AS lo, row_number() OVER (PARTITION BY project_id ORDER BY n_rows DESC, i) AS hi FROM d JOIN (SELECT project_id, questions FROM cap) USING (project_id)) GROUP BY project_id""",
    "family_offset": _with(_FAMILY) + "SELECT * FROM off",
    "family_partition": _with(_FAMILY) + "SELECT * FROM fam",
    "duplicate_ids": _with(_IDS) + "SELECT * FROM di",
    "missing_ids": _with(_IDS) + "SELECT * FROM mi",
    "id_digests": f"{_with()} SELECT DISTINCT project_id, substr(sha256(CASE WHEN {_HASID} THEN id ELSE 'line-' || line_no END), 1, 16) AS digest FROM r",
    "provenance_counts": _with(_PROV) + "SELECT * EXCLUDE (answered) FROM pc",
    "unrecognised_words": f"{_with()} SELECT project_id, prov AS word, count(*) AS n_rows FROM r WHERE input IS NOT NULL AND NOT {recognised('prov')} GROUP BY ALL",
    "provenance_points": _with(_PROV) + """SELECT project_id, round(((collected - answered) * 10 + answered * 6 + synthesised * 3 + undeclared * 3) / n_rows, 4) AS points,
 CASE WHEN synthesised * 2 > n_rows THEN 65 WHEN undeclared * 2 > n_rows THEN 70 WHEN (synthesised + undeclared) * 2 > n_rows THEN 74 WHEN answered * 2 > n_rows THEN 74 END AS ceiling FROM pc""",
    "label_counts": _with(_COUNTS) + "SELECT * FROM lc",
    "placeholder_outputs": _with(_PLACE) + "SELECT * FROM pl",
    "answer_dominance": _with(_ANS) + "SELECT * FROM ad",
    "distinct_outputs": _with(_OUT) + "SELECT *, CASE WHEN n_rows < 2 THEN 'SKIP' WHEN k = 1 THEN 'WARN' ELSE 'PASS' END AS status FROM douts",
    "outcome_fields": _with(
        "js AS (SELECT project_id, CASE WHEN json_valid(output) THEN output::JSON END AS j FROM u)", f"jf AS (SELECT project_id, {_FIELDS} FROM js)", f"sc AS (SELECT project_id, {_SCALAR} FROM js GROUP BY 1)",
        f"ch AS (SELECT project_id, {_CHOSEN} AS field FROM sc)", f"vc AS (SELECT project_id, field, {_VALUE} AS v, count(*) AS c FROM jf JOIN ch USING (project_id) WHERE field IS NOT NULL GROUP BY ALL)",
    ) + f"SELECT *, {_DOM} FROM (SELECT project_id, field, sum(c)::BIGINT AS n, max(c) AS m, count(*) AS k FROM vc GROUP BY ALL)",
    "input_types": rf"{_with()} SELECT project_id, CASE WHEN NOT regexp_matches(input, '^\s*[\{{\[]') OR NOT json_valid(input) THEN 'string' WHEN json_type(input) = 'OBJECT' THEN 'object' WHEN json_type(input) = 'ARRAY' THEN 'array' ELSE 'string' END AS kind, count(*) AS n_rows FROM r WHERE input IS NOT NULL GROUP BY ALL",
    "difficulty_coverage": _with(_DIFF) + """SELECT project_id, total_rows, tagged_rows, bands, missing_bands, CASE WHEN missing_bands = 0 THEN 'PASS' ELSE 'WARN' END AS coverage_status,
 CASE WHEN tagged_rows > 0 AND b0 = tagged_rows THEN 'WARN' WHEN NOT syn AND tagged_rows > 0 AND b2 = 0 AND b3 = 0 THEN 'WARN' WHEN missing_bands = 0 THEN 'PASS' WHEN syn THEN 'WARN' ELSE 'NONE' END AS difficulty_status FROM dc""",
    "scenario_coverage": f"{_with()} SELECT project_id, scenarios, CASE WHEN NOT syn THEN 'NONE' WHEN scenarios < 4 THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT project_id, count(DISTINCT cov) AS scenarios, min(CASE WHEN orig = 'synthesised' THEN 1 ELSE 0 END) = 1 AS syn FROM u GROUP BY 1)",
    "size_gates": f"{_with()} SELECT project_id, count(*) AS n_rows, count(*) FILTER (side = 'tuning') AS tuning_rows, CASE WHEN count(*) < 10 THEN 'WARN' ELSE 'PASS' END AS size_status, CASE WHEN count(*) FILTER (side = 'tuning') < 10 THEN 'WARN' ELSE 'PASS' END AS tuning_status FROM u GROUP BY 1",
    "check_report": _with(_REPORT) + "SELECT * FROM rep",
    "row_count_bounds": _with(_REPORT) + "SELECT project_id, \"check\", count <= candidate_rows AS ok FROM rep JOIN lc USING (project_id) WHERE \"check\" IN ('dataset-integrity', 'dataset-duplicates', 'dataset-ids', 'dataset-provenance', 'dataset-difficulty-coverage')",
}
