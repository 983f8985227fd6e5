"""Questions with numbers in words and answers that need them, derived from ``part``.

Where ``qa`` has digits and plain steps, these fifteen variants have written fractions that meet divisions, mixed fractions, signs,
phrases, ordinals that are no numbers, expressions that are told before they are annotated, nested trees, and chains of steps. The
expressions are plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .qa import spread

VARIANTS = 15
UNITS = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
PARTS = {3: ("third", "thirds"), 5: ("fifth", "fifths"), 7: ("seventh", "sevenths"), 9: ("ninth", "ninths")}

#: Integers of a row: M and W are counts (W in words), U is below ten, N/D a fraction in lowest terms.
INTEGERS = "x % 15 AS k, 10 + x % 80 AS m, 10 * (2 + x % 8) + 1 + x % 9 AS w, 1 + x % 9 AS u, 1 + x % 2 AS n, 3 + 2 * (x % 4) AS d"
_PAIR = "{m} jars and {W} lids."
_PART = "{m} jars, {F} of them full."
QUESTIONS = {
    0: _PART, 1: _PART, 2: _PAIR, 3: "{m} jars, {2*n}/{2*d} of them full.", 4: "{W} and a half bags plus {m} more.", 5: "{m} steps down and {W} up.", 6: "{F} of {m} jars and {F} of the lids.", 7: _PART,
    8: _PAIR, 9: _PAIR, 10: _PAIR, 11: "A half dozen crates, twice {W} lids and {m} jars on the {O} lap.", 12: _PAIR, 13: _PAIR, 14: "{m} jars.",
}
ANSWERS = {
    0: "<<{n}/{d}={n}/{d}>>.\n#### {n}/{d}",
    1: "<<{m}*({n}/{d})={m*n}/{d}>>.\n#### {m*n}/{d}",
    2: "<<{n}/{d}={n}/{d}>>.\n#### {n}/{d}",
    3: "<<{n}/{d}={n}/{d}>>.\n#### {n}/{d}",
    4: "<<{w}.5+{m}={w+m}.5>>.\n#### {w+m}.5",
    5: "<<-{m}+{w}={w-m}>>.\n#### {w-m}",
    6: "<<{n}/{d}={n}/{d}>>.\n#### {n}/{d}",
    7: "<<{n}/{d}={n}/{d}>> then <<{m}*({n}/{d})={m*n}/{d}>>.\n#### {m*n}/{d}",
    8: "They have {m} + {w} = <<{m}+{w}={m+w}>>{m+w} jars.\n#### {m+w}",
    9: "Each needs {m} x ${u} = $<<{m}*{u}={m*u}>>{m*u}.\n#### {m*u}",
    10: "That is {m*u} as {m} times {u} equals <<{m}*{u}={m*u}>>{m*u}.\n#### {m*u}",
    11: "<<6*{m}={6*m}>>.\n#### {6*m}",
    12: "It rose T + {m} + {u} = T + <<+{m}+{u}={m+u}>>{m+u}.\n#### {m+u}",
    13: "<<({m}+{u})*({w}-{u})-{u}={(m+u)*(w-u)-u}>>.\n#### {(m+u)*(w-u)-u}",
    14: "<<{m}+{u}={m+u}>> <<{m+u}*2={2*(m+u)}>> <<{2*(m+u)}+{u}={2*m+3*u}>> <<{m}*10={10*m}>> <<{2*m+3*u}-3={2*m+3*u-3}>>.\n#### {2*m+3*u-3}",
}
#: Answers whose text only repeats the annotation, without that text.
CANONICAL = {8: "They have <<{m}+{w}={m+w}>> jars.\n#### {m+w}", 9: "Each needs <<{m}*{u}={m*u}>>.\n#### {m*u}", 10: "<<{m}*{u}={m*u}>>.\n#### {m*u}", 12: "<<+{m}+{u}={m+u}>>.\n#### {m+u}"}


def _case(by: str, values: dict) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


_WORDS = f"({_case('x % 8', {k: repr(t) for k, t in enumerate(TENS)})} || '-' || {_case('u', {k + 1: repr(u) for k, u in enumerate(UNITS)})})"
_FRACTION = f"(CASE n WHEN 1 THEN 'a ' || {_case('d', {d: repr(one) for d, (one, _) in PARTS.items()})} ELSE 'two ' || {_case('d', {d: repr(more) for d, (_, more) in PARTS.items()})} END)"
_ORDINAL = _case("d", {d: repr(one) for d, (one, _) in PARTS.items()})
_SPECIAL = {"W": _WORDS, "F": _FRACTION, "O": f"({_ORDINAL})"}


def _text(template: str) -> str:
    out = []
    for k, piece in enumerate(re.split(r"\{([^}]+)\}", template)):
        if k % 2:
            out.append(_SPECIAL.get(piece) or f"CAST({piece} AS STRING)")
        elif piece:
            out.append(" || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in piece.split("\n")))
    return " || ".join(out)


_COLUMNS = {"question": _case("k", {k: _text(t) for k, t in QUESTIONS.items()}), "answer": _case("k", {k: _text(t) for k, t in ANSWERS.items()})}


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, k, m, w, u, n, d, question, answer of every part."""
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS example_id", "p_partkey AS x").selectExpr("example_id", "x", *(f"{c.strip()}" for c in INTEGERS.split(",")))
    return spread(keys, *(c.split()[-1] for c in INTEGERS.split(","))).select("*", *(F.expr(e).alias(c) for c, e in _COLUMNS.items())).drop("x")


_RATIO = "CAST({0} // gcd({0}, {1}) AS VARCHAR) || CASE WHEN {1} // gcd({0}, {1}) = 1 THEN '' ELSE '/' || CAST({1} // gcd({0}, {1}) AS VARCHAR) END"
_S = lambda x: f"CAST({x} AS VARCHAR)"
_ND = "CAST(n AS VARCHAR) || '/' || CAST(d AS VARCHAR)"
#: Numbers of each question, and for each step its target and the values of its leaves, as Fraction texts in SQL.
NUMBERS = {
    0: ["m", _ND], 1: ["m", _ND], 2: ["m", "w"], 3: ["m", _ND], 4: [_RATIO.format("(2*w+1)", "2"), "m"], 5: ["m", "w"], 6: [_ND, "m", _ND], 7: ["m", _ND],
    8: ["m", "w"], 9: ["m", "w"], 10: ["m", "w"], 11: ["6", "2", "w", "m"], 12: ["m", "w"], 13: ["m", "w"], 14: ["m"],
}
_MND = _RATIO.format("(m*n)", "d")
STEPS = {
    0: [(_ND, "copy", [_ND])], 1: [(_MND, "mul", ["m", _ND])], 2: [(_ND, "div", ["n", "d"])], 3: [(_ND, "div", ["n", "d"])], 4: [(_RATIO.format("(2*w+2*m+1)", "2"), "add", [_RATIO.format("(2*w+1)", "2"), "m"])],
    5: [("w-m", "add", ["-m", "w"])], 6: [(_ND, "copy", [_ND])], 7: [(_ND, "copy", [_ND]), (_MND, "mul", ["m", _ND])], 8: [("m+w", "add", ["m", "w"])], 9: [("m*u", "mul", ["m", "u"])], 10: [("m*u", "mul", ["m", "u"])],
    11: [("6*m", "mul", ["6", "m"])], 12: [("m+u", "add", ["m", "u"])], 13: [("(m+u)*(w-u)-u", "add,sub,mul,sub", ["m", "u", "w", "u", "u"])],
    14: [("m+u", "add", ["m", "u"]), ("2*(m+u)", "mul", ["m+u", "2"]), ("2*m+3*u", "add", ["2*(m+u)", "u"]), ("10*m", "mul", ["m", "10"]), ("2*m+3*u-3", "sub", ["2*m+3*u", "3"])],
}
_union = lambda rows: " UNION ALL ".join(rows)
#: The same rows for DuckDB: base and worded (rows), nums (idx, value), steps (step, target, ops), leaves (step, leaf, value, own, earlier, kind), edges (step, dependency).
WORDED_SQL = (
    f"WITH base AS (SELECT example_id, x, {INTEGERS} FROM (SELECT p_partkey AS example_id, p_partkey AS x FROM part)), "
    + f"worded AS (SELECT *, {_COLUMNS['question']} AS question, {_COLUMNS['answer']} AS answer, {_case('k', {k: _text(CANONICAL.get(k, t)) for k, t in ANSWERS.items()})} AS canonical FROM base), "
    + "nums AS (" + _union(f"SELECT example_id, CAST({i} AS INT) AS idx, {v if v is _ND or '//' in v else _S(v)} AS value FROM base WHERE k = {k}" for k, vs in NUMBERS.items() for i, v in enumerate(vs)) + "), "
    + "steps AS (" + _union(f"SELECT example_id, k, CAST({i} AS INT) AS step, {t if t is _ND or '//' in t else _S(t)} AS target, '{ops}' AS ops FROM base WHERE k = {k}" for k, ss in STEPS.items() for i, (t, ops, _) in enumerate(ss)) + "), "
    + "operands AS (" + _union(f"SELECT example_id, k, CAST({i} AS INT) AS step, {j} AS leaf, {v if v is _ND or '//' in v else _S(v)} AS value FROM base WHERE k = {k}" for k, ss in STEPS.items() for i, (_, _, vs) in enumerate(ss) for j, v in enumerate(vs)) + "), "
    + "counted AS (SELECT o.*, (SELECT count(*) FROM nums WHERE nums.example_id = o.example_id AND nums.value = o.value) AS own, (SELECT count(*) FROM steps WHERE steps.example_id = o.example_id AND steps.step < o.step AND steps.target = o.value) AS earlier FROM operands o), "
    + "leaves AS (SELECT *, CASE WHEN own + earlier = 0 THEN 'literal' WHEN own + earlier > 1 THEN 'unresolved' WHEN own = 1 THEN 'problem_number' ELSE 'previous_result' END AS kind FROM counted), "
    + "edges AS (SELECT DISTINCT l.example_id, l.step, s.step AS dependency FROM leaves l JOIN steps s ON s.example_id = l.example_id AND s.step < l.step AND s.target = l.value WHERE l.kind = 'previous_result') "
)
