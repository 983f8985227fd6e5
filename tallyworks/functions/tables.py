"""What SQL can call: table functions over texts, which travel by Arrow, and scalar functions that stay native.

``SELECT t.id, a.* FROM t, LATERAL annotations(t.answer) AS a`` has the rows of the DataFrame operators. Null texts are empty
texts, empty texts have no rows, and texts of any length are read as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import calculation, grammar, question, scan


class Annotations:
    """annotations(text): the verdict on every annotation, in order."""

    schema = "step int, raw string, start int, end int, expression string, claimed string, value string, parsed boolean, executed boolean, correct boolean, error string"

    def eval(self, text: str | None) -> Iterator[tuple]:
        for k, f in enumerate(grammar.formulas(text)):
            yield k, f.raw, f.start, f.end, f.expression, f.claimed, f.shown, f.parsed, f.executed, f.correct, f.error


class QuestionNumbers:
    """question_numbers(text): every number of a question, words included, by place."""

    schema = "idx int, text string, start int, end int, value string"

    def eval(self, text: str | None) -> Iterator[tuple]:
        for k, f in enumerate(question.numbers(text)):
            yield k, text[f.start : f.end], f.start, f.end, calculation.text(f.value)


class MathSteps:
    """math_steps(question, answer): every step with what it rests on and what its graph and its program come to."""

    schema = "step int, expression string, valid boolean, error string, is_final boolean, target string, rests_on array<int>, unresolved int, graph_result string, program_result string"

    def eval(self, q: str | None, a: str | None) -> Iterator[tuple]:
        for s in calculation.record(q, a)["steps"]:
            yield s["index"], s["expression"], s["valid"], s["error"], s["is_final"], s["target"], s["dependencies"], s["unresolved"], s["graph_result"], s["program_result"]


TABLE_FUNCTIONS = {"annotations": Annotations, "question_numbers": QuestionNumbers, "math_steps": MathSteps}

#: Native functions of one text t, by name: (type, expression).
SCALAR_FUNCTIONS = {
    "marked_text": ("STRING", f"nullif(regexp_extract(t, r'{scan.MARKED}', 1), '')"),
    "standalone_text": ("STRING", f"try_element_at(regexp_extract_all(t, r'{scan.STANDALONE}', 1), -1)"),
    "annotation_texts": ("ARRAY<STRING>", f"regexp_extract_all(t, r'{scan.ANNOTATION}', 0)"),
}


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session by their names; again is no error."""
    for name, made in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(made, returnType=made.schema, useArrow=True))
    for name, (kind, expression) in SCALAR_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {expression}")
