"""Scoring generated answers, and aggregating the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers, exact
from ..functions.grammar import formulas
from .examples import FORMULAS, with_rows

HEADLINES = ("strict_final_answer_accuracy", "final_answer_accuracy", "final_answer_error", "mean_step_arithmetic_accuracy", "internal_arithmetic_consistency_rate", "correct_and_internally_consistent_rate")
RESPONSE = f"marked_prediction string, fallback_prediction string, reference_value string, strict_correct boolean, correct boolean, final_answer_error double, last_step_matches boolean, formulas {FORMULAS}"


def protocol(system_prompt: str, max_new_tokens: int = 768, do_sample: bool = False, num_beams: int = 1) -> dict:
    """How scores come about, as a self-describing record."""
    # Names and settings of the record.
    return {
        "prompt": system_prompt,
        "scoring": {
            "require_final_marker": False, "strict_metric_requires_final_marker": True, "strict_marker_policy": "terminal_numeric_or_fraction", "fallback_policy": "last_standalone_numeric_or_fraction",
            "fraction_normalization": {"internal": "exact_fraction", "repeating_decimal_places": exact.SHOWN_PLACES},
            "numeric_comparison": {"mode": "exact_or_decimal_rounding_or_truncation", "minimum_decimal_places": 1},
            "final_answer_error": {"mode": "symmetric_relative_error", "minimum": 0.0, "maximum": float(exact.WORST_ERROR), "missing_prediction": float(exact.WORST_ERROR)},
            "supported_operators": ["+", "-", "*", "/", "//"], "step_aggregation": "macro_per_example",
        },
        "generation": {"do_sample": do_sample, "num_beams": num_beams, "max_new_tokens": max_new_tokens},
    }


def _response(generated: str | None, reference: str | None) -> dict:
    target = answers.reference(reference)
    if target is None:
        raise ValueError("a reference must be a number or end in a marked one")
    marked = answers.marked(generated)
    fallback = answers.fallback(generated) if marked is None else None
    prediction = marked or fallback
    found = formulas(generated)
    error = exact.symmetric_error(prediction, target)
    return {
        "marked_prediction": marked, "fallback_prediction": fallback, "reference_value": target,
        "strict_correct": exact.same(marked, target), "correct": exact.same(prediction, target),
        "final_answer_error": float(exact.WORST_ERROR if error is None else error),
        "last_step_matches": bool(found) and marked is not None and exact.same(marked, found[-1].shown),
        "formulas": [{"raw": f.raw, "expression": f.expression, "claimed": f.claimed, "value": f.shown, "parsed": f.parsed, "executed": f.executed, "correct": f.correct, "error": f.error} for f in found],
    }


def score(df: DataFrame, generated: str = "generated_text", reference: str = "reference") -> DataFrame:
    """``df`` with predictions, correctness and per-response step figures. A null text has no prediction."""
    rows = with_rows(df, [generated, reference], RESPONSE, _response)
    count = lambda c: F.size(F.filter("formulas", lambda f: f[c]))
    rows = rows.withColumns({
        "prediction": F.coalesce("marked_prediction", "fallback_prediction"),
        "prediction_source": F.when(F.col("marked_prediction").isNotNull(), "final_marker").when(F.col("fallback_prediction").isNotNull(), "fallback"),
        "formula_count": F.size("formulas"), "parsed_formula_count": count("parsed"), "correct_formula_count": count("correct"),
    })
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("formula_count")), F.lit(0.0))
    every = (F.col("formula_count") > 0) & (F.col("correct_formula_count") == F.col("formula_count"))
    rows = rows.withColumns({
        "formula_parse_rate": ratio("parsed_formula_count"), "mean_step_arithmetic_accuracy": ratio("correct_formula_count"),
        "all_steps_correct": every, "internally_consistent": every & F.col("last_step_matches"),
    })
    return rows.withColumn("correct_and_consistent", F.col("correct") & F.col("internally_consistent"))


def sums(scored: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """What adds up of scored responses: one row, or one for each group. A response counts as often as its column ``weight`` says (none: once)."""
    times = F.lit(1).cast("long") if weight is None else F.col(weight)
    how_many = lambda test: F.coalesce(F.sum(F.when(test, times)), F.lit(0))
    return scored.groupBy(*by).agg(
        how_many(F.col("strict_correct")).alias("strict_correct_final_answers"), how_many(F.col("correct")).alias("correct_final_answers"),
        how_many(F.col("internally_consistent")).alias("internally_consistent_answers"), how_many(F.col("correct_and_consistent")).alias("correct_and_internally_consistent"),
        F.sum(F.col("final_answer_error") * times).alias("error_sum"), F.sum(F.col("mean_step_arithmetic_accuracy") * times).alias("accuracy_sum"), how_many(F.col("marked_prediction").isNotNull()).alias("marked_answers"),
        F.sum(F.col("parsed_formula_count") * times).alias("parsed_formulas"), F.sum(F.col("formula_count") * times).alias("formulas"), how_many(F.lit(True)).alias("total"),
    )


def merge(parts: DataFrame, *by: str) -> DataFrame:
    """The ``sums`` of all responses from the ``sums`` of parts of them."""
    return parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in parts.columns if c not in by))


def rates(sums: DataFrame, *by: str) -> DataFrame:
    """Rates and counts that follow from ``sums``; those of no responses are null."""
    over = lambda c: F.try_divide(F.col(c), F.col("total"))
    return sums.select(
        *by, *(over(c).alias(n) for c, n in zip(("strict_correct_final_answers", "correct_final_answers", "error_sum", "accuracy_sum", "internally_consistent_answers", "correct_and_internally_consistent"), HEADLINES, strict=True)),
        over("marked_answers").alias("final_answer_format_compliance_rate"), F.coalesce(F.try_divide(F.col("parsed_formulas"), F.col("formulas")), F.lit(0.0)).alias("formula_parse_rate"),
        "strict_correct_final_answers", "correct_final_answers", "internally_consistent_answers", "correct_and_internally_consistent", "parsed_formulas", "formulas", "total",
    )


def summarize(scored: DataFrame, *by: str) -> DataFrame:
    """Rates and counts of scored responses, one row, or one for each group; partial sums, divided last."""
    return rates(sums(scored, *by), *by)


def evaluate(df: DataFrame, system_prompt: str, **generation) -> tuple[dict, DataFrame, DataFrame]:
    """(protocol, one-row summary, scored rows) of (question, reference, generated_text) rows; there must be some."""
    scored = score(require_rows(df))
    return protocol(system_prompt, **generation), summarize(scored), scored


def require_rows(df: DataFrame, what: str = "predictions") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"there are no {what}")
    return df


def select_metrics(metrics: DataFrame) -> DataFrame:
    """The headline metrics that a report has."""
    return metrics.select(*(c for c in HEADLINES if c in metrics.columns))


def flatten_metrics(df: DataFrame, prefix: str = "", skip: tuple[str, ...] = ("predictions",)) -> DataFrame:
    """(metric, value) rows of one report: nested names joined by "/", numbers only, finite, no booleans."""
    from pyspark.sql import types as T

    def leaves(schema, path, column):
        for f in schema:
            name, c = f"{path}{f.name}", column(f.name)
            if f.name in skip:
                continue
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, f"{name}/", lambda n, c=c: c[n])
            elif isinstance(f.dataType, T.NumericType):
                yield name, c.cast("double")

    found = list(leaves(df.schema, f"{prefix}/" if prefix else "", lambda n: F.col(f"`{n}`")))
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in found))
    rows = df.select(F.inline(pairs))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def json_safe(df: DataFrame) -> DataFrame:
    """Doubles that JSON can't hold as null; columns that aren't plain values dropped."""
    from pyspark.sql import types as T

    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name))
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(c)
    return df.select(*out)


def evaluation_history(records: DataFrame, every: int) -> DataFrame:
    """Records of epochs 0, every, 2 * every ..., the first of each (epoch, split) by global_step. Histories of parts have the history of all."""
    first = records.where(F.col("epoch") % every == 0).groupBy("epoch", "split").agg(F.min_by(F.struct(*records.columns), "global_step").alias("r"))
    return first.select("r.*")
