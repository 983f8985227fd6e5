"""Training recipes: which losses they add up, and which features and heads those need."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed tables: loss, weight, features, heads, whether it is implemented; and the losses of each recipe.
LOSSES = [
    ("language", 1.0, [], [], True),
    ("language:math", 1.0, ["token_loss_weights"], [], True),
    ("result", 1.0, ["step_positions", "step_targets", "step_target_scales", "step_mask"], ["numeric_result"], False),
    ("execution", 1.0, ["step_positions", "step_target_scales", "step_mask", "postfix_program"], ["numeric_result"], False),
    ("operator", 1.0, ["step_positions", "step_mask", "postfix_program"], ["action_operator"], False),
    ("dependency", 1.0, ["step_positions", "step_mask", "postfix_program"], ["operand_reference"], False),
    ("structured_action", 1.0, ["step_positions", "step_mask", "postfix_program"], ["action_operator", "operand_reference"], False),
    ("composition", 1.0, ["step_positions", "step_mask", "postfix_program"], ["composition"], False),
]
RECIPES = {
    "A1": ["language"],
    "A2": ["language:math"],
    "A3": ["language:math", "result"],
    "A4": ["language:math", "result", "execution"],
    "A5": ["language:math", "result", "execution", "operator", "dependency"],
    "A6": ["language:math", "result", "execution", "structured_action"],
    "A7": ["language:math", "result", "execution", "structured_action", "composition"],
}


def losses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOSSES, "loss string, weight double, features array<string>, heads array<string>, implemented boolean")


def recipes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, x) for r, xs in RECIPES.items() for x in xs], "recipe string, loss string")


def plans(spark: SparkSession) -> DataFrame:
    """One row for each recipe: its losses, features and heads, sorted, and whether all of it is implemented."""
    joined = recipes(spark).join(losses(spark), "loss")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return joined.groupBy("recipe").agg(F.array_sort(F.collect_list("loss")).alias("losses"), union("features"), union("heads"), F.bool_and("implemented").alias("implemented"))


def _math_weight(weight: float) -> float:
    number = isinstance(weight, (int, float)) and not isinstance(weight, bool)
    if number and 0 < weight < math.inf:
        return float(weight)
    raise ValueError(f"a weight of {weight!r} is not finite and positive")


def plan(name: str, math_token_weight: float = 2.0, require_implemented: bool = False) -> dict:
    """One row of ``plans`` as a record, without Spark, with the loss weights and the weight of tokens in annotations.

    Names that aren't in ``RECIPES`` (A0 and A8 among them, which train nothing) are an error, and so are recipes
    with losses that aren't implemented, if those are required.
    """
    wanted = RECIPES.get(name.strip().upper())
    if wanted is None:
        raise ValueError(f"{name!r} is none of the recipes that train: {', '.join(RECIPES)}")
    table = {loss: (weight, features, heads) for loss, weight, features, heads, done in LOSSES if loss in wanted and (done or not require_implemented)}
    if len(table) < len(wanted):
        raise NotImplementedError(", ".join(sorted(set(wanted) - set(table))))
    union = lambda k: sorted(set().union(*(row[k] for row in table.values())))
    uses_weight = any("token_loss_weights" in row[1] for row in table.values())
    return {
        "id": name.strip().upper(), "losses": {loss: row[0] for loss, row in table.items()}, "features": union(1), "heads": union(2),
        "math_token_weight": _math_weight(math_token_weight) if uses_weight else 1.0,
    }
