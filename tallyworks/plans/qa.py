"""Question and answer rows derived from ``orders``, for queries over tables that hold no annotated text.

Every text is made of integers that the order key gives, in sixteen variants k: correct and wrong claims, broken
annotations, ratios, thousands, negative numbers, missing answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The answer of each variant; {x} stands for an integer of the row, see PARTS.
ANSWERS = {
    0: "First <<{a}*{b}={p}>>{p} items.\nThen <<{p}+{c}={t}>>{t}.\n#### {t}",
    1: "First <<{a}*{b}={p1}>>.\n#### {t}",
    2: "First <<{a}*{b}>>.\n#### {t}",
    3: "First <<{a}*{b}={p}",
    4: "<<{a}={a}>>{a} then <<{a}+{c}={ac}>>.\n#### {ac}",
    5: "<<{a}%{b}={amodb}>>.\n#### {amodb}",
    6: "<<{a}/0=0>>.\n#### 0",
    7: "<<{a}/7={whole}.{cents}>>.\n#### {a}/7",
    8: "<<{a}+{b}={ab}>>.\n#### {ab} items",
    9: "No steps.\n#### {t}",
    10: "<<{a},000+{b}={a},0{bb}>>.\n#### {a},0{bb}",
    11: "First <<{a}*{b}={p}>>.\nThen <<{p}+{c}={t}>>.\n#### {t1}",
    12: "<<{a}/4={a}/4>>.\n#### {a}/4",
    13: "<<{c}-{a10}=-{a10c}>>.\n#### -{a10c}",
    14: "No idea.",
    15: "<<{a}//{b}={adivb}>>.\n#### {adivb}",
}
QUESTION = "There are {a} crates with {b} items each and {c} extra items."
MORE = {12: " Half are red.", 14: " A dozen are new."}
#: Integer expressions (DIV is whole division); cents and bb are two digits.
PARTS = {
    "a": "a", "b": "b", "c": "c", "p": "a*b", "t": "a*b+c", "p1": "a*b+1", "t1": "a*b+c+1", "ac": "a+c", "ab": "a+b", "amodb": "a%b", "a10": "a+10", "a10c": "a+10-c",
    "adivb": "a DIV b", "whole": "((200*a+7) DIV 14) DIV 100", "cents": "((200*a+7) DIV 14) % 100", "bb": "b",
}
TWO_DIGITS = ("cents", "bb")


def _sql(template: str, div: str) -> str:
    """A template as SQL string concatenation."""
    import re

    def part(name: str) -> str:
        shown = f"CAST({PARTS[name].replace('DIV', div)} AS {'STRING' if div == 'DIV' else 'VARCHAR'})"
        return f"lpad({shown}, 2, '0')" if name in TWO_DIGITS else shown

    out = []
    for k, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if k % 2:
            out.append(part(piece))
        elif piece:
            out.append(" || chr(10) || ".join(f"'{x}'" for x in piece.split("\n")))
    return " || ".join(out)


def _case(templates: dict[int, str], div: str, other: str = "''") -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {_sql(t, div)}" for k, t in templates.items()) + f" ELSE {other} END"


#: Rows that one task works on, where there are more than these for each core.
ROWS_A_TASK = 200_000


def partitions(rows: DataFrame) -> int:
    """How many tasks row-local exact work is dealt to: by its rows, and one for each core at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of a scan dealt by the values ``by`` that their texts are made of, so that equal texts meet in one task.

    Partitions of a scan say nothing about rows: a file may have a hundred of them, and all its rows in one row group.
    """
    return rows.repartition(partitions(rows), *by)


#: What a row's texts are made of.
MADE_OF = ["a", "b", "c", "k"]


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, a, b, c, k of every order."""
    n = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(n.alias("example_id"), (n % 47 + 3).alias("a"), (n % 13 + 2).alias("b"), (n % 7 + 1).alias("c"), (n % 16).alias("k"))


def texts(rows: DataFrame) -> DataFrame:
    """Adds question, answer, reference to rows of a, b, c, k."""
    return rows.select(
        "*",
        F.expr(f"{_sql(QUESTION, 'DIV')} || {_case(MORE, 'DIV')}").alias("question"),
        F.expr(_case(ANSWERS, "DIV")).alias("answer"),
        F.expr("'#### ' || CAST(a*b+c AS STRING)").alias("reference"),
    )


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, a, b, c, k, question, answer, reference of every order."""
    return texts(spread(keys(spark, sf_dir), *MADE_OF))


#: The same rows for DuckDB: tables base (a, b, c, k, p, t) and qa.
QA_SQL = f"""
WITH base AS (
  SELECT *, a*b AS p, a*b+c AS t FROM (
    SELECT o_orderkey AS example_id, o_orderkey % 47 + 3 AS a, o_orderkey % 13 + 2 AS b, o_orderkey % 7 + 1 AS c, o_orderkey % 16 AS k FROM orders)
), qa AS (
  SELECT *, {_sql(QUESTION, "//")} || {_case(MORE, "//")} AS question, {_case(ANSWERS, "//")} AS answer, '#### ' || CAST(a*b+c AS VARCHAR) AS reference FROM base
)
"""
