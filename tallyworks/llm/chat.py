"""Preference formatting in DataFrame functions only: one shared prompt, two masked completions.

A pair is two conversations as arrays of turns. Their longest common prefix of turns is rendered once; what
follows in each is its completion. Masks are the spans of a completion that a loss counts: the texts and end
marks of assistant turns. All of it is a projection of the pair's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .pii import running_sum

TURN = "struct<role:string,text:string>"
#: Fixed marks of the rendered form.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order.

    Rows without a conv_id belong to no conversation and are left out; a null role is written "unknown", a
    null text is empty; rows with the same turn number are all kept, by role and text. Other columns aren't read, and
    an empty table gives an empty result. A conversation is one row here, so all of it must fit a task.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", row.alias("row"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return grouped.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns of two arrays are equal (null arrays have none)."""
    shorter = F.coalesce(F.least(F.size(a), F.size(b)), F.lit(0))
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)  # beyond the shorter one x or y is null
    return F.when(shorter <= 0, F.lit(0)).when(differs == 0, shorter).otherwise(F.least((differs - 1).cast("int"), shorter))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def _render(turn: Column) -> Column:
    return F.concat(_head(turn), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def mask(turns: Column) -> Column:
    """Array of (start, end): code points of the rendered turns that assistants wrote, end marks included."""
    marks = len(OPEN) + len(CLOSE) + len(END)
    ends = running_sum(F.transform(turns, lambda t: (F.length(t["role"]) + F.length(t["text"]) + marks).cast("long")))
    spans = F.zip_with(turns, ends, lambda t, e: F.when(t["role"] == "assistant", F.struct((e - F.length(t["text"]) - len(END)).alias("start"), e.alias("end"))))
    return F.filter(spans, lambda s: s.isNotNull())


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` without the two arrays of turns, with the prompt and the two completions and masks.

    Adds n_prompt_turns, prompt, chosen_completion, rejected_completion, chosen_mask, rejected_mask. Equal
    conversations have empty completions; where one begins with all of the other, the shorter one's is empty.
    Null arrays count as empty, long texts are rendered whole, repeated rows are rows like any other, and an empty table
    gives an empty result. Columns of those names are replaced; all others may have any names.
    """
    p = fresh(pairs)
    a, b = f"{p}a", f"{p}b"
    none = F.array().cast(f"array<{TURN}>")
    clean = lambda c: F.transform(F.coalesce(F.col(c), none), lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    df = pairs.withColumns({a: clean(chosen), b: clean(rejected)}).drop(chosen, rejected)
    df = df.withColumn("n_prompt_turns", common_turns(F.col(a), F.col(b)))
    n = F.col("n_prompt_turns")
    rest = lambda c: F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    df = df.withColumns({"prompt": render(F.slice(F.col(a), F.lit(1), n)), a: rest(a), b: rest(b)})
    df = df.withColumns({"chosen_completion": render(F.col(a)), "rejected_completion": render(F.col(b)), "chosen_mask": mask(F.col(a)), "rejected_mask": mask(F.col(b))})
    return df.drop(a, b)


def branch_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) of every conversation (its id a long).

    Chosen is the conversation. Rejected parts from it at one of its assistant turns, which one goes by the id: the
    turn there says what the last assistant turn says, or, if it is the last one itself, echoes the text before it
    (nothing, if it is the first of all). Where that turn is the first, third ... of the assistant's, the turns after
    it stay; otherwise the branch ends there. Without an assistant turn both sides are equal, so completions are empty.
    """
    df = conversations(turns)
    numbered = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i))
    df = df.withColumn("own", F.filter(numbered, lambda i: i.isNotNull()))
    df = df.withColumn("which", F.when(F.size("own") > 0, F.expr("pmod(conv_id, size(own))").cast("int")))
    df = df.withColumn("at", F.get("own", F.col("which")))
    last = F.try_element_at("own", F.lit(-1))
    said = F.when(F.col("at") < last, F.get("turns", last)["text"]).otherwise(F.coalesce(F.get("turns", F.col("at") - 1)["text"], F.lit("")))
    branch = F.concat(
        F.slice("turns", F.lit(1), F.col("at")),
        F.array(F.struct(F.lit("assistant").alias("role"), said.alias("text"))),
        F.when(F.col("which") % 2 == 0, F.slice("turns", F.col("at") + 2, F.size("turns"))).otherwise(F.array().cast(f"array<{TURN}>")),
    )
    return df.select("conv_id", F.col("turns").alias("chosen"), F.when(F.col("at").isNull(), F.col("turns")).otherwise(branch).alias("rejected"))


def op1_preferences(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return _written(format_preferences(branch_pairs(read_table(spark, sf_dir, "conversations"))))


def _written(df: DataFrame) -> DataFrame:
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return df.select("conv_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen_completion", "rejected_completion", written("chosen_mask"), written("rejected_mask"))


OP1_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, max(pos) AS size, list(pos ORDER BY pos) FILTER (role = 'assistant') AS own FROM t GROUP BY conv_id
), w AS (
  SELECT conv_id, size, own, ((conv_id % len(own)) + len(own)) % len(own) AS which, own[((conv_id % len(own)) + len(own)) % len(own) + 1] AS at, own[len(own)] AS last FROM c
), s AS (
  SELECT w.*, CASE WHEN w.at < w.last THEN l.text ELSE coalesce(b.text, '') END AS said
  FROM w LEFT JOIN t l ON l.conv_id = w.conv_id AND l.pos = w.last LEFT JOIN t b ON b.conv_id = w.conv_id AND b.pos = w.at - 1
), r AS (
  SELECT t.conv_id, t.pos, t.role, CASE WHEN t.pos = s.at THEN s.said ELSE t.text END AS text
  FROM t JOIN s ON t.conv_id = s.conv_id WHERE s.at IS NULL OR t.pos <= s.at OR s.which % 2 = 0
), n AS (
  SELECT c.conv_id, coalesce(min(x.pos) - 1, max(c.size)) AS shared FROM c
  LEFT JOIN (SELECT t.conv_id, t.pos FROM t LEFT JOIN r ON t.conv_id = r.conv_id AND t.pos = r.pos WHERE r.pos IS NULL OR t.role <> r.role OR t.text <> r.text) x ON c.conv_id = x.conv_id
  GROUP BY c.conv_id
), m AS (
  SELECT conv_id, side, pos, role, length(text) AS len, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM (SELECT conv_id, 'c' AS side, pos, role, text FROM t UNION ALL SELECT conv_id, 'r', pos, role, text FROM r)
), p AS (
  SELECT m.*, n.shared, sum(CASE WHEN pos > shared THEN length(shown) ELSE 0 END) OVER (PARTITION BY m.conv_id, side ORDER BY pos) AS stop FROM m JOIN n ON m.conv_id = n.conv_id
), f AS (
  SELECT conv_id, side, max(shared) AS shared, coalesce(string_agg(CASE WHEN pos <= shared THEN shown END, '' ORDER BY pos), '') AS prompt, coalesce(string_agg(CASE WHEN pos > shared THEN shown END, '' ORDER BY pos), '') AS completion,
    coalesce(string_agg(CASE WHEN pos > shared AND role = 'assistant' THEN CAST(stop - len - 8 AS VARCHAR) || ':' || CAST(stop AS VARCHAR) END, ',' ORDER BY pos), '') AS mask
  FROM p GROUP BY conv_id, side
)
SELECT a.conv_id, CAST(a.shared AS BIGINT) AS n_prompt_turns, a.prompt, a.completion AS chosen_completion, b.completion AS rejected_completion, a.mask AS chosen_mask, b.mask AS rejected_mask
FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.side = 'c' AND b.side = 'r'
"""
