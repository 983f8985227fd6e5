"""Native scans of annotated text: matches, spans, fields, interval islands. Flags make Java's classes match Unicode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exact

#: (?s) dot matches all, (?d) only \n ends a line, (?U) Unicode classes.
ANNOTATION = r"(?sdU)<<(.*?)(>>|$)"
MARKED = rf"(?U)####\s*({exact.NUMBER_OR_RATIO})\s*\z"
STANDALONE = rf"(?U)(?<![\w.-])({exact.NUMBER_OR_RATIO})(?![\w/-]|\.\d)"


BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def matches(text: Column, pattern: str) -> Column:
    """Array of (text, start, end) of all matches, in code points: gaps and matches alternate.

    Places are summed up within blocks of matches and blocks are moved to where they begin, so no long array is copied for each match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m")), lambda x: x["m"].isNotNull())
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(x["m"].alias("text"), start.alias("start"), end.alias("end")))).alias("out"))

    def blocks(p: Column) -> Column:
        starts = F.when(F.size(p) > 0, F.sequence(F.lit(1), F.size(p), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda b: F.aggregate(F.slice(p, b, F.lit(BLOCK)), empty, step))

    def moved(done: Column) -> Column:
        begins = F.aggregate(done, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["at"])))
        placed = F.transform(F.filter(F.arrays_zip(done.alias("b"), begins.alias("o")), lambda z: z["b"].isNotNull()), lambda z: F.transform(z["b"]["out"], lambda y: F.struct(y["text"].alias("text"), (y["start"] + z["o"]).alias("start"), (y["end"] + z["o"]).alias("end"))))
        return F.flatten(placed)

    return _let(_let(pieces, blocks), moved)


def annotations(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row for each annotation: index, raw, start, end, closed, and the trimmed expression and claim texts (split at the last "=")."""
    rows = df.select(*keep, F.posexplode(matches(F.col(text), ANNOTATION)).alias("index", "m"))
    raw = F.col("m.text")
    closed = raw.endswith(">>") & (F.length(raw) >= 4)
    body = F.when(closed, F.substr(raw, F.lit(3), F.length(raw) - 4)).otherwise(F.substr(raw, F.lit(3)))
    rows = rows.select(*keep, "index", raw.alias("raw"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), closed.alias("closed"), body.alias("__body"))
    equals = F.when(F.instr("__body", "=") > 0, F.length("__body") - F.instr(F.reverse("__body"), "=") + 1)
    rows = rows.withColumn("__at", equals)
    blank = r"^(?U)\s+|(?U)\s+$"
    trimmed = lambda c: F.nullif(F.regexp_replace(c, blank, ""), F.lit(""))
    left = F.when(F.col("__at").isNotNull(), F.substr("__body", F.lit(1), F.col("__at") - 1)).otherwise(F.col("__body"))
    right = F.when(F.col("__at").isNotNull(), F.substr("__body", F.col("__at") + 1))
    return rows.select(*keep, "index", "raw", "start", "end", "closed", trimmed(left).alias("expression"), trimmed(right).alias("claimed_text"))


def marked_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, MARKED, 1), F.lit(""))


def last_standalone(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(STANDALONE), F.lit(1)), F.lit(-1))


def decimal_places(number: Column) -> Column:
    """Stated decimal places; null for a ratio."""
    plain = F.regexp_replace(number, "[, ]", "")
    return F.when(~F.contains(plain, F.lit("/")), F.length(F.regexp_extract(plain, r"\.(.*)$", 1)))


def extract(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def merge_spans(spans: DataFrame, *by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Islands of overlapping or touching spans in each group; empty spans are dropped."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.where(F.col(end) > F.col(start)).withColumn("__new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    rows = rows.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def delete_spans(text: Column, spans: Column) -> Column:
    """``text`` without sorted, disjoint spans (array of (start, end))."""
    before = F.transform(spans, lambda x, i: extract(text, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0), x["start"]))
    return F.concat(F.array_join(before, ""), F.substr(text, F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)) + 1))


def mend_blanks(text: Column) -> Column:
    """Blanks around annotations after deletions."""
    # Fixed patterns.
    text = F.regexp_replace(text, r">>(?=[A-Za-z0-9$€£])", ">> ")
    return F.regexp_replace(F.replace(text, F.lit(">><<"), F.lit(">>\n<<")), r">>[ \t]+(?=[.,;:!?])", ">>")
