"""Per-example audit figures and their summary, from arrays that one pass over the rows has made."""

from __future__ import annotations

from time import perf_counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .examples import audited

FLAGS = ("all_math_steps_valid", "graph_executable", "program_executable", "program_matches_graph", "program_structure_valid", "provenance_complete", "final_step_identified", "fully_resolved_and_executable")


def _count(array: Column, test=None) -> Column:
    return F.size(array if test is None else F.filter(array, test)).cast("long")


def _nested(array: Column, name: str) -> Column:
    return F.flatten(F.transform(array, lambda x: x[name]))


def metrics(rows: DataFrame) -> DataFrame:
    """One row of figures for each analyzed row; nothing is shuffled."""
    steps = F.col("steps")
    rows = rows.withColumns({"__nodes": _nested(steps, "nodes"), "__actions": _nested(steps, "actions")})
    rows = rows.withColumn("__operands", _nested(F.col("__actions"), "operands"))
    n = F.size("steps")
    valid = _count(steps, lambda s: s["valid"])
    executed = lambda r, e: (n > 0) & F.forall(steps, lambda s: s[r].isNotNull() & s[e].isNull())
    references = lambda s: F.transform(F.filter(_nested(s["actions"], "operands"), lambda o: o["kind"] == "previous_result"), lambda o: o["ref"])
    repeated = F.aggregate(F.transform(steps, lambda s: F.size(references(s)) - F.size(F.array_distinct(references(s)))), F.lit(0), lambda a, x: a + x)
    masked = lambda mask: F.exists(mask, lambda m: ~m)
    rows = rows.withColumns({
        "math_steps": n.cast("long"), "valid_math_steps": valid, "all_math_steps_valid": (n > 0) & (valid == n),
        "reference_edges": _count(_nested(steps, "dependencies")), "unresolved_operands": _count(F.col("__nodes"), lambda x: x["kind"] == "unresolved"),
        "reference_operands": _count(F.col("__nodes"), lambda x: x["kind"] == "previous_result"),
        "final_step_identified": F.exists(steps, lambda s: s["is_final"]),
        "graph_executable": executed("graph_result", "graph_error"), "program_executable": executed("program_result", "program_error"),
        "program_steps_matching_graph": _count(steps, lambda s: s["graph_result"].eqNullSafe(s["program_result"])),
        "program_structure_issues": _count(F.col("issues")), "postfix_actions": _count(F.col("__actions")), "postfix_operands": _count(F.col("__operands")),
        "masked_operands": _count(F.col("__operands"), lambda o: o["kind"] == "unresolved"),
        "actions_with_masked_operands": _count(F.col("__actions"), lambda a: masked(a["mask"])),
        "steps_with_masked_operands": _count(steps, lambda s: F.exists(s["actions"], lambda a: masked(a["mask"]))),
        "multi_action_steps": _count(steps, lambda s: F.size(s["actions"]) > 1),
        "max_actions_per_step": F.coalesce(F.array_max(F.transform(steps, lambda s: F.size(s["actions"]))), F.lit(0)).cast("long"),
        "repeated_previous_results": repeated.cast("long"),
    })
    rows = rows.withColumns({
        "provenance_complete": F.col("all_math_steps_valid") & (F.col("unresolved_operands") == 0),
        "program_matches_graph": F.col("program_steps_matching_graph") == F.col("math_steps"),
        "program_structure_valid": F.col("program_structure_issues") == 0,
    })
    return rows.withColumn("fully_resolved_and_executable", F.col("provenance_complete") & F.col("graph_executable")).drop("__nodes", "__actions", "__operands")


def audit(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Analyzed and measured rows; ``df`` must have rows."""
    return metrics(audited(df, question, answer))


SUMS = (
    "math_steps", "valid_math_steps", "reference_edges", "reference_operands", "unresolved_operands", "program_steps_matching_graph", "program_structure_issues", "postfix_actions", "postfix_operands",
    "masked_operands", "actions_with_masked_operands", "steps_with_masked_operands", "multi_action_steps", "repeated_previous_results",
)


def sums(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """One row of figures that add up, from per-example figures in one aggregation: sums, counts, and the extremes of target scales and candidates.

    A row counts as often as its column ``weight`` says (none: once).
    """
    scales = F.col("scales")
    times = F.lit(1).cast("long") if weight is None else F.col(weight)
    how_many = lambda test: F.coalesce(F.sum(F.when(test, F.col("__times"))), F.lit(0))
    small = rows.select(
        times.alias("__times"), *SUMS, "max_actions_per_step", *FLAGS, F.filter(F.transform("steps", lambda s: s["target_scale"]), lambda x: x.isNotNull()).alias("scales"),
        F.forall("steps", lambda s: s["target"].isNull() | s["target_scale"].isNotNull()).alias("finite"),
        F.array_max(F.transform(_nested(F.col("steps"), "nodes"), lambda x: F.size(x["candidates"]))).alias("candidates"),
    )
    return small.agg(
        how_many(F.lit(True)).alias("examples"), *(F.sum(F.col(c) * F.col("__times")).alias(c) for c in SUMS), F.max("max_actions_per_step").alias("max_actions_per_step"), *(how_many(F.col(c)).alias(f"examples_{c}") for c in FLAGS),
        how_many(F.col("math_steps") == 0).alias("examples_without_math_steps"),
        how_many((F.col("math_steps") > 0) & ~F.col("final_step_identified")).alias("examples_with_steps_without_final"),
        F.coalesce(F.sum(F.size(scales) * F.col("__times")), F.lit(0)).alias("target_scales"), F.min(F.array_min(scales)).alias("target_scale_min"), F.max(F.array_max(scales)).alias("target_scale_max"),
        F.coalesce(F.bool_and("finite"), F.lit(True)).alias("target_scales_all_finite"), F.coalesce(F.max("candidates"), F.lit(0)).cast("long").alias("max_candidates_per_operand"),
    )


def merge(parts: DataFrame) -> DataFrame:
    """The ``sums`` of all rows from the ``sums`` of parts of them; in any order, and again over its own results."""
    how = {"target_scale_min": F.min, "target_scale_max": F.max, "max_actions_per_step": F.max, "max_candidates_per_operand": F.max, "target_scales_all_finite": F.bool_and}
    return parts.agg(*(how.get(c, F.sum)(c).alias(c) for c in parts.columns))


def rates(sums: DataFrame) -> DataFrame:
    """``sums`` and the rates that follow from them; those of no examples are null."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return sums.withColumns({
        **{f"{c}_rate": F.try_divide(F.col(f"examples_{c}"), F.col("examples")) for c in FLAGS},
        "valid_math_step_rate": over("valid_math_steps", "math_steps"),
        "operand_supervision_rate": F.coalesce(1 - F.try_divide(F.col("masked_operands"), F.col("postfix_operands")), F.lit(0.0)),
    })


def summary(rows: DataFrame) -> DataFrame:
    """One row: sums, counts, rates and the distribution of target scales."""
    return rates(sums(rows))


def scale_percentiles(rows: DataFrame, percents: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row of nearest-rank percentiles of all steps' target scales (null if there are none).

    Scales are counted by 64 ranges an octave, some 65,000 at most; only the different values of the ranges that hold the
    wanted ranks are ranked.
    """
    scales = rows.select(F.explode("steps.target_scale").alias("x")).where("x IS NOT NULL")
    scales = scales.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    scales = scales.withColumn("at", F.coalesce(F.floor(F.log2(F.greatest("x", F.lit(1.0))) * 64), F.lit(0)))  # never null: the join adds no filter, so both uses share one pass
    order = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = scales.groupBy("at").agg(F.sum("n").alias("size"))
    ranges = ranges.select("at", "size", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy(F.lit(0))).alias("total"))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.greatest(F.ceil(F.lit(p) * F.col("total")), F.lit(1)).alias("rank")) for k, p in enumerate(percents)))).alias("w")
    ranges = ranges.select("at", "size", "before", wanted).where("w.rank > before AND w.rank <= before + size")
    upto = Window.partitionBy("w.k").orderBy("x")
    found = scales.join(F.broadcast(ranges), "at").withColumn("reach", F.col("before") + F.sum("n").over(upto))  # one range for each percentile
    return found.where("w.rank <= reach").agg(*(F.min(F.when(F.col("w.k") == k, F.col("x"))).alias(f"p{round(p * 100)}") for k, p in enumerate(percents)))


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def node_kinds(rows: DataFrame, *by: str) -> DataFrame:
    nodes = rows.select(*by, F.explode("steps").alias("s")).select(*by, F.explode("s.nodes").alias("x"))
    return _counted(nodes.select(*by, F.col("x.kind").alias("kind")), *by, "kind")


def actions(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each action."""
    steps = rows.select(*keep, F.explode("steps").alias("s")).select(*keep, F.col("s.index").alias("step"), F.posexplode("s.actions").alias("action", "a"))
    return steps.select(*keep, "step", "action", "a.operator", "a.supervised", "a.operands", "a.mask")


def operator_counts(rows: DataFrame) -> DataFrame:
    return _counted(actions(rows), "operator", "supervised")


def operand_kinds(rows: DataFrame) -> DataFrame:
    return _counted(actions(rows).select(F.explode("operands").alias("o")).select(F.col("o.kind").alias("kind")), "kind")


def unresolved_reasons(rows: DataFrame) -> DataFrame:
    """Counts of unresolved operands by why, and by how many candidates they have."""
    nodes = rows.select(F.explode("steps").alias("s")).select(F.explode("s.nodes").alias("x")).where("x.kind = 'unresolved'")
    of = lambda kind: F.size(F.filter("x.candidates", lambda c: c["kind"] == kind))
    own, earlier = of("problem_number"), of("previous_result")
    why = F.when((own > 0) & (earlier > 0), "problem_and_previous_step").when(own > 1, "multiple_problem_occurrences").when(earlier > 1, "multiple_previous_steps").otherwise("multiple_candidates")
    return _counted(nodes.select(why.alias("reason"), F.size("x.candidates").cast("long").alias("candidates")), "reason", "candidates")


def issue_counts(rows: DataFrame) -> DataFrame:
    return _counted(rows.select(F.explode("issues").alias("i")).select(F.col("i.code").alias("code")), "code")


def gate(rows: DataFrame) -> None:
    """An error if a program breaks its graph's structure or result."""
    bad = rows.agg(F.sum("program_structure_issues").alias("issues"), F.sum(F.col("math_steps") - F.col("program_steps_matching_graph")).alias("mismatches")).first()
    if bad.issues is None:
        raise ValueError("there are no rows to audit")
    if bad.issues or bad.mismatches:
        raise ValueError(f"{bad.issues} structural issues, {bad.mismatches} results that differ")


def result_hashes(rows: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, digest) of what an analysis found; equal for any partitioning."""
    return rows.select(key, F.sha2(F.to_json(F.struct("issues", "numbers", "steps")), 256).alias("digest"))


def hash_differences(a: DataFrame, b: DataFrame, key: str = "example_id") -> DataFrame:
    """Keys whose digests differ, or that one side lacks."""
    both = a.withColumnRenamed("digest", "a").join(b.withColumnRenamed("digest", "b"), key, "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def require_same(a: DataFrame, b: DataFrame, key: str = "example_id", shown: int = 10) -> None:
    """An error that names the first keys whose digests differ."""
    different = hash_differences(a, b, key)
    first = [r[0] for r in different.select(key).orderBy(key).limit(shown).collect()]
    if first:
        raise ValueError(f"{different.count()} analyses differ, the first of {first}")


def invariant_violations(rows: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, step, code) of records that can't be: references past what there is, spans and masks that don't fit."""
    steps = rows.select(key, F.size("numbers").alias("numbers"), F.explode("steps").alias("s")).select(key, "numbers", "s.*")
    outside = lambda x, kind, bound: (x["kind"] == kind) & (x["ref"].isNull() | (x["ref"] < 0) | (x["ref"] >= bound))
    named = lambda x: outside(x, "problem_number", F.col("numbers"))
    future = lambda x: outside(x, "previous_result", F.col("index"))
    bad_node = lambda n, test: test(n) | F.exists(n["candidates"], test)
    operands = F.flatten(F.transform("actions", lambda a: a["operands"]))
    tests = {
        "span_order": (F.col("start") < 0) | (F.col("end") <= F.col("start")),
        "problem_number_bounds": F.exists("nodes", lambda n: bad_node(n, named)) | F.exists(operands, lambda o: bad_node(o, named)),
        "future_reference": F.exists("nodes", lambda n: bad_node(n, future)) | F.exists(operands, lambda o: bad_node(o, future)) | F.exists("dependencies", lambda d: (d < 0) | (d >= F.col("index"))),
        "future_action": F.exists(F.transform("actions", lambda a, i: F.exists(a["operands"], lambda o: outside(o, "local_result", i))), lambda x: x),
        "candidate_count": F.exists("nodes", lambda n: (n["kind"] == "unresolved") != (F.size(n["candidates"]) > 1)),
        "mask_width": F.exists("actions", lambda a: F.size(a["mask"]) != F.size(a["operands"])),
        "invalid_step_with_actions": ~F.col("valid") & (F.size("actions") > 0),
    }
    codes = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in tests.items())), lambda c: c.isNotNull())
    return steps.select(key, F.col("index").alias("step"), F.explode(codes).alias("code"))


def throughput(rows: DataFrame) -> dict[str, float]:
    """Rows, partitions that had some, seconds and rows a second of a pass over ``rows``; figures that differ from run to run."""
    begin = perf_counter()
    got = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("p")).first()
    seconds = perf_counter() - begin
    return {"examples": got.n, "partitions": got.p, "seconds": seconds, "examples_per_second": got.n / seconds if seconds > 0 else 0.0}
