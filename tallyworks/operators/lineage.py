"""Calculation graphs as relations: walks of trees, where operands come from, and what a result rests on.

``examples.analyze`` works a row out as a whole. Here the same questions are put to tables of nodes, numbers and edges, as joins
and array functions, so that two ways can be held against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .examples import with_rows

TREES = (
    "trees array<struct<step:int,valid:boolean,target:string,nodes:array<struct<kind:string,value:string,args:array<int>,over:string,under:string>>>>, "
    "written array<struct<idx:int,value:string,over:string,under:string>>"
)


def walk(nodes: Column) -> Column:
    """Array of (place, depth, node) in pre-order of a tree of nodes in post-order; ``nodes`` are structs with args, at most 64 of them.

    A node's subtree ends with it and is as long as its children's and itself; with the number of subtrees around it, its
    depth, it has the place post - size + 1 + depth. An empty tree has no places.
    """
    sizes = F.aggregate(nodes, F.array().cast("array<int>"), lambda done, n: F.concat(done, F.array(F.aggregate(n["args"], F.lit(1), lambda s, a: s + F.get(done, a)))))
    paired = F.arrays_zip(nodes.alias("node"), sizes.alias("size"))
    depth = lambda at: F.size(F.filter(paired, lambda other, k: (k > at) & (k - other["size"] < at)))
    places = F.transform(paired, lambda x, at: F.struct((at - x["size"] + 1 + depth(at)).cast("int").alias("place"), depth(at).cast("int").alias("depth"), x["node"].alias("node")))
    return F.array_sort(F.transform(places, lambda x: x), lambda a, b: a["place"] - b["place"])


def pre_order(rows: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, step, place, depth, kind, op, value): all nodes of analyzed rows in pre-order. No Python, no shuffle."""
    steps = rows.select(*keep, F.explode("steps").alias("s")).select(*keep, F.col("s.index").alias("step"), F.col("s.nodes").alias("nodes"))
    return steps.select(*keep, "step", F.explode(walk(F.col("nodes"))).alias("w")).select(*keep, "step", "w.place", "w.depth", "w.node.kind", "w.node.op", "w.node.value")


def with_trees(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Adds trees (of valid steps, before any operand is resolved) and written (the question's numbers and the parts of its fractions)."""
    from ..functions import calculation
    from ..functions.question import numbers

    def one(q: str | None, a: str | None) -> dict:
        q = q or ""
        found = numbers(q)
        written = []
        for k, f in enumerate(found):
            parts = calculation._written_parts(q[f.start : f.end], f.value) or (None, None)
            written.append({"idx": k, "value": str(f.value), "over": calculation.text(parts[0]), "under": calculation.text(parts[1])})
        trees = []
        for k, f in enumerate(calculation.steps_of(a or "")[0]):
            nodes = []
            for kind, value, args in (f.nodes or []) if f.correct else []:
                over = under = None
                if kind == "div":
                    x, y = (f.nodes[c] for c in args)
                    if x[0] == y[0] == "number" and x[1].denominator == y[1].denominator == 1 and y[1] and (x[1] / y[1]).denominator != 1:
                        value, over, under = x[1] / y[1], str(x[1]), str(y[1])
                nodes.append({"kind": kind, "value": calculation.text(value), "args": list(args), "over": over, "under": under})
            trees.append({"step": k, "valid": f.correct, "target": calculation.text(f.value), "nodes": nodes})
        return {"trees": trees, "written": written}

    return with_rows(df, [question, answer], TREES, one)


def provenance(trees: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, step, node, kind, ref, candidates): every node of every valid step, resolved by joins.

    A leaf's candidates are the question's numbers with its value (an equi-join on key and value) and the targets of earlier valid
    steps (the same with a range on the step). A division of two whole numbers that the question writes as a fraction, with the
    same parts, is a leaf itself, and its operands are no nodes. Rows of one key are few, so no join has a hot key.
    """
    steps = trees.select(F.col(key), F.explode("trees").alias("t")).where("t.valid").select(key, "t.step", "t.target", "t.nodes")
    nodes = steps.select(key, "step", F.posexplode("nodes").alias("node", "n")).select(key, "step", "node", "n.kind", "n.value", "n.args", "n.over", "n.under")
    written = trees.select(F.col(key), F.explode("written").alias("w")).select(key, "w.*")
    # Divisions that are fractions of the question, and the operands that vanish in them.
    fractions = nodes.where("kind = 'div' AND over IS NOT NULL").join(written.select(key, "over", "under").distinct(), [key, "over", "under"], "left_semi").select(key, "step", "node", "args")
    gone = fractions.select(key, "step", F.explode("args").alias("node"))
    is_fraction = fractions.select(key, "step", "node", F.lit(True).alias("fraction"))
    left = nodes.join(gone, [key, "step", "node"], "left_anti").join(is_fraction, [key, "step", "node"], "left")
    leaf = (F.col("kind") == "number") | F.coalesce(F.col("fraction"), F.lit(False))
    leaves = left.where(leaf).select(key, "step", "node", "value", "over", "under", F.coalesce("fraction", F.lit(False)).alias("fraction"))
    found = written.select(key, "value", F.col("over").alias("w_over"), F.col("under").alias("w_under"), F.lit("problem_number").alias("from"), F.col("idx").alias("ref"))
    own = leaves.join(found, [key, "value"]).where(~F.col("fraction") | (F.col("over") == F.col("w_over")) & (F.col("under") == F.col("w_under"))).select(key, "step", "node", "from", "ref")
    targets = steps.select(key, F.col("target").alias("value"), F.col("step").alias("ref"), F.lit("previous_result").alias("from"))
    earlier = leaves.join(targets, [key, "value"]).where("ref < step").select(key, "step", "node", "from", "ref")
    each = own.unionByName(earlier).groupBy(key, "step", "node").agg(F.array_sort(F.collect_list(F.struct("from", "ref"))).alias("candidates"))
    resolved = leaves.select(key, "step", "node").join(each, [key, "step", "node"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<struct<from:string,ref:int>>")))
    n = F.size("candidates")
    kind = F.when(n == 0, "literal").when(n > 1, "unresolved").otherwise(F.get("candidates", F.lit(0))["from"])
    ref = F.when(n == 1, F.get("candidates", F.lit(0))["ref"])
    out = resolved.select(key, "step", "node", kind.alias("kind"), ref.alias("ref"), F.when(n > 1, F.col("candidates")).otherwise(F.slice("candidates", 1, 0)).alias("candidates"))
    none = F.array().cast("array<struct<from:string,ref:int>>")
    return out.unionByName(left.where(~leaf).select(key, "step", "node", F.lit("operation").alias("kind"), F.lit(None).cast("int").alias("ref"), none.alias("candidates")))


def closure(edges: DataFrame, key: str = "example_id", rounds: int = 40) -> DataFrame:
    """(key, step, rests_on, length): everything that each step rests on by way of others, with the longest way.

    ``edges`` has key, step, dependency, which is an earlier step. Ways are squared: after round r all of 2^r edges are there, so a
    chain of n steps takes about log2(n) rounds; each round is checkpointed. It ends when a round adds nothing.
    """
    from ..sources.shared import checkpoint

    paths = checkpoint(edges.select(key, "step", F.col("dependency").alias("rests_on")).distinct().withColumn("length", F.lit(1).cast("long")))
    size = lambda p: tuple(p.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first())
    before = size(paths)
    for _ in range(rounds):
        onward = paths.select(key, F.col("step").alias("rests_on"), F.col("rests_on").alias("end"), F.col("length").alias("more"))
        longer = paths.join(onward, [key, "rests_on"]).select(key, "step", F.col("end").alias("rests_on"), (F.col("length") + F.col("more")).alias("length"))
        paths = checkpoint(paths.unionByName(longer).groupBy(key, "step", "rests_on").agg(F.max("length").alias("length")))
        now = size(paths)
        if now == before:
            return paths
        before = now
    raise ValueError(f"steps rest on each other by ways of more than 2^{rounds} edges")


def lineage(rows: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, step, depth, rests_on, used) of every step of analyzed rows: the longest chain below it, how many steps that is in all, and
    whether the last step rests on it (or is it)."""
    steps = rows.select(key, F.size("steps").alias("n"), F.explode("steps").alias("s")).select(key, "n", F.col("s.index").alias("step"), F.col("s.dependencies").alias("deps"))
    paths = closure(steps.select(key, "step", F.explode("deps").alias("dependency")), key)
    below = paths.groupBy(key, "step").agg(F.max("length").alias("depth"), F.count(F.lit(1)).alias("rests_on"))
    last = steps.groupBy(key).agg(F.max("n").alias("n"))
    needed = paths.join(last, key).where(F.col("step") == F.col("n") - 1).select(key, F.col("rests_on").alias("step"), F.lit(True).alias("used"))
    out = steps.select(key, "step", "n").join(below, [key, "step"], "left").join(needed, [key, "step"], "left")
    zero = F.lit(0).cast("long")
    return out.select(key, "step", F.coalesce("depth", zero).alias("depth"), F.coalesce("rests_on", zero).alias("rests_on"), (F.coalesce("used", F.lit(False)) | (F.col("step") == F.col("n") - 1)).alias("used"))
