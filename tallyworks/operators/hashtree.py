"""Comparing two runs by trees of digests: only what differs is opened.

A run's (key, digest) rows are written by parts, a part being the keys whose own digest begins with the same hexadecimal digits. A
node of the tree stands for such a beginning and has the number and the exclusive or of its rows' digests, so it doesn't depend on
any order and is summed up with partial aggregation. Two trees are compared from the top; of the rows only the parts that differ are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of a part's name: 16^2 parts; a part's rows are sorted by key.
DIGITS = 2


def write_tree(hashes: DataFrame, path: str, key: str = "example_id", digits: int = DIGITS) -> None:
    """Writes rows and tree of a run under ``path``; hashes has the key and digest (hexadecimal SHA-256)."""
    own = F.sha2(F.to_json(F.struct(F.col(key))), 256)
    rows = hashes.select(F.col(key), "digest", F.substring(own, 1, digits).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", key).write.mode("errorifexists").partitionBy("part").parquet(f"{path}/rows")
    kept = hashes.sparkSession.read.schema(f"`{key}` {dict(hashes.dtypes)[key]}, digest string, part string").parquet(f"{path}/rows")
    mixed = F.sha2(F.to_json(F.struct(F.col(key), "digest"), {"ignoreNullFields": "false"}), 256)
    lanes = [F.bit_xor(F.conv(F.substring(mixed, 1 + 12 * k, 12), 16, 10).cast("long")).alias(f"x{k}") for k in range(3)]
    leaves = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *lanes)
    levels = [leaves.groupBy(F.substring("part", 1, d).alias("node")).agg(F.sum("n").alias("n"), *(F.bit_xor(f"x{k}").alias(f"x{k}") for k in range(3))).withColumn("level", F.lit(d)) for d in range(digits + 1)]
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.unionByName(level)
    tree.coalesce(1).write.mode("errorifexists").partitionBy("level").parquet(f"{path}/tree")


def _level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("node string, n long, x0 long, x1 long, x2 long, level int").parquet(f"{path}/tree").where(F.col("level") == level).drop("level")


def different_parts(spark: SparkSession, a: str, b: str, digits: int = DIGITS) -> list[str]:
    """The parts in which two runs differ, found from the top: a level's nodes are looked at only below nodes that differ."""
    nodes = [""]
    for level in range(digits + 1):
        inside = F.col("node").startswith("") if level == 0 else F.substring("node", 1, level - 1).isin(nodes)
        left, right = (_level(spark, p, level).where(inside).select("node", F.struct("n", "x0", "x1", "x2").alias(name)) for p, name in ((a, "l"), (b, "r")))
        # 16 nodes below each one that differs, 16^digits in all
        nodes = sorted(r.node for r in left.join(right, "node", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select("node").collect())
        if not nodes:
            return []
    return nodes


def tree_differences(spark: SparkSession, a: str, b: str, key: str = "example_id", kind: str = "long", digits: int = DIGITS) -> DataFrame:
    """(key, a, b): keys whose digests differ between the runs written at ``a`` and ``b``, or that one of them lacks.

    Only the files of parts that differ are read. Repeated keys are compared as sets of digests.
    """
    parts = different_parts(spark, a, b, digits)
    side = lambda p, name: (
        spark.read.schema(f"`{key}` {kind}, digest string, part string").parquet(f"{p}/rows").where(F.col("part").isin(parts)).groupBy(key).agg(F.concat_ws(",", F.array_sort(F.collect_set("digest"))).alias(name))
    )
    return side(a, "a").join(side(b, "b"), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
