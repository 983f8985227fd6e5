"""Pinned tables: a manifest says which files a table consists of, and reading checks that they are still those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file string, length long, digest string"


def files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(file, length, digest) of the table's data files: a task reads a file, SHA-256 is worked out where it is. Files stay under 2 GB, as
    Spark's binary reader demands. Names are relative to the table, so a copied table has the same manifest."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    # A table may be one file or a folder of files.
    name = F.regexp_extract("path", r"([^/]+)/*$", 1)
    base = path.rstrip("/").rsplit("/", 1)[-1]
    inside = F.substring_index("path", f"/{base}/", -1)
    return found.select(F.when(F.instr("path", f"/{base}/") > 0, inside).otherwise(name).alias("file"), F.col("length"), F.sha2("content", 256).alias("digest"))


def pin(spark: SparkSession, path: str, to: str, revision: str) -> DataFrame:
    """Writes the manifest of a table under ``to``, by the name of its revision; an existing revision is never overwritten."""
    files(spark, path).withColumn("revision", F.lit(revision)).coalesce(1).write.mode("errorifexists").json(f"{to}/{revision}")
    return spark.read.schema(f"{MANIFEST}, revision string").json(f"{to}/{revision}")


def changes(now: DataFrame, pinned: DataFrame) -> DataFrame:
    """(file, change) of files that were added, removed or changed since a manifest."""
    both = pinned.select("file", F.struct("length", "digest").alias("was")).join(now.select("file", F.struct("length", "digest").alias("is")), "file", "full_outer")
    what = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("was").eqNullSafe(F.col("is"))).select("file", what.alias("change"))


def read_pinned(spark: SparkSession, path: str, manifest: str, revision: str, shown: int = 10) -> DataFrame:
    """The table at ``path``, if its files are those of the revision; else an error that names the first of the others."""
    pinned = spark.read.schema(f"{MANIFEST}, revision string").json(f"{manifest}/{revision}")
    if pinned.where(F.col("revision") == revision).isEmpty():
        raise ValueError(f"{manifest} has no revision {revision}")
    first = changes(files(spark, path), pinned).orderBy("file").limit(shown).collect()
    if first:
        raise ValueError(f"{path} isn't revision {revision}: " + ", ".join(f"{r.file} was {r.change}" for r in first))
    return spark.read.parquet(path)
