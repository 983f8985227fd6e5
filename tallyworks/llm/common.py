"""What the operators of this subpackage share: reading tables, shared folders, sizes, words."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of "words" [^\x20\x09-\x0D]+, as characters.
BLANKS = " \t\n\x0b\f\r"
#: The same as a regular expression, for Java.
BLANK_RUN = r"[ \x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, for checkpoints and written tables.

    It is what the session's ``spark.checkpoint.dir`` names. Where that is unset, a local session (one
    process, as in tests) gets a temporary folder, and a cluster is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of a text column, by a sum over it."""
    return df.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0


def fresh(df: DataFrame) -> str:
    """A prefix that no column's name begins with, for columns of an operator's own."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places: functions over Arrow batches don't take every name."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; empty for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN, -1))


def hex64(value: Column) -> Column:
    """16 lower-case hexadecimal digits of a long, taken as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
