"""Files that driver and executors share: checkpoints, small documents, moves and removals, all by Spark's own file systems."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    system, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a folder to a place that nobody has taken; False if somebody has."""
    system, where = _at(spark, to)
    if system.exists(where):
        return False
    system.mkdirs(where.getParent())
    return system.rename(_at(spark, path)[1], where)


def write_once(spark: SparkSession, text: str, path: str) -> bool:
    """Creates a small UTF-8 document; False if it is there already. Of many writers one succeeds, where the file system creates files exclusively."""
    from py4j.protocol import Py4JJavaError

    system, where = _at(spark, path)
    try:
        out = system.create(where, False)
    except Py4JJavaError:
        if system.exists(where):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small UTF-8 document of any file system that Spark knows; a missing one is an error."""
    rows = spark.read.text(path, wholetext=True).collect()  # one document
    if len(rows) != 1:
        raise ValueError(f"{path} is no single document")
    return rows[0].value


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Writes a small UTF-8 document: beside its place first, then moved there, so a reader sees the old one or the new one."""
    import uuid

    system, where = _at(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}"
    out = system.create(_at(spark, beside)[1], True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if system.exists(where):
        system.delete(where, False)
    if not system.rename(_at(spark, beside)[1], where):
        raise OSError(f"{path} could not be written")
