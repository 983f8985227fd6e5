"""Reading and freezing splits, and writing reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from . import shared
from .pinned import read_pinned


def load_source(spark: SparkSession, path: str, size: int | None = None, seed: int = 42, key: str = "example_id", manifest: str | None = None, revision: str | None = None) -> DataFrame:
    """A source table with question and answer, or a seeded sample of it. With a manifest and a revision (see ``pinned``) its files must be those of the revision."""
    rows = read_pinned(spark, path, manifest, revision) if manifest and revision else spark.read.parquet(path)
    return splits.sample(splits.check_columns(rows), size, seed, key)


def freeze(df: DataFrame, test: DataFrame, path: str, fraction: float = 0.15, seed: int = 42, key: str = "example_id", source: str | None = None, revision: str | None = None, digest_parts: int | None = None) -> DataFrame:
    """Writes train, validation and test under ``path`` and returns their manifest; never overwrites.

    The splits must share no example. The manifest tells source, revision and library version too. With ``digest_parts`` digests
    are those of ``splits.part_hash``, for splits beyond some ten million rows.
    """
    splits.check_source(df)
    splits.check_source(test)
    parts = splits.assign(df, fraction, seed, key).unionByName(test.withColumn("split", F.lit("test")))
    splits.check_disjoint(parts)
    parts.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    manifest = splits.part_hash(rows, key, "split", parts=digest_parts) if digest_parts else splits.ordered_hash(rows, key, "split")
    about = {"seed": seed, "validation_fraction": fraction, "source": source or "", "revision": revision or "", "library": f"pyspark {df.sparkSession.version}", "digest_parts": digest_parts or 0}
    manifest = manifest.withColumns({name: F.lit(value) for name, value in about.items()})
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return df.sparkSession.read.json(f"{path}/manifest")


def load_split(spark: SparkSession, path: str, split: str, size: int | None = None, seed: int = 42, key: str = "example_id") -> DataFrame:
    """One frozen split; only its partition is read."""
    rows = spark.read.parquet(f"{path}/rows")
    if "split" not in rows.columns:
        raise ValueError(f"{path} holds no splits")
    part = rows.where(F.col("split") == split)
    if part.isEmpty():
        raise ValueError(f"unknown split: {split}")
    return splits.sample(splits.check_columns(part), size, seed, key)


def prompt(spark: SparkSession, path: str) -> tuple[str, str]:
    """(text, SHA-256) of a system prompt on any file system that Spark knows; missing and empty files are errors."""
    text = shared.read_text(spark, path).strip()
    if not text:
        raise ValueError(f"{path} is empty")
    return text, hashlib.sha256(text.encode()).hexdigest()


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """One JSON document, indented, with non-ASCII characters as they are; it replaces an older one as a whole."""
    shared.write_text(spark, json.dumps(report, ensure_ascii=False, indent=2) + "\n", path)


def log_line(event: str, **fields) -> str:
    """One JSON object with sorted keys, as logs have it; also printed."""
    line = json.dumps({"event": event, **fields}, sort_keys=True, ensure_ascii=False)
    print(line, flush=True)
    return line


def write_lines(rows: DataFrame, event: str, path: str) -> None:
    """Every row as a log line: one JSON object with sorted keys, nulls and doubles that JSON can't hold as null. Never overwrites.

    Lines are written by all executors and committed together by Spark: what failed or repeated tasks wrote isn't seen, and a job that fails leaves no lines.
    """
    from ..operators.evaluation import json_safe

    if "event" in rows.columns:
        raise ValueError("event is the name of the line's own field")
    named = json_safe(rows).withColumn("event", F.lit(event))
    fields = F.struct(*(F.col(f"`{c}`") for c in sorted(named.columns)))
    named.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def positive(value: str, kind: type = int):
    """A command-line number that must be finite and positive."""
    import math

    got = kind(value)
    if not math.isfinite(got) or got <= 0:
        raise ValueError(f"{value} is not positive")
    return got
