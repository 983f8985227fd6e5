"""The row-local work on streams: scoring and auditing need no state, so files are worked on as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import evaluation


def responses(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def score_files(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Scores (question, reference, generated_text) files as they arrive, once each."""
    rows = evaluation.score(responses(spark, path, "question string, reference string, generated_text string")).drop("formulas")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
