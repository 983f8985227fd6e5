"""Totals of streams: each micro-batch commits a small table of figures that add up, once, and totals are merged from these.

Streams of row-local work (audits, scores) need no state of Spark's for their reports. A micro-batch works its figures out beside
their place and moves them there under its number. One that Spark runs again after a failure finds them and changes nothing, and so does
a stream that is read again from its beginning with the same micro-batches. Committed figures are folded into one base from time to time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources import shared


class Totals:
    """The committed figures of one stream, in one folder of a file system that driver and executors share.

    ``summarize`` makes figures of rows, ``merge`` makes the same columns of the figures of parts: audit.sums and audit.merge,
    evaluation.sums and evaluation.merge, or a history twice. An instance is a foreachBatch function. A folder has one writer. A batch of
    no rows commits what ``summarize`` says of none.
    """

    def __init__(self, folder: str, summarize: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], fold_every: int = 64) -> None:
        if fold_every < 1:
            raise ValueError("fold_every must be positive")
        self.folder, self.summarize, self.merge, self.fold_every = folder, summarize, merge, fold_every

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        return sorted(int(n.removeprefix(f"{kind}-")) for n in shared.names(spark, self.folder) if n.startswith(f"{kind}-"))

    def _state(self, spark: SparkSession) -> tuple[int, list[int]]:
        """(the last batch in the newest base, or -1; the batches after it)."""
        base = max(self._numbers(spark, "upto"), default=-1)
        return base, [n for n in self._numbers(spark, "batch") if n > base]

    def _commit(self, figures: DataFrame, place: str) -> bool:
        spark, beside = figures.sparkSession, f"{self.folder}/making/{uuid.uuid4().hex}"
        try:
            figures.write.parquet(beside)
            return shared.move(spark, beside, f"{self.folder}/{place}")
        finally:
            shared.remove(spark, beside)

    def __call__(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        base, batches = self._state(spark)
        if number <= base or number in batches:
            return
        self._commit(self.summarize(rows), f"batch-{number}")
        if len(batches) + 1 >= self.fold_every:
            self.fold(spark)

    def read(self, spark: SparkSession) -> DataFrame:
        """The merged figures of all committed batches; nothing committed is an error."""
        base, batches = self._state(spark)
        places = ([f"{self.folder}/upto-{base}"] if base >= 0 else []) + [f"{self.folder}/batch-{n}" for n in batches]
        if not places:
            raise ValueError(f"{self.folder} holds no committed batch")
        return self.merge(spark.read.parquet(*places))

    def fold(self, spark: SparkSession) -> None:
        """Merges all batches into a new base. Until it is in place readers see the old one; what it replaces goes afterwards."""
        base, batches = self._state(spark)
        if batches:
            self._commit(self.read(spark), f"upto-{batches[-1]}")
            base = batches[-1]
        for kind, last in (("batch", base), ("upto", base - 1)):
            for n in self._numbers(spark, kind):
                if n <= last:
                    shared.remove(spark, f"{self.folder}/{kind}-{n}")


def run(spark: SparkSession, path: str, schema: StructType | str, totals: Totals, checkpoint: str, files: int | None = None) -> None:
    """Feeds the Parquet files of a folder to ``totals``, ``files`` of them in a micro-batch, until all that are there are done."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    rows.writeStream.foreachBatch(totals).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
