"""A registry of runs on any file system that Spark knows: what started, what finished or failed, and what was logged on the way.

A run is a folder with small documents that are created once and never changed: ``started``, one for each logged step, and ``ended``.
Who creates a document first has it, so two writers of one run, an end without a start and a second end are errors.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

STATES = "run string, event string, writer string, at double, config string, summary map<string,double>, error string"
METRICS = "run string, step long, metrics map<string,double>"


def _finite(metrics: dict) -> dict[str, float]:
    """Numbers that JSON can hold; no booleans."""
    return {k: float(v) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)}


class Run:
    """One started run; a tracker, and a context that finishes, or fails with what it was left by."""

    def __init__(self, spark: SparkSession, folder: str, name: str, writer: str, clock: Callable[[], float]) -> None:
        self._spark, self._folder, self.name, self._writer, self._clock = spark, folder, name, writer, clock

    def _write(self, place: str, **fields) -> bool:
        return shared.write_once(self._spark, json.dumps({"run": self.name, **fields}, ensure_ascii=False) + "\n", f"{self._folder}/{place}/{self.name}.json")

    def _require_mine(self) -> None:
        at = f"{self._folder}/started/{self.name}.json"
        if not shared.exists(self._spark, at):
            raise ValueError(f"run {self.name} has no start")
        if json.loads(shared.read_text(self._spark, at))["writer"] != self._writer:
            raise ValueError(f"run {self.name} has another writer")

    def log(self, metrics: dict[str, float], step: int) -> None:
        """Commits the finite numbers of a step; a step that was logged before is an error."""
        if shared.exists(self._spark, f"{self._folder}/ended/{self.name}.json"):
            raise ValueError(f"run {self.name} has ended")
        if not self._write(f"logged/{step}", step=step, metrics=_finite(metrics)):
            raise ValueError(f"run {self.name} has logged step {step}")

    def _end(self, event: str, **fields) -> None:
        self._require_mine()
        if not self._write("ended", event=event, writer=self._writer, at=self._clock(), **fields):
            raise ValueError(f"run {self.name} has ended")

    def finish(self, summary: dict[str, float] | None = None) -> None:
        self._end("finished", summary=_finite(summary or {}))

    def fail(self, error: BaseException | str) -> None:
        self._end("failed", error=error if isinstance(error, str) else f"{type(error).__name__}: {error}")

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if shared.exists(self._spark, f"{self._folder}/ended/{self.name}.json") and kind is None:
            return  # finished inside, with a summary
        self.finish() if kind is None else self.fail(error)


class Registry:
    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time) -> None:
        self._spark, self._folder, self._clock = spark, folder.rstrip("/"), clock

    def start(self, name: str, /, **config) -> Run:
        """Starts a run; its name must be new and name a file."""
        if not name or any(c in name for c in "/\\:*?{}[]") or name.startswith(("_", ".")):
            raise ValueError(f"{name!r} can't be a run's name")
        run = Run(self._spark, self._folder, name, uuid.uuid4().hex, self._clock)
        if not run._write("started", event="started", writer=run._writer, at=self._clock(), config=json.dumps(config, sort_keys=True)):
            raise ValueError(f"run {name} has started")
        return run

    def _documents(self, schema: str, *places: str) -> DataFrame:
        there = [p for p in (f"{self._folder}/{x}" for x in places) if shared.exists(self._spark, p)]
        if not there:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).option("recursiveFileLookup", "true").json(there)

    def states(self) -> DataFrame:
        """(run, state, started_at, ended_at, config, summary, error): one row a run, state running, finished or failed."""
        rows = self._documents(STATES, "started", "ended")
        of = lambda c, ended: F.any_value(F.when((F.col("event") != "started") == F.lit(ended), F.col(c)), F.lit(True))
        return rows.groupBy("run").agg(
            F.coalesce(of("event", True), F.lit("running")).alias("state"), of("at", False).alias("started_at"), of("at", True).alias("ended_at"),
            of("config", False).alias("config"), of("summary", True).alias("summary"), of("error", True).alias("error"),
        )

    def metrics(self) -> DataFrame:
        """(run, step, metric, value) of all that was logged."""
        return self._documents(METRICS, "logged").select("run", "step", F.explode("metrics").alias("metric", "value"))
