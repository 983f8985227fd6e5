"""Where metrics go while something runs. A tracker has log(metrics, step); remote ones are the caller's."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.evaluation import flatten_metrics
from .frozen import log_line


class LogTracker:
    """Writes every metric as one log line."""

    def log(self, metrics: dict[str, float], step: int) -> None:
        log_line("metrics", step=step, **metrics)


def log_report(report: DataFrame, tracker=None, step: int = 0, prefix: str = "") -> dict[str, float]:
    """Flattens a one-row report and hands it to a tracker."""
    metrics = {r.metric: r.value for r in flatten_metrics(report, prefix).collect()}  # one row for each metric
    (tracker or LogTracker()).log(metrics, step)
    return metrics


def for_each_batch(tracker, summarize: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for streams that logs the summary of each micro-batch."""
    return lambda df, number: None if df.isEmpty() else log_report(summarize(df), tracker, number) and None


class Progress:
    """Completed share, rows a second and seconds left of work that comes in batches."""

    def __init__(self, total: int, clock: Callable[[], float] = time.monotonic) -> None:
        self.total, self.done, self.clock, self.begun = total, 0, clock, clock()

    def add(self, n: int) -> dict[str, float | None]:
        self.done += n
        took = self.clock() - self.begun
        rate = self.done / took if took > 0 else None
        return {"completed_percent": 100 * self.done / self.total, "examples_per_second": rate, "eta_seconds": (self.total - self.done) / rate if rate else None}
