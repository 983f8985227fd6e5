"""How far Spark has got: rows of streams by a listener, tasks of a batch job by the cluster's own counts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from .tracking import Progress


class StreamProgress(StreamingQueryListener):
    """Adds the rows of every micro-batch of one named query to a ``Progress`` and says how far it has got.

    A micro-batch that Spark runs again counts once, as does each of its rows, however many parts of the query read them.
    """

    def __init__(self, query: str, progress: Progress, say: Callable[[dict], None]) -> None:
        self._query, self._progress, self._say, self._seen = query, progress, say, -1

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self._query and p.batchId > self._seen and p.numInputRows:
            self._seen = p.batchId
            self._say({"batch": p.batchId, **self._progress.add(p.numInputRows)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def job_tasks(spark: SparkSession, group: str) -> dict[str, int]:
    """Completed, running, failed and known tasks of all jobs of a group. Stages that adaptive execution hasn't planned yet aren't known."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if j]
    running = {k for j in jobs if j.status == "RUNNING" for k in j.stageIds}
    stages = [s for s in (tracker.getStageInfo(k) for k in {k for j in jobs for k in j.stageIds}) if s]
    count = lambda name: sum(getattr(s, name) for s in stages)
    known = sum(s.numTasks if s.stageId in running else s.numCompletedTasks for s in stages)  # jobs that are over have skipped what others had worked out
    return {"completed": count("numCompletedTasks"), "running": count("numActiveTasks"), "failed": count("numFailedTasks"), "known": known}


@contextmanager
def watched(spark: SparkSession, say: Callable[[dict], None], seconds: float = 1.0) -> Iterator[str]:
    """Jobs started inside are a group, whose tasks are told every so many seconds while they run, and once at the end."""
    group, over = f"watched-{uuid.uuid4().hex}", threading.Event()

    def watch() -> None:
        while not over.wait(seconds):
            say(job_tasks(spark, group))

    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
    sc.setJobGroup(group, "watched")
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield group
    finally:
        over.set()
        watcher.join()
        for name, value in zip(("spark.jobGroup.id", "spark.job.description"), before, strict=True):
            sc.setLocalProperty(name, value)
        say(job_tasks(spark, group))
