"""Flows that are watched while they run and can be stopped, each by itself: progress of their stages, counts of their rows."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Stopped(RuntimeError):
    """The flow was stopped before it ended."""


class Counted:
    """Counts that come along with a flow, without a pass of their own: what observe() sees of each named point of it."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def at(self, df: DataFrame, name: str, *metrics: Column) -> DataFrame:
        self._seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self._seen[name], *metrics)

    def counts(self) -> dict[str, dict]:
        """By name, once the flow has run."""
        return {name: o.get for name, o in self._seen.items()}


def run(spark: SparkSession, flow: Callable[[], object], progress: Callable[[int, int], None] | None = None, cancel: Callable[[], bool] | None = None, every: float = 0.2):
    """What flow() returns. Meanwhile progress(done, known) gets the tasks of its jobs, whenever they have changed; when cancel() is true
    its jobs are cancelled, and no others, and Stopped is raised.
    """
    sc, tag, box = spark.sparkContext, f"tonearm-{uuid.uuid4().hex}", {}

    def work() -> None:
        sc.addJobTag(tag)
        try:
            box["result"] = flow()
        except BaseException as e:  # handed to the caller below
            box["error"] = e
        finally:
            sc.removeJobTag(tag)

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    stopped, last = False, None
    while thread.is_alive():
        thread.join(every)
        if cancel is not None and not stopped and cancel():
            stopped = True
        if stopped:  # again, as a flow may start its next job
            sc.cancelJobsWithTag(tag)
        elif progress is not None and (now := tasks(spark, tag)) != last:
            last = now
            progress(*now)
    if stopped and "result" not in box:
        raise Stopped(tag) from box.get("error")
    if "error" in box:
        raise box["error"]
    return box["result"]


def tasks(spark: SparkSession, tag: str) -> tuple[int, int]:
    """Tasks that are done and that are known of the stages of all jobs with a tag."""
    tracker, done, known = spark.sparkContext.statusTracker(), 0, 0
    for job in spark._jsc.sc().statusTracker().getJobIdsForTag(tag):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            if (s := tracker.getStageInfo(stage)) is not None:
                done, known = done + s.numCompletedTasks, known + s.numTasks
    return done, known


class Switch:
    """A cancel() that another thread turns."""

    def __init__(self, after: float | None = None) -> None:
        self._event, self._end = threading.Event(), None if after is None else time.monotonic() + after

    def turn(self) -> None:
        self._event.set()

    def __call__(self) -> bool:
        return self._event.is_set() or (self._end is not None and time.monotonic() >= self._end)
