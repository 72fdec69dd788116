"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Result = TypeVar("Result")

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (UTC, AQE, Arrow)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tributary-"))
    return sc.getCheckpointDir().rstrip("/")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result is fixed: later jobs read the same rows whatever executors are
    lost, and each reads only the columns it needs.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parallel(spark: SparkSession, tasks: Sequence[Callable[[], Result]], at_once: int) -> list[Result]:
    """Results of independent tasks that each start jobs, in order, ``at_once`` at a time.

    Each task has a scheduler pool of its own, so that a session with
    ``spark.scheduler.mode=FAIR`` shares its executors between them. The first
    error is raised once all have ended.
    """
    sc = spark.sparkContext

    def pooled(task: Callable[[], Result], name: str) -> Result:
        sc.setLocalProperty("spark.scheduler.pool", name)
        return task()

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        started = [pool.submit(inheritable_thread_target(pooled), t, f"parallel-{i}") for i, t in enumerate(tasks)]
    return [s.result() for s in started]


class OutOfTime(Exception):
    """The time for some work was over before its end."""


class Deadline:
    """A point in time after which work is stopped, its running jobs too."""

    def __init__(self, spark: SparkSession, seconds: float | None) -> None:
        self.sc, self.end = spark.sparkContext, None if seconds is None else time.monotonic() + seconds

    def over(self) -> bool:
        return self.end is not None and time.monotonic() >= self.end

    @contextmanager
    def limit(self):  # noqa: ANN201
        """Jobs started inside are cancelled when time is over; ``OutOfTime`` is raised then."""
        if self.end is None:
            yield
            return
        if self.over():
            raise OutOfTime
        group, before = f"deadline-{uuid.uuid4().hex}", self.sc.getLocalProperty("spark.jobGroup.id")
        done = threading.Event()

        def watch() -> None:
            # Work between two jobs ends with the next one it starts.
            if not done.wait(max(0.0, self.end - time.monotonic())):
                while not done.wait(0.1):
                    self.sc.cancelJobGroup(group)

        self.sc.setJobGroup(group, "within a deadline", interruptOnCancel=True)
        watcher = threading.Thread(target=inheritable_thread_target(watch), daemon=True)
        watcher.start()
        try:
            yield
        except Exception as e:
            if self.over():
                raise OutOfTime from e
            raise
        finally:
            done.set()
            watcher.join()
            self.sc.setLocalProperty("spark.jobGroup.id", before)
