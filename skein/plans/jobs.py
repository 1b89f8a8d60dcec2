"""Jobs on the driver: background runs with progress, and the handlers of queued tasks."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Job:
    name: str
    status: str = "queued"
    progress: float = 0.0
    result: Any = None
    error: str | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex)


class Jobs:
    """Handlers by name, each run of one in a thread of its own."""

    def __init__(self, handlers: dict[str, Callable[..., Any]]):
        self.handlers, self._jobs, self._lock, self._threads = handlers, {}, threading.Lock(), {}

    def submit(self, name: str, **arguments: Any) -> str:
        if name not in self.handlers:
            raise ValueError(f"no handler called {name!r}")
        job = Job(name)
        self._jobs[job.id] = job

        def report(share: float) -> None:
            with self._lock:
                job.progress = min(1.0, max(0.0, share))

        def run() -> None:
            job.status = "running"
            try:
                job.result = self.handlers[name](report=report, **arguments)
                job.status, job.progress = "done", 1.0
            except Exception as e:  # noqa: BLE001
                job.status, job.error = "failed", str(e)

        self._threads[job.id] = threading.Thread(target=run, daemon=True)
        self._threads[job.id].start()
        return job.id

    def status(self, job_id: str) -> Job | None:
        return self._jobs.get(job_id)

    def wait(self, job_id: str, seconds: float | None = None) -> Job:
        self._threads[job_id].join(seconds)
        return self._jobs[job_id]


def observed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its row count reported to query listeners under ``name``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def histogram(runs: DataFrame, job: str, value: str, bounds: list[float]) -> DataFrame:
    """(job, bucket, n): runs by the first bound that reaches their value, the last bucket for those beyond all."""
    bucket = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col(value) <= bounds[i], i).otherwise(bucket)
    return runs.where(F.col(value).isNotNull()).groupBy(F.col(job).alias("job"), bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
