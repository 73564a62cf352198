"""Work in parts that outlives its driver, jobs with states, and draining paged feeds."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from opinara.storage import exists

Phase = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


def run_phases(spark: SparkSession, folder: str, phases: list[tuple[str, Phase]]) -> dict[str, DataFrame]:
    """The tables of named phases, each made from those before it and written below folder; what an earlier run has finished
    is read, not made again. A phase counts as finished once Spark has marked its table."""
    done: dict[str, DataFrame] = {}
    for name, make in phases:
        path = f"{folder}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            make(spark, dict(done)).write.mode("overwrite").parquet(path)
        done[name] = spark.read.parquet(path)
    return done


def finished_phases(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    return [n for n in names if exists(spark, f"{folder}/{n}/_SUCCESS")]


class Jobs:
    """Jobs that wait in line for a few workers: queued, running, then completed with a result or failed with an error."""

    def __init__(self, work: Callable[..., Any], workers: int = 1, most: int = 1000) -> None:
        self._work, self._most, self._jobs, self._lock = work, most, {}, threading.Lock()
        self._pool = ThreadPoolExecutor(workers)

    def _set(self, job_id: str, **values: Any) -> None:
        with self._lock:
            self._jobs[job_id] |= values | {"updated_at": datetime.now(UTC).isoformat()}

    def _run(self, job_id: str, given: dict[str, Any]) -> None:
        self._set(job_id, status="running")
        try:
            self._set(job_id, status="completed", result=self._work(**given))
        except Exception as error:  # the job's own, told by its state
            self._set(job_id, status="failed", error=str(error))

    def submit(self, **given: Any) -> str:
        """The new job's id; more than most waiting ones raise RuntimeError."""
        job_id, now = str(uuid.uuid4()), datetime.now(UTC).isoformat()
        with self._lock:
            if sum(j["status"] == "queued" for j in self._jobs.values()) >= self._most:
                raise RuntimeError("queue_full")
            self._jobs[job_id] = {"job_id": job_id, **given, "status": "queued", "created_at": now, "updated_at": now, "result": None, "error": None}
        self._pool.submit(self._run, job_id, given)
        return job_id

    def get(self, job_id: str) -> dict[str, Any] | None:
        with self._lock:
            return dict(self._jobs[job_id]) if job_id in self._jobs else None

    def close(self) -> None:
        self._pool.shutdown()


def drain(fetch: Callable[[int], tuple[list[Any], int | None, str | None]], keep: Callable[[Any], bool] = lambda row: True, offset: int = 0, size: int = 10, total: int | None = None, most: int = 200) -> Iterator[Any]:
    """The rows of a paged feed that keep wants, page after page.

    fetch(offset) gives rows, the feed's total if it tells it, and an error. The offset moves by what a page held, kept or not;
    rows beyond size belong to the next page. It ends on an error, an empty or short page, at the total, after two pages in a row
    whose rows were all blank (None), or after most pages.
    """
    blank = 0
    for _ in range(most):
        if total is not None and offset >= total:
            return
        rows, told, error = fetch(offset)
        if error or not rows:
            return
        total = total if told is None else told
        page = rows[:size]
        yield from (row for row in page if row is not None and keep(row))
        offset += len(page)
        blank = blank + 1 if all(row is None for row in page) else 0
        if blank >= 2 or len(rows) < size:
            return
