"""Running Spark actions side by side from the driver, with their outcomes as Results."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

_POOL = ThreadPoolExecutor(thread_name_prefix="tidepipe")


def spawn(f: Callable[[], Any]) -> Future:
    """Starts ``f``, whose actions Spark schedules beside others."""
    session = SparkSession.getActiveSession()
    return _POOL.submit(inheritable_thread_target(session)(f) if session else f)


def join(job: Future) -> dict:
    """Waits; a Result of the value or of the error's text."""
    try:
        return {"is_ok": True, "ok": job.result(), "err": None}
    except Exception as e:  # noqa: BLE001  the error is the result
        return {"is_ok": False, "ok": None, "err": str(e)}


def try_join(job: Future) -> dict | None:
    """The Result if there is one yet, else None."""
    return join(job) if job.done() else None
