"""What accompanies a comparison while it runs: a heartbeat of the run, and a time limit of one dataset."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# How often jobs of a comparison beyond its limit are cancelled: one may be between two jobs just then.
AGAIN_SECONDS = 0.5


class TimeLimitExceeded(RuntimeError):
    """A comparison did not finish within its time limit."""


@contextmanager
def beating(beat: Callable[[], None], every_seconds: float | None) -> Iterator[None]:
    """Call ``beat`` every so often, from a thread that ends with the block; None: never.

    A beat that fails is left out: whether the run can be recorded shows when its results are written.
    """
    if every_seconds is None:
        yield
        return
    over = threading.Event()

    def run() -> None:
        while not over.wait(every_seconds):
            try:
                beat()
            except Exception:  # noqa: BLE001, S110
                pass

    thread = threading.Thread(target=run, name="tablediff-heartbeat", daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancel the block's Spark jobs once it has taken ``seconds`` (None: no limit) and raise TimeLimitExceeded.

    The jobs carry a tag of their own, so other jobs of the session go on. What the block does without a job (planning,
    listing files) is not interrupted; its next job is. Tasks that run already are told to stop; one that doesn't listen
    ends with its own share of rows.
    """
    if seconds is None:
        yield
        return
    context, tag = spark.sparkContext, f"tablediff-{uuid.uuid4().hex}"
    over, late = threading.Event(), threading.Event()

    def watch() -> None:
        if over.wait(seconds):
            return
        late.set()
        while True:
            context.cancelJobsWithTag(tag)
            if over.wait(AGAIN_SECONDS):
                return

    interrupts = "spark.job.interruptOnCancel"
    before = context.getLocalProperty(interrupts)
    context.addJobTag(tag)
    context.setLocalProperty(interrupts, "true")
    thread = threading.Thread(target=watch, name="tablediff-time-limit", daemon=True)
    thread.start()
    message = f"not finished within {seconds:g} seconds"
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeLimitExceeded(message) from e
        raise
    finally:
        over.set()
        thread.join()
        context.removeJobTag(tag)
        context.setLocalProperty(interrupts, before)
    if late.is_set():
        raise TimeLimitExceeded(message)
