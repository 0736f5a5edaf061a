"""Retries of optimistic commits."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

from icekeel.functions.backoff import delay

T = TypeVar("T")


class Conflict(Exception):
    """Another writer has committed first."""


class OutOfMemory(Exception):
    """A job that ran out of memory and may pass in smaller parts."""


def recoverable(error: BaseException) -> bool:
    """Whether an error speaks of lost or starved executors rather than of the data."""
    text = str(error)
    return isinstance(error, (OutOfMemory, MemoryError)) or any(s in text for s in ("OutOfMemoryError", "ExecutorLostFailure", "exit code 137", "exit code 139", "SparkOutOfMemoryError"))


def retried(f: Callable[[int], T], attempts: int, base: float, cap: float, again: type[Exception] = Conflict, sleep: Callable[[float], None] = time.sleep, rand: Callable[[], float] = random.random) -> T:
    """f(attempt) until it returns; after an error of type again it is called anew, attempts times in all."""
    for k in range(attempts):
        try:
            return f(k)
        except again:
            if k + 1 >= attempts:
                raise
            sleep(delay(k, base, cap, rand))
    raise ValueError("attempts must be 1 at least")
