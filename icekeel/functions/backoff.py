"""Back-off of retries, as a column and as numbers."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_ms(attempt: Column, base_ms: int, cap_ms: int) -> Column:
    """The upper end of the full-jitter window: base * 2 ** attempt, capped and safe from overflow."""
    return F.least(F.lit(base_ms).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.least(attempt, F.lit(40)).cast("int")), F.lit(cap_ms).cast("long"))


def bound(attempt: int, base: float, cap: float) -> float:
    return 0.0 if base <= 0 else cap if attempt > 60 else min(base * 2**attempt, cap)


def delay(attempt: int, base: float, cap: float, rand=random.random) -> float:
    """Full jitter: anywhere from 0 to bound()."""
    return rand() * bound(attempt, base, cap)
