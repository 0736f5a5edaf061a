"""Space-filling order: bits of bucket numbers, interleaved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interleave(columns: list[Column], bits: int = 8) -> Column:
    """The Morton code of bucket numbers below 2 ** bits: bit i of column k goes to place i * len(columns) + k."""
    n = len(columns)
    if n * bits > 63:
        raise ValueError("the code would not fit a long")
    parts = [F.shiftleft(c.cast("long").bitwiseAND(F.lit(1 << i).cast("long")), i * (n - 1) + k) for i in range(bits) for k, c in enumerate(columns)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def bucketed(df: DataFrame, names: list[str], bits: int = 8) -> list[Column]:
    """Bucket numbers of columns by rough quantiles (numbers, dates) or by the first bytes' order (others); null is 0.

    One pass over df gives the quantiles of all columns; a bucket is found by halving among their edges.
    """
    kinds, values = dict(df.dtypes), []
    for name in names:
        c = F.col(f"`{name}`")
        if kinds[name] in ("string", "binary"):
            values.append(F.conv(F.rpad(F.hex(F.substring(c, 1, 6)), 12, "0"), 16, 10).cast("double"))
        else:
            values.append(c.cast("timestamp").cast("double") if kinds[name].startswith(("date", "timestamp")) else c.cast("double"))
    plain = df.select(*(v.alias(f"v{k}") for k, v in enumerate(values)))
    found = plain.approxQuantile(plain.columns, [k / (1 << bits) for k in range(1, 1 << bits)], 0.002)
    steps, out = F.array(*(F.lit(1 << k) for k in reversed(range(bits)))), []
    for value, cuts in zip(values, found, strict=True):
        edges = F.array(*(F.lit(float(x)) for x in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
        out.append(F.when(value.isNull(), 0).otherwise(_below(edges, value, steps)).cast("long"))
    return out


def _below(edges: Column, value: Column, steps: Column) -> Column:
    """How many of the sorted edges are below value."""
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(edges, n + step - 1) < value, step).otherwise(0))


def zorder(df: DataFrame, names: list[str], bits: int = 8) -> Column:
    """The Morton code of a row over names, from distributed quantiles; no window over all rows."""
    return interleave(bucketed(df, names, bits), bits)
