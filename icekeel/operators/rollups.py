"""Roll-ups of job results and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper ends of the duration buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300)


def by_table(results: DataFrame, table: Column) -> DataFrame:
    """Jobs, files, bytes and errors for each table; results: files, bytes_before, bytes_after, failed."""
    return results.groupBy(table.alias("table_name")).agg(
        F.count("*").alias("jobs"), F.sum("files").cast("long").alias("files_merged"), F.sum("bytes_before").cast("long").alias("bytes_before"),
        F.sum("bytes_after").cast("long").alias("bytes_after"), F.count_if("failed").alias("errors"),
    )


def merged(results: DataFrame, key: str) -> DataFrame:
    """Results of split jobs as one: sizes summed, inputs joined in order, the output path blank."""
    inputs = F.transform(F.array_sort(F.collect_list(F.struct("part", "input"))), lambda s: s["input"])
    return results.groupBy(key).agg(F.sum("size").cast("long").alias("size"), F.array_join(inputs, ",").alias("inputs"), F.lit("").alias("output_path"))


def histogram(values: DataFrame, value: str) -> DataFrame:
    """Cumulative counts at or below each of BUCKETS (le as text), and of all."""
    counts = values.agg(*(F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(BUCKETS)), F.count(value).alias("total"))
    pairs = F.array(*(F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(BUCKETS)), F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return counts.select(F.inline(pairs))
