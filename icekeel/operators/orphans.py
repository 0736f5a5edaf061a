"""What a listing holds that no snapshot needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dispositions(listing: DataFrame, live: DataFrame, cutoff: Column) -> DataFrame:
    """listing (p, mtime) with disposition: live, protected (metadata JSON), skipped (unknown age, or changed after
    cutoff), else deleted. A file changed at cutoff may be deleted. live: p."""
    marked = listing.join(live.select("p").distinct().withColumn("is_live", F.lit(True)), "p", "left")
    kind = F.when(F.col("is_live"), "live").when(F.col("p").endswith(".json"), "protected").when(F.col("mtime").isNull() | (F.col("mtime") > cutoff), "skipped").otherwise("deleted")
    return marked.withColumn("disposition", kind).drop("is_live")


def disposition_counts(listing: DataFrame, live: DataFrame, cutoff: Column) -> DataFrame:
    return dispositions(listing, live, cutoff).groupBy("disposition").agg(F.count("*").alias("n"))


def delete_list(listing: DataFrame, live: DataFrame, cutoff: Column) -> DataFrame:
    return dispositions(listing, live, cutoff).filter(F.col("disposition") == "deleted").select("p")
