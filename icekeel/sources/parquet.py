"""Parquet files: read together by name, and written as compaction writes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icekeel.functions.paths import default_fs, plain, plain_path

#: The column that numbers bins.
BIN = "_icekeel_bin"
#: Fixed values of the output: codec, level and rows of a row group.
CODEC, LEVEL, GROUP_ROWS = "zstd", 3, 122_880
FORMAT = {"compression": CODEC, "parquet.compression.codec.zstd.level": str(LEVEL), "parquet.block.row.count.limit": str(GROUP_ROWS)}


def _scans(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], DataFrame]]:
    """Scans that hold all files, as few as their types allow: a job over many footers merges schemas, and halves are tried where it can't."""
    try:
        return [(paths, spark.read.option("mergeSchema", True).parquet(*paths))]
    except Exception as e:
        if len(paths) == 1 or "merge" not in str(e).lower():
            raise
        mid = len(paths) // 2
        return _scans(spark, paths[:mid]) + _scans(spark, paths[mid:])


def read_by_name(spark: SparkSession, paths: list[str], path_column: str | None = None) -> DataFrame:
    """All rows of the files; columns are matched by name, missing ones are null, numbers widen.

    Files whose schemas can be merged are read in one scan, so the union has a branch for each set of types that
    clash. path_column, if given, holds the file that a row is from.
    """
    groups: dict[str, list[str]] = {}
    for own, df in _scans(spark, paths):
        groups.setdefault(df.schema.json(), []).extend(own)
    parts = [spark.read.option("mergeSchema", True).parquet(*own) for own in groups.values()]
    if path_column:
        parts = [p.select("*", F.url_decode("_metadata.file_path").alias(path_column)) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write(df: DataFrame, path: str) -> None:
    """df as Parquet: one file for each partition."""
    df.write.options(**FORMAT).parquet(path)


def write_bins(spark: SparkSession, bins: dict[str, int], path: str) -> None:
    """The rows of the files that bins numbers, with one file for each bin under path/<BIN>=<n>.

    One job writes all bins of a candidate; a bin is of the target file size, so a task holds one file's rows.
    """
    df = read_by_name(spark, list(bins), "_path")
    default = default_fs(spark)
    table = spark.createDataFrame([(plain_path(p, default), b) for p, b in bins.items()], f"_path string, {BIN} int")
    tagged = df.withColumn("_path", plain("_path", default)).join(F.broadcast(table), "_path").drop("_path")
    tagged.repartition(max(1, len(set(bins.values()))), BIN).sortWithinPartitions(BIN).write.options(**FORMAT).partitionBy(BIN).parquet(path)
