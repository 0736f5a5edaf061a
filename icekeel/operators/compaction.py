"""Choosing small files, packing them into bins, and laying their rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icekeel.functions.morton import zorder
from icekeel.functions.paths import checked_identifier, dirname
from icekeel.operators.running import running

#: Names of code columns.
CODE = "_icekeel_code_"
STRATEGIES = ("binpack", "", "sort", "z-order")


def checked_strategy(strategy: str, sort_keys: list[str], zorder_columns: list[str]) -> None:
    """Raises before any I/O if the strategy is unknown or lacks its columns."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown compaction strategy {strategy!r}")
    if strategy == "sort" and not sort_keys:
        raise ValueError("sort needs sort_keys")
    if strategy == "z-order" and not zorder_columns:
        raise ValueError("z-order needs z_order_columns")
    for name in [*sort_keys, *zorder_columns]:
        checked_identifier(name)


def candidates(files: DataFrame, cutoff: Column, min_file_count: int, target_bytes: int | None = None) -> DataFrame:
    """partition_dir, n_files, bytes_before of directories with enough files added before cutoff.

    files: file_path, size_bytes, added_at. A file as old as cutoff is kept out. With target_bytes,
    files that have reached it are left alone. One aggregation with partial sums; nothing is collected.
    """
    old = files.filter(F.col("added_at") < cutoff)
    if target_bytes is not None:
        old = old.filter(F.col("size_bytes") < target_bytes)
    grouped = old.groupBy(dirname("file_path").alias("partition_dir")).agg(F.count("*").alias("n_files"), F.sum("size_bytes").cast("long").alias("bytes_before"))
    return grouped.filter(F.col("n_files") >= min_file_count)


def candidate_files(files: DataFrame, cutoff: Column, min_file_count: int, target_bytes: int | None = None) -> DataFrame:
    """The files of candidates(), with their partition_dir."""
    old = files.filter(F.col("added_at") < cutoff)
    if target_bytes is not None:
        old = old.filter(F.col("size_bytes") < target_bytes)
    old = old.withColumn("partition_dir", dirname("file_path"))
    return old.join(candidates(files, cutoff, min_file_count, target_bytes).select("partition_dir"), "partition_dir", "left_semi")


def bins(files: DataFrame, target_bytes: float, part: str = "part", key: str = "k", size: str = "sz") -> DataFrame:
    """files with the bin of each: its running start in its directory over the target."""
    started = running(files, part, key, F.col(size), "_start_off")
    return started.withColumn("bin", F.floor(F.col("_start_off") / F.lit(float(target_bytes))).cast("long")).drop("_start_off")


def bin_totals(binned: DataFrame, part: str = "part", size: str = "sz") -> DataFrame:
    return binned.groupBy(part, "bin").agg(F.count("*").alias("n_files"), F.sum(size).cast("long").alias("bytes"))


def halves(files: DataFrame, part: str, key: str) -> DataFrame:
    """files with half 0 for the first n // 2 of their group by key, 1 for the others."""
    counts = files.groupBy(F.col(part).alias("_of")).agg(F.count("*").alias("_n"))
    numbered = running(files, part, key, F.lit(1), "_nth").join(counts, F.col(part).eqNullSafe(F.col("_of")))
    return numbered.withColumn("half", F.when(F.col("_nth") < F.floor(F.col("_n") / 2), 0).otherwise(1)).select(*files.columns, "half")


def laid_out(df: DataFrame, strategy: str = "binpack", sort_keys: list[str] = (), zorder_columns: list[str] = (), files: int = 1, zorder_by: str = "morton", keep_codes: bool = False) -> DataFrame:
    """Rows of df in files partitions, ordered as the strategy asks.

    sort: by the keys ascending, nulls last; range partitions sorted inside, so that files don't overlap.
    z-order: by Morton code, or by the columns' hashes (zorder_by="hash"); keep_codes leaves them as columns. binpack: as they come.
    Names with dots are one column each.
    """
    checked_strategy(strategy, list(sort_keys), list(zorder_columns))
    if strategy == "sort":
        order = [F.col(f"`{k}`").asc_nulls_last() for k in sort_keys]
    elif strategy == "z-order":
        # The codes are columns, so that dealing and sorting compute them once each.
        codes = [F.xxhash64(F.col(f"`{c}`")) for c in zorder_columns] if zorder_by == "hash" else [zorder(df, list(zorder_columns))]
        names = [f"{CODE}{k}" for k in range(len(codes))]
        coded = df.select("*", *(c.alias(n) for c, n in zip(codes, names, strict=True)))
        dealt = coded.coalesce(1) if files == 1 else coded.repartitionByRange(files, *names)
        dealt = dealt.sortWithinPartitions(*names)
        return dealt if keep_codes else dealt.drop(*names)
    else:
        return df.coalesce(files)
    if files == 1:
        return df.coalesce(1).sortWithinPartitions(*order)
    return df.repartitionByRange(files, *order).sortWithinPartitions(*order)


def layout(written: DataFrame, keys: list[str]) -> DataFrame:
    """One row for files that were written in the order of keys: n_rows, n_files, inversions (neighbours in a file out of order) and
    overlaps (neighbouring files whose ranges of the first key cross)."""
    key = F.struct(*(F.struct(F.col(k).isNull().alias("last"), F.col(k).alias("value")) for k in keys))
    rows = written.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"), key.alias("key"), F.col(keys[0]).alias("first"))
    before = F.lag("key").over(Window.partitionBy("file").orderBy("nth"))
    files = rows.withColumn("inverted", before > F.col("key")).groupBy("file").agg(F.count("*").alias("n"), F.count_if("inverted").alias("inversions"), F.min("first").alias("lo"), F.max("first").alias("hi"))
    # Files are few: their ranges are compared in one array.
    ranges = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    crossing = F.size(F.filter(F.transform(ranges, lambda r, i: F.when(i > 0, F.element_at(ranges, i)["hi"] > r["lo"])), lambda x: x))
    return files.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_files"), F.sum("inversions").alias("inversions"), crossing.cast("long").alias("overlaps"))
