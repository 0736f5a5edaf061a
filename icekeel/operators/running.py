"""Running sums in which a large group is no single task's work."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icekeel.sources.scratch import materialize


def running(df: DataFrame, part: str, key: str, value: Column, name: str = "before") -> DataFrame:
    """df with the sum of value over the rows of the same part that come earlier by key (unique in its part).

    Rows are dealt by ranges of (part, key) and written, each range is summed by itself, and the sums of ranges
    (one row for each range of a part) are added up: a part with most of all rows is spread over many tasks.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn("_value", value).repartitionByRange(n, part, key).sortWithinPartitions(part, key)
    rows = materialize(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    sums = rows.groupBy(F.col(part).alias("_part"), F.col("_range").alias("_of")).agg(F.sum("_value").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("_part").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_part", "_of", F.coalesce(earlier, F.lit(0)).alias("_start"))
    inside = F.sum("_value").over(Window.partitionBy(part, "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_value")
    joined = rows.withColumn("_inside", inside).join(sums, reduce(and_, [F.col(part).eqNullSafe(F.col("_part")), F.col("_range") == F.col("_of")]))
    return joined.withColumn(name, F.col("_start") + F.col("_inside")).select(*df.columns, name)
