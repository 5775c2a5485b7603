"""Places in a global order, and samples spread evenly over it, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Rows with their place from 0 in an order that tells all of them apart.

    Rows are put into ranges of that order and numbered within them; what comes before each range is
    a sum over one row a range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    return ranged.join(F.broadcast(starts), "_p").withColumn(name, F.coalesce("_start", F.lit(0)) + F.col("_k")).drop("_p", "_k", "_n", "_start")


def stratified(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """``n`` rows spread evenly over an order, with ``sample`` and ``ordinal``; a row may stand for several samples if there are fewer."""
    total = rows.count()
    wanted = rows.sparkSession.createDataFrame([(s, s * total // n) for s in range(n if total else 0)], "sample INT, ordinal LONG")
    return numbered(rows, *order).join(F.broadcast(wanted), "ordinal")
