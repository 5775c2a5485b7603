"""The passages that are in force among all rows ever stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_passages(stored: DataFrame, *columns: Column | str, by: list[str] | None = None) -> DataFrame:
    """The row with the greatest ``vec`` of each (path, n), with the columns asked for.

    Rows without path, n or vec are not passages; of rows that share the greatest ``vec`` (repeats)
    one is kept. The rank limit is applied before the shuffle as well as after it, so a key with
    many versions sends few of them. ``by`` are further columns to partition by, where the input
    is laid out by them already.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    rows = stored.where(F.col("path").isNotNull() & F.col("n").isNotNull() & F.col("vec").isNotNull()).select("path", "n", "vec", *(by or []), *cols)
    w = Window.partitionBy(*(by or []), "path", "n").orderBy(F.desc("vec"))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
