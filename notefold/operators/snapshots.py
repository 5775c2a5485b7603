"""What changed between consecutive full snapshots of a table, for any number of snapshots at once.

Each key's appearances are windowed in the order of the snapshot's index (its place among the
snapshots that were delivered). A lagged hash that differs is a change; a gap in the index is a
removal and, where the key comes back, a later addition; the edges of the sequence are an addition
and a removal. No snapshot is joined with another, so the cost doesn't grow with their number.

Defined results: of a snapshot's deliveries only the greatest counts, null deliveries being the
least; rows without a key or a snapshot number don't count (a delivery of such rows only still
counts as a delivery); keys are compared after normalising; a null hash is a value of its own; of
several hashes of one key in one snapshot the greatest counts, null last; the first snapshot yields
nothing; extra columns are ignored; an empty table yields no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notefold.functions.keys import hex_number, note_key


def snapshot_index(snapshots: DataFrame) -> DataFrame:
    """(snapshot_no, delivery_no, idx, next_no, last_idx): a row for each snapshot, its last delivery."""
    w = Window.orderBy("snapshot_no")
    return (
        snapshots.where(F.col("snapshot_no").isNotNull())
        .groupBy("snapshot_no")
        .agg(F.max(F.coalesce("delivery_no", F.lit(-1))).alias("delivery_no"))
        .select(
            "snapshot_no",
            "delivery_no",
            F.row_number().over(w).alias("idx"),
            F.lead("snapshot_no").over(w).alias("next_no"),
            F.count(F.lit(1)).over(Window.partitionBy()).alias("last_idx"),
        )
    )


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_no, path, change): ``added``, ``removed`` and ``changed`` against the snapshot before."""
    index = snapshot_index(snapshots)
    rows = (
        snapshots.where(F.col("path").isNotNull())
        .select("snapshot_no", F.coalesce("delivery_no", F.lit(-1)).alias("delivery_no"), note_key("path").alias("path"), hex_number("sha256").alias("sha256"))
        .join(index, ["snapshot_no", "delivery_no"])  # a row for each snapshot: AQE broadcasts it by its measured size
        .groupBy("path", "idx", "snapshot_no", "next_no", "last_idx")
        .agg(F.max("sha256").alias("sha256"))
    )
    w = Window.partitionBy("path").orderBy("idx")
    seen = rows.select(
        "*",
        F.lag("idx").over(w).alias("before"),
        F.lag("sha256").over(w).alias("sha_before"),
        F.lead("idx").over(w).alias("after"),
    )
    came = F.when(F.col("before").isNull() | (F.col("before") < F.col("idx") - 1), F.lit("added")).when(~F.col("sha256").eqNullSafe(F.col("sha_before")), F.lit("changed"))
    went = F.when(F.col("after").isNull() | (F.col("after") > F.col("idx") + 1), F.lit("removed"))
    return (
        seen.select(
            "path",
            F.explode(
                F.array(
                    F.struct(F.when(F.col("idx") > 1, F.col("snapshot_no")).alias("snapshot_no"), came.alias("change")),
                    F.struct(F.when(F.col("idx") < F.col("last_idx"), F.col("next_no")).alias("snapshot_no"), went.alias("change")),
                )
            ).alias("c"),
        )
        .where(F.col("c.snapshot_no").isNotNull() & F.col("c.change").isNotNull())
        .select("c.snapshot_no", "path", "c.change")
    )
