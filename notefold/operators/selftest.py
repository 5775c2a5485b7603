"""Whether vector search works in this session: a round trip with known answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.operators.cosine import top_k
from notefold.storage import Scratch

SAMPLES, TOP, OFF = 20, 5, 1e-6


def round_trip(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64) -> DataFrame:
    """(name, ok): vectors are written, read back and searched; a plain scan of a bounded number of them must give the same."""
    with Scratch(spark) as scratch:
        rows = vectors.select(F.lit("").alias("path"), F.col(id_col).cast("long").alias("n"), F.col(vector_col).alias("vector"))
        stored = scratch.table(rows, "vectors")
        same = rows.exceptAll(stored).isEmpty() and stored.exceptAll(rows).isEmpty()
        some = stored.orderBy("n").limit(1_000).toArrow()  # the scan's side is held by the driver, so it is bounded
        x = np.array(some["vector"].to_pylist(), dtype=np.float64).reshape(-1, dims)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        n = some["n"].to_numpy()
        asked = np.linspace(0, len(n) - 1, min(SAMPLES, len(n))).astype(int) if len(n) else np.zeros(0, dtype=int)
        found: dict[int, list[float]] = {}
        first: dict[int, int] = {}
        held = stored.where(F.col("n").isin(n.tolist()))
        for r in top_k(held, [(int(n[i]), x[i].tolist()) for i in asked], TOP, dims).orderBy("wording", "rank").collect():
            found.setdefault(r["wording"], []).append(r["score"])
            first.setdefault(r["wording"], r["n"])
        scans = {int(n[i]): np.clip(np.sort(x @ x[i])[::-1][:TOP], 0, 1) for i in asked}
        exact = all(len(found.get(w, [])) == len(s) and np.allclose(found[w], s, atol=OFF) for w, s in scans.items())
        itself = all(scans[w][0] - 1 < OFF and found[w][0] > 1 - OFF for w in first)
        checks = [("top-k is an exact scan's", exact), ("vectors come back as written", same), ("each vector finds itself", itself and len(first) == len(scans))]
    return spark.createDataFrame(checks, "name STRING, ok BOOLEAN")
