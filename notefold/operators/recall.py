"""Retrieval quality: how often the expected answer is among the first k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall) of (wording, rank, expected, found): the share of wordings with a right answer by rank k."""
    best = found.groupBy("wording").agg(F.min(F.when(F.col("expected") == F.col("found"), F.col("rank"))).alias("first"))
    per = best.select("wording", F.explode(F.array(*map(F.lit, ks))).alias("k"), "first")
    return per.groupBy("k").agg(F.round(F.avg(F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("int")), 6).alias("recall"))
