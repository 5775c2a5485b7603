"""All queries of the core, by name, with the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notefold.plans import folder, notes, searching, syncing, upkeep

QUERIES = {**notes.QUERIES, **folder.QUERIES, **searching.QUERIES, **syncing.QUERIES, **upkeep.QUERIES}
ORACLES = {**notes.ORACLES, **folder.ORACLES, **searching.ORACLES, **syncing.ORACLES, **upkeep.ORACLES}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["exact_words_interleaved"](spark, d)
