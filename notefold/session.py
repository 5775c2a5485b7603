"""What a session needs before Python operators can run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once in an application; they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    name = os.path.join(tempfile.mkdtemp(prefix="notefold-"), "notefold.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"notefold/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that ships the package before it runs."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return query(spark, d)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run
