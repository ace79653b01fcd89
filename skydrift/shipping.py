"""Sends the package to the executors, so that a session needs nothing installed there."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to a session's files, once per context."""
    sc = spark.sparkContext
    if not getattr(sc, "_skydrift_shipped", False):
        here = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='skydrift-')}/skydrift", "zip", here.parent, here.name)
        sc.addPyFile(archive)
        sc._skydrift_shipped = True


def shipped(query: Callable) -> Callable:
    """A query that sends the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run
