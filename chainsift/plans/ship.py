"""Sends this package to the executors, for functions that run in Python workers there."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parents[2]
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-package-')}/chainsift", "zip", root, "chainsift")
    sc.addPyFile(made)
    _SENT.add(sc.applicationId)
