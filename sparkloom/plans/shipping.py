"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless their PYTHONPATH has it."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="sparkloom-")
    archive = shutil.make_archive(f"{folder}/sparkloom", "zip", root, "sparkloom")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
