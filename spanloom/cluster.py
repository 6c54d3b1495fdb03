"""Sending the library to executors that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Adds the library, as an archive, to the Python path of all workers; returns the archive."""
    here = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='spanloom-')}/spanloom.zip"  # read by the driver, which sends it
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(archive)
    return archive
