"""Make the package importable in Python workers, however the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_pagesieve_shipped", False):
        return spark
    sc._pagesieve_shipped = True
    top = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="pagesieve-src-"), "pagesieve_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(out)
    return spark
