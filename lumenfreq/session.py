"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each session, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenfreq_shipped", False):
        return
    at = os.path.join(tempfile.mkdtemp(), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(at)
    sc._lumenfreq_shipped = True
