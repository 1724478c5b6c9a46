"""Giving the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once in a session, however the driver came by it."""
    sc = spark.sparkContext
    if getattr(sc, "_coweave_shipped", False):
        return
    top = Path(__file__).parent
    at = Path(tempfile.mkdtemp(prefix="coweave-")) / "coweave_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(at))
    sc._coweave_shipped = True
