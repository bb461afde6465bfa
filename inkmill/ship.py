"""Make the package importable in Python workers, as --py-files would."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_inkmill_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / "inkmill.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._inkmill_shipped = True
