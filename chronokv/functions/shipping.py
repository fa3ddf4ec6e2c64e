"""The package for Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped or not _PACKAGE.is_dir():
        return
    to = os.path.join(tempfile.mkdtemp(prefix="chronokv-"), "chronokv_package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)
