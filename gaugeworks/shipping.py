"""The package's code for executors that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_gaugeworks_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="gaugeworks-"), "gaugeworks.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(path)
    context._gaugeworks_shipped = True
