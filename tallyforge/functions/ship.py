"""Give Python workers this package, which need not be installed or on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Add the package to the session's Python files, once for each context."""
    spark = spark or SparkSession.getActiveSession()
    context = spark.sparkContext
    if getattr(context, "tallyforge_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="tallyforge-"), "tallyforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(path)
    context.tallyforge_shipped = True
