"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each SparkContext.

    Functions that run in Python workers are pickled by reference, so the workers need the package itself.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tickloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from a shipped archive
        return
    archive = Path(tempfile.mkdtemp(prefix="tickloom-")) / "tickloom_sources.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._tickloom_shipped = True
