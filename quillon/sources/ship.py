"""Make the package importable in the executors' Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once in a session, for clusters on which it isn't installed.

    The zip is served by the driver's file server; the folder it lies in on the driver is not read by executors.
    """
    if getattr(spark.sparkContext, "_quillon_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    at = Path(tempfile.mkdtemp(prefix="quillon-"), "quillon_package.zip")
    at.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(at))
    spark.sparkContext._quillon_shipped = True
