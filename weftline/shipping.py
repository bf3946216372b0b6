"""The package on the executors, where it isn't installed there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

__all__ = ["ship"]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Have Spark bring this package to all Python workers, once for each application.

    The archive is made on the driver and served by it from there.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="weftline-package-"), "weftline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    sc.addPyFile(archive)
