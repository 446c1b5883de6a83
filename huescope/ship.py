"""Hand the package to Python workers that would not find it themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application, once, unless the workers' search
    path (PYTHONPATH, or the folder that the driver runs in) has it."""
    package = Path(__file__).resolve().parent
    root, app = str(package.parent), spark.sparkContext.applicationId
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="huescope-"), "huescope.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, os.path.join(package.name, p.relative_to(package)))
    spark.sparkContext.addPyFile(target)  # Spark's own file server hands it to every executor
    _SHIPPED.add(app)
