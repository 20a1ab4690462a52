"""Makes the package known to executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a context."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _done.add(sc.applicationId)
