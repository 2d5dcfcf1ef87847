"""Making this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


#: Bytes of an Arrow batch between Spark and Python, where the session has the default.
BATCH_SETTING, DEFAULT_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4m"


def _bound_batches(spark: SparkSession) -> None:
    """Texts of some kilobytes make the usual batches large in both processes."""
    now = spark.conf.get(BATCH_SETTING, None)
    if now in (None, f"{DEFAULT_BYTES}b", str(DEFAULT_BYTES), "64m", "64MB"):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def ship(spark: SparkSession | None) -> None:
    """Send the package to every executor, once per Spark context."""
    if spark is None:
        return
    _bound_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_foliant_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="foliant-"), f"foliant-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(Path(PACKAGE.name) / p.relative_to(PACKAGE)))
    sc.addPyFile(target)
    sc._foliant_shipped = True
