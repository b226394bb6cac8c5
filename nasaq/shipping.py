"""Makes this package importable on the executors, which share no folders with the driver."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch: with long texts, Spark's own 10,000 rows fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_ROWS, _BYTES, _SPARKS_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application, and bound Arrow batches unless they are set."""
    sc = spark.sparkContext
    if spark.conf.get(_ROWS, _SPARKS_ROWS) == _SPARKS_ROWS:
        spark.conf.set(_ROWS, BATCH_ROWS)
        spark.conf.set(_BYTES, BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = Path(__file__).resolve().parent
    if not top.is_dir():  # imported from an archive: shipped already
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    folder = tempfile.mkdtemp(prefix="nasaq-ship-")
    path = os.path.join(folder, "nasaq-package.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
