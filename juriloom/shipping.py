"""Makes this package importable in Python workers, wherever the driver was started."""
from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Spark's own number of rows in an Arrow batch, and ours: texts are long, and a worker holds whole batches.
DEFAULT_ROWS, ROWS = "10000", "2000"


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application, and keep Arrow batches small unless their size was set."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == DEFAULT_ROWS:
        spark.conf.set(rows, ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="juriloom-")) / "juriloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
