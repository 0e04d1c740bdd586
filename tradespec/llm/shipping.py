"""Makes the package importable in Python workers wherever the session runs."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def shipped(spark: SparkSession) -> SparkSession:
    """Hand the package's own modules to the executors, once per context."""
    context = spark.sparkContext
    if getattr(context, "_tradespec_shipped", False):
        return spark
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(_PACKAGE.parent))
    # The context copies the file to its executors; nobody reads this path again.
    path = Path(tempfile.mkdtemp(prefix="tradespec-code-")) / "tradespec_modules.zip"
    path.write_bytes(packed.getvalue())
    context.addPyFile(str(path))
    context._tradespec_shipped = True
    return spark
