"""Makes the package importable for Python workers on other machines."""
from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    Functions given to Spark are pickled by the name of their module; a worker
    that was not started beside the package finds it in the archive sent here.
    """
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pairlens-")) / "pairlens.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SENT.add(context.applicationId)
