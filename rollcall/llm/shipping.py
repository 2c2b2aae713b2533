"""Give executors this package, so that their Python workers can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors of this application, once."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    handle, name = tempfile.mkstemp(prefix="rollcall-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent).as_posix())
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)
