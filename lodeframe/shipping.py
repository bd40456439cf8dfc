"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; map functions are then found by name in every worker."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="lodeframe-"), "lodeframe-modules.zip")
    with zipfile.ZipFile(out, "w") as packed:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                packed.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(out)
    _SHIPPED.add(context.applicationId)
