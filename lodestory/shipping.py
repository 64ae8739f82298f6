"""Make this package importable in executors, as ``--py-files`` does."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once per application.

    The archive is written on the driver and served by Spark, so executors need no
    access to the driver's folders.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        fd, path = tempfile.mkstemp(suffix=".zip", prefix="lodestory-")
        with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("lodestory", os.path.relpath(full, here)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
