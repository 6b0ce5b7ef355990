"""Sending this package to the Python workers of a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run: it is sent to them as a file, once an application."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{os.path.basename(root)}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as package:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    package.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)
