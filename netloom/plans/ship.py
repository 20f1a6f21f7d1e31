"""Sending this package to the workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let the workers of this session import the package: once, as a zip file that Spark hands out to every executor, also to later ones."""
    context = spark.sparkContext
    if getattr(context, "_netloom_shipped", False):
        return
    import netloom

    root = os.path.dirname(os.path.abspath(netloom.__file__))
    if os.path.isdir(root):  # not if it comes from a zip file already
        path = os.path.join(tempfile.mkdtemp(prefix="netloom-"), "netloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("netloom", os.path.relpath(full, root)))
        context.addPyFile(path)
    context._netloom_shipped = True
