"""Sends this package to the Python workers of a session, so that they need no shared path to it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as a zip file, served by the driver like any --py-files."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # workers that start late still fetch it
    stage = os.path.join(folder, "stage")
    shutil.copytree(here, os.path.join(stage, "tessera"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "tessera"), "zip", stage))
    _sent.add(sc.applicationId)
