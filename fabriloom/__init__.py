"""Process-control and yield analytics as Spark jobs."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark application, so that their Python can import it."""
    context = spark.sparkContext
    if getattr(context, "_fabriloom_shipped", None) != context.applicationId:
        here = Path(__file__).resolve().parent
        zipped = shutil.make_archive(f"{tempfile.mkdtemp()}/fabriloom", "zip", here.parent, here.name)
        context.addPyFile(zipped)
        context._fabriloom_shipped = context.applicationId
