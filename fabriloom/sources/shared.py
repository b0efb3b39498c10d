"""What is worked out once and read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, from where lost executors' parts are read again. If none is named
    and Spark runs in this process alone (tests), to a folder of our own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="fabriloom-"))
    return df.checkpoint()
