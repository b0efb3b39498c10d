"""Measurements as they arrive: rule 1 needs only the limits of the stored series, so a stream can be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.operators.process import SERIES, limits
from fabriloom.sources.schemas import DDL


def read_arrivals(spark: SparkSession, directory: str) -> DataFrame:
    return spark.readStream.schema(DDL["measurements"]).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(directory)


def flag_arrivals(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """New points beyond 3 sigma of their stored series (one row of limits for each series; Spark decides by its size how they
    meet)."""
    known = limits(stored).where("sd > 0")
    return arrivals.join(known, SERIES).where(F.abs(F.col("value") - F.col("mean")) > 3 * F.col("sd")).select("measurement_id", *SERIES, F.lit("rule1_3sigma").alias("rule_violated"))
