"""The tables that meet on wafer_id, stored in buckets by it, so that their joins, sums and reference checks need no exchange."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fabriloom.sources.schemas import COLUMNS, DDL
from fabriloom.sources.tables import Tables

BY_WAFER = ("wafers", "measurements", "yield_records")
#: A bucket is one task's, so no wafer may hold more rows of a table than so many buckets have on average.
UNEVEN = 4


class TooUneven(ValueError):
    """A wafer has so many rows that its bucket would be one slow task; the plain layout, whose joins can split it, serves better."""


def write_bucketed(tables: Tables, database: str, buckets: int) -> None:
    """Stores the five tables in a database of the warehouse, replacing what it had: those that have a wafer_id in buckets,
    sorted by it, one file a bucket; the others plain. Sizes are checked before anything is written."""
    spark = next(iter(tables.values())).sparkSession
    for table in BY_WAFER:
        sizes = tables[table].groupBy("wafer_id").agg(F.count(F.lit(1)).alias("n"))
        r = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
        if r["rows"] and r["most"] > max(1000, UNEVEN * r["rows"] / buckets):
            raise TooUneven(f"a wafer has {r['most']} of the {r['rows']} {table}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for table in DDL:
        rows = tables[table].select(*COLUMNS[table])
        if table in BY_WAFER:
            rows.repartition(buckets, "wafer_id").sortWithinPartitions("wafer_id").write.mode("overwrite").format("parquet").bucketBy(buckets, "wafer_id").sortBy("wafer_id").saveAsTable(f"{database}.{table}")
        else:
            rows.write.mode("overwrite").format("parquet").saveAsTable(f"{database}.{table}")


def read_bucketed(spark: SparkSession, database: str) -> Tables:
    return {table: spark.table(f"{database}.{table}") for table in DDL}
