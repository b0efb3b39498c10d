"""The process-control tables as views over the driver's tables. The expressions are plain SQL that reads alike in other
engines, so the oracle uses the same text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fabriloom.sources.tables import Tables

#: view -> (table, SELECT list, WHERE)
VIEWS = {
    "lots": ("customer", "c_custkey AS lot_id, c_mktsegment AS product, CASE c_nationkey % 4 WHEN 0 THEN '28nm' WHEN 1 THEN '65nm' WHEN 2 THEN '130nm' ELSE '180nm' END AS technology_node, DATE '2025-10-01' + CAST(c_custkey % 180 AS INT) AS start_date, CASE WHEN c_custkey % 20 = 0 THEN 'hold' WHEN c_custkey % 4 = 0 THEN 'active' ELSE 'complete' END AS status", "TRUE"),
    "wafers": ("orders", "o_orderkey AS wafer_id, o_custkey AS lot_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS wafer_number, CASE WHEN o_orderkey % 50 = 0 THEN 'scrap' WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'active' END AS status", "TRUE"),
    "process_steps": ("nation", "CAST(n_nationkey AS INT) AS step_id, n_name AS step_name, concat('TOOL-', CAST(n_nationkey AS VARCHAR(10))) AS tool_id, concat('M', CAST(n_regionkey % 2 + 1 AS VARCHAR(10))) AS layer, CAST(10 - n_nationkey AS INT) AS sequence_order", "n_nationkey < 10"),
    "measurements": ("events", "event_id AS measurement_id, user_id AS wafer_id, CAST(user_id % 10 AS INT) AS step_id, event_type AS parameter, value, 'u' AS unit, ts AS timestamp", "TRUE"),
    "yield_records": ("lineitem", "l_orderkey * 10 + l_linenumber AS record_id, l_orderkey AS wafer_id, 250 AS die_count, CAST(l_quantity * 5 AS INT) AS pass_count, 100 - l_quantity AS yield_pct, l_discount AS defect_density", "TRUE"),
}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    out = {}
    for view, (table, columns, where) in VIEWS.items():
        source = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where)
        out[view] = spark.sql(f"SELECT {columns} FROM {{source}}", source=source)
    return out


def oracle_views() -> str:
    return "WITH " + ", ".join(f"{view} AS (SELECT {columns} FROM {table} WHERE {where})" for view, (table, columns, where) in VIEWS.items())
