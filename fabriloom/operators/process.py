"""Measurements and process steps: selections, statistics, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabriloom.functions.numeric import rounded
from fabriloom.sources.tables import Tables

SERIES = ["step_id", "parameter"]


def measurements_for_step(t: Tables, step_id: int, parameter: str) -> DataFrame:
    rows = t["measurements"].where((F.col("step_id") == F.lit(step_id)) & (F.col("parameter") == F.lit(parameter)))
    return rows.select("measurement_id", "wafer_id", "value", "timestamp").orderBy("timestamp", "measurement_id")


def measurements_of_step(t: Tables, step_id: int) -> DataFrame:
    return t["measurements"].where(F.col("step_id") == F.lit(step_id)).select("measurement_id", "parameter", "value", "unit").orderBy("parameter", "measurement_id")


def step_lookup(t: Tables, step_name: str) -> DataFrame:
    return t["process_steps"].where(F.col("step_name") == F.lit(step_name)).agg(F.min("step_id").alias("step_id")).where("step_id is not null")


def lot_lookup(t: Tables, lot_id: int) -> DataFrame:
    return t["lots"].where(F.col("lot_id") == F.lit(lot_id))


def measured_steps(t: Tables) -> DataFrame:
    seen = t["measurements"].select("step_id", "parameter").distinct()
    return seen.join(t["process_steps"], "step_id").select("step_id", F.format_string("%s (%s)", "step_name", "tool_id").alias("label"), "parameter").orderBy("step_id", "parameter")


def process_step_stats(t: Tables, step_id: int | None = None) -> DataFrame:
    """Count, mean and population variance of each series, and the standard deviation of the rounded variance."""
    rows = t["measurements"] if step_id is None else t["measurements"].where(F.col("step_id") == F.lit(step_id))
    stats = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value"), 4).alias("mean_value"), rounded(F.var_pop("value"), 6).alias("variance"))
    named = stats.join(t["process_steps"], "step_id")
    return named.select("step_id", "step_name", "tool_id", "sequence_order", "parameter", "n", "mean_value", "variance", rounded(F.sqrt(F.greatest("variance", F.lit(0.0))), 6).alias("std_dev")).orderBy("sequence_order", "parameter", "step_id")


def limits(measurements: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each series; one row for each series, combined before the shuffle."""
    return measurements.where(~F.isnan("value")).groupBy(*SERIES).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def series_stats(t: Tables) -> DataFrame:
    return limits(t["measurements"]).select(*SERIES, rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("sd"), 6).alias("sd"))


def control_limits(t: Tables, k: float = 3.0) -> DataFrame:
    own = limits(t["measurements"])
    return own.select(*SERIES, rounded(F.col("mean"), 6).alias("center"), rounded(F.col("mean") - k * F.col("sd"), 6).alias("lcl"), rounded(F.col("mean") + k * F.col("sd"), 6).alias("ucl"))


def wafer_outlier_counts(t: Tables, key: tuple[str, ...] = ("parameter",), z: float = 3.0) -> DataFrame:
    """Measurements of a wafer beyond z standard deviations of their key (the parameter's name, over all steps)."""
    stats = t["measurements"].groupBy(*key).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    scored = t["measurements"].join(stats, list(key))
    sd = F.when(F.coalesce("sd", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("sd"))
    return scored.where(F.abs((F.col("value") - F.col("mean")) / sd) > z).groupBy("wafer_id").agg(F.count(F.lit(1)).alias("outliers"))


def parameter_histogram(t: Tables, step_id: int, bins: int = 30) -> DataFrame:
    """Counts in so many bins of equal width between least and greatest value of each parameter of a step."""
    rows = t["measurements"].where(F.col("step_id") == F.lit(step_id)).select("parameter", "value")
    bounds = rows.groupBy("parameter").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / F.when(width > 0, width) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.join(bounds, "parameter").groupBy("parameter", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("parameter", "bin")
