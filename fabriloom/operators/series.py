"""Order within series and over wafers: chart data, wafer sequence, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabriloom.functions.numeric import rounded
from fabriloom.operators.process import SERIES, limits
from fabriloom.operators.spc import ROWS, numbered
from fabriloom.sources.tables import Tables


def control_chart(t: Tables, flags: DataFrame, step_id: int, parameter: str, rows_per_bucket: int = ROWS) -> DataFrame:
    """One series with sample index, limits and flag mark; the filter comes before everything else."""
    one = (F.col("step_id") == F.lit(step_id)) & (F.col("parameter") == F.lit(parameter))
    own = t["measurements"].where(one).select("measurement_id", *SERIES, "value", "timestamp")
    hit = flags.where(one).select("measurement_id").distinct().withColumn("hit", F.lit(True))
    rows = numbered(own, rows_per_bucket).join(limits(own), SERIES).join(hit, "measurement_id", "left")
    return rows.select("measurement_id", "sample", "value", "timestamp", rounded(F.col("mean"), 6).alias("center"), rounded(F.col("mean") - 3 * F.col("sd"), 6).alias("lcl"), rounded(F.col("mean") + 3 * F.col("sd"), 6).alias("ucl"), F.coalesce("hit", F.lit(False)).alias("flagged")).orderBy("sample")


def wafer_sequence(t: Tables) -> DataFrame:
    """0-based place of each wafer by (start_date, lot_id, wafer_number). Wafers are numbered inside their lots. What
    comes before a lot is summed over days first (one row for each day), so no window spans all wafers or lots."""
    w = t["wafers"].join(t["lots"].select("lot_id", "start_date"), "lot_id")
    lots = w.groupBy("start_date", "lot_id").agg(F.count(F.lit(1)).alias("n"))
    days = lots.groupBy("start_date").agg(F.sum("n").alias("n"))
    before = days.withColumn("day_start", F.sum("n").over(Window.orderBy("start_date").rowsBetween(Window.unboundedPreceding, -1))).select("start_date", F.coalesce("day_start", F.lit(0)).alias("day_start"))
    lots = lots.join(before, "start_date").withColumn("lot_start", F.col("day_start") + F.coalesce(F.sum("n").over(Window.partitionBy("start_date").orderBy("lot_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("lot_id").orderBy("wafer_number", "wafer_id")) - 1
    return w.withColumn("place", place).join(lots.select("lot_id", "lot_start"), "lot_id").select("wafer_id", (F.col("lot_start") + F.col("place")).cast("long").alias("wafer_idx"))


def drift_early_late(t: Tables, k: int = 50) -> DataFrame:
    """Mean of the first and last k values of each series, and their difference. Ranks beyond k are cut before the shuffle."""
    rows, series = t["measurements"].select(*SERIES, "timestamp", "measurement_id", "value"), Window.partitionBy(*SERIES)
    first = rows.withColumn("place", F.row_number().over(series.orderBy("timestamp", "measurement_id"))).where(F.col("place") <= k)
    last = rows.withColumn("place", F.row_number().over(series.orderBy(F.desc("timestamp"), F.desc("measurement_id")))).where(F.col("place") <= k)
    both = first.select(*SERIES, F.col("value").alias("a"), F.lit(None).cast("double").alias("z")).union(last.select(*SERIES, F.lit(None).cast("double"), "value"))
    early, late = F.avg("a"), F.avg("z")
    return both.groupBy(*SERIES).agg(rounded(early, 6).alias("early_mean"), rounded(late, 6).alias("late_mean"), rounded(early - late, 6).alias("drift"))


def drift_slope(t: Tables) -> DataFrame:
    """Change of value for each wafer in sequence, by tool and parameter."""
    rows = t["measurements"].join(wafer_sequence(t), "wafer_id").join(t["process_steps"].select("step_id", "tool_id"), "step_id")
    return rows.groupBy("tool_id", "parameter").agg(F.count(F.lit(1)).alias("n"), rounded(F.regr_slope("value", "wafer_idx"), 8).alias("slope"))
