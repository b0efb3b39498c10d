"""Lots with everything that hangs from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabriloom.sources.tables import Tables


def lot_genealogy_counts(t: Tables, flags: DataFrame) -> DataFrame:
    """Wafers, measurements, flags and yield records of each lot; each branch is counted before it is joined."""
    per_flag = flags.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("f"))
    m = t["measurements"].select("measurement_id", "wafer_id").join(per_flag, "measurement_id", "left").groupBy("wafer_id").agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum("f"), F.lit(0)).alias("f"))
    y = t["yield_records"].groupBy("wafer_id").agg(F.count(F.lit(1)).alias("y"))
    w = t["wafers"].select("wafer_id", "lot_id").join(m, "wafer_id", "left").join(y, "wafer_id", "left")
    per_lot = w.groupBy("lot_id").agg(F.count(F.lit(1)).alias("wafers"), *(F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("m", "measurements"), ("f", "flags"), ("y", "yields"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t["lots"].select("lot_id").join(per_lot, "lot_id", "left").select("lot_id", *map(zero, ("wafers", "measurements", "flags", "yields")))


#: Points of a page; points of a wafer that one task numbers.
PAGE, SALTED = 1_000, 100_000


def _spread(rows: DataFrame, measurements: DataFrame, salted: int) -> DataFrame:
    """rows (of measurements) with salt, which deals a wafer of many measurements over tasks: one salt for each `salted` of them.
    Counts by wafer are combined before the shuffle, and only wafers with more than that go on."""
    many = measurements.groupBy("wafer_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > salted).select("wafer_id", F.ceil(F.col("n") / salted).alias("salts"))
    return rows.join(many, "wafer_id", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("measurement_id"), "salts"), F.lit(0))).drop("salts")


def _points(t: Tables, flags: DataFrame) -> DataFrame:
    f = flags.groupBy("measurement_id").agg(F.array_join(F.array_sort(F.collect_set("rule_violated")), ",").alias("flags"))
    m = t["measurements"].join(f, "measurement_id", "left").join(t["process_steps"].select("step_id", "step_name"), "step_id", "left")
    return m.select("wafer_id", "measurement_id", "step_name", "parameter", "value", "timestamp", F.coalesce("flags", F.lit("")).alias("flags"))


def lot_genealogy_points(t: Tables, flags: DataFrame) -> DataFrame:
    """The measurements below each lot, a row for each: lot, wafer, step, value and the rules it violates, comma-joined."""
    w = t["wafers"].select("wafer_id", "wafer_number", "lot_id").join(t["lots"].select("lot_id"), "lot_id")
    return _points(t, flags).join(w, "wafer_id").select("lot_id", "wafer_id", "wafer_number", "measurement_id", "step_name", "parameter", "value", "flags")


def lot_genealogy(t: Tables, flags: DataFrame, page: int = PAGE, salted: int = SALTED) -> DataFrame:
    """Everything below each lot, in pages: (lot's columns, wafer_id, wafer_number, wafer_status, page, yields, measurements). A page has at
    most `page` measurements of a wafer, each with its step and flags, sorted by key; pages of a wafer are numbered from 0,
    and page 0 has its yield records. Lots without wafers and wafers without measurements have one page with empty arrays.
    A wafer with very many measurements is dealt over tasks by salts, each of which fills pages of its own."""
    one = F.struct("measurement_id", "step_name", "parameter", "value", "timestamp", F.filter(F.split("flags", ","), lambda r: r != "").alias("flags"))
    points = _spread(_points(t, flags), t["measurements"], salted)
    place = F.floor((F.row_number().over(Window.partitionBy("wafer_id", "salt").orderBy("measurement_id")) - 1) / page)
    pages = points.withColumn("part", place).groupBy("wafer_id", "salt", "part").agg(F.array_sort(F.collect_list(one)).alias("measurements"))
    sizes = _spread(t["measurements"].select("wafer_id", "measurement_id"), t["measurements"], salted).groupBy("wafer_id", "salt").agg(F.ceil(F.count(F.lit(1)) / page).alias("n"))
    before = sizes.select("wafer_id", "salt", (F.sum("n").over(Window.partitionBy("wafer_id").orderBy("salt")) - F.col("n")).alias("before"))
    pages = pages.join(before, ["wafer_id", "salt"]).select("wafer_id", (F.col("before") + F.col("part")).alias("page"), "measurements")
    y = t["yield_records"].groupBy("wafer_id").agg(F.array_sort(F.collect_list(F.struct("record_id", "die_count", "pass_count", "yield_pct", "defect_density"))).alias("yields"))
    w = t["wafers"].select("wafer_id", "lot_id", "wafer_number", F.col("status").alias("wafer_status")).join(y, "wafer_id", "left").join(pages, "wafer_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(w.schema[c].dataType)).alias(c)
    first = F.coalesce("page", F.lit(0))
    w = w.select("lot_id", "wafer_id", "wafer_number", "wafer_status", first.alias("page"), F.when(first == 0, F.col("yields")).alias("yields"), "measurements")
    return t["lots"].join(w, "lot_id", "left").select(*t["lots"].columns, "wafer_id", "wafer_number", "wafer_status", F.coalesce("page", F.lit(0)).alias("page"), empty("yields"), empty("measurements"))


def lot_genealogy_pages(t: Tables, flags: DataFrame, page: int = PAGE, salted: int = SALTED) -> DataFrame:
    """What each page of lot_genealogy() holds: numbers of yield records, points and flags, and the least and greatest
    measurement."""
    rows = lot_genealogy(t, flags, page, salted)
    sizes = F.aggregate("measurements", F.lit(0), lambda n, m: n + F.size(m["flags"]))
    return rows.select("lot_id", "wafer_id", "page", F.size("yields").alias("yields"), F.size("measurements").alias("points"), sizes.alias("flags"), F.get("measurements", F.lit(0))["measurement_id"].alias("first_point"), F.get("measurements", F.size("measurements") - 1)["measurement_id"].alias("last_point"))
