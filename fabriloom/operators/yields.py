"""Yield and defect-density reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.functions.numeric import rounded
from fabriloom.functions.quantiles import exact_quantiles
from fabriloom.sources.shared import kept
from fabriloom.sources.tables import Tables

#: Technology node -> (dies on a wafer, die area in cm2, base defect density).
NODES = {"28nm": (1000, 0.25, 0.60), "65nm": (500, 0.50, 0.40), "130nm": (250, 1.00, 0.25), "180nm": (150, 1.50, 0.18)}


def star(t: Tables) -> DataFrame:
    """Yield records with wafer and lot; lots without records drop out."""
    wafers = t["wafers"].select("wafer_id", "lot_id", "wafer_number", F.col("status").alias("wafer_status"))
    return t["yield_records"].join(wafers, "wafer_id").join(t["lots"], "lot_id")


LOT = ["lot_id", "product", "technology_node", "start_date", "status"]
_SUMS = ["records", "yields", "yield_sum", "densities", "density_sum"]


def lot_state(t: Tables) -> DataFrame:
    """One row for each lot that has yield records: counts and sums, from which all averages follow. Records are summed up by
    wafer before they meet wafers, and by lot before they meet lots."""
    own = [F.count("record_id").alias("records"), F.count("yield_pct").alias("yields"), F.sum("yield_pct").alias("yield_sum"), F.count("defect_density").alias("densities"), F.sum("defect_density").alias("density_sum")]
    by_wafer = t["yield_records"].groupBy("wafer_id").agg(*own)
    by_lot = by_wafer.join(t["wafers"].select("wafer_id", "lot_id"), "wafer_id").groupBy("lot_id").agg(*(F.sum(c).alias(c) for c in _SUMS))
    return by_lot.join(t["lots"], "lot_id").select(*LOT, *_SUMS)


def _measures() -> list[Column]:
    """Measures over rows of lot_state()."""
    return [F.sum("records").alias("wafer_count"), rounded(F.sum("yield_sum") / F.sum("yields"), 2).alias("avg_yield_pct"), rounded(F.sum("density_sum") / F.sum("densities"), 4).alias("avg_defect_density")]


def yield_by_lot(t: Tables, state: DataFrame | None = None) -> DataFrame:
    return (lot_state(t) if state is None else state).groupBy(*LOT).agg(*_measures()).orderBy("lot_id")


def yield_by_product(t: Tables, state: DataFrame | None = None) -> DataFrame:
    return (lot_state(t) if state is None else state).groupBy("product").agg(*_measures()).orderBy(F.desc("avg_yield_pct"), "product")


def yield_by_node(t: Tables, state: DataFrame | None = None) -> DataFrame:
    return (lot_state(t) if state is None else state).groupBy("technology_node").agg(*_measures()).orderBy(F.desc("avg_yield_pct"), "technology_node")


def yield_rollup(t: Tables) -> DataFrame:
    """(level, lot_id, product, technology_node, measures): all lots, products and nodes, by grouping sets over one join."""
    level = F.when(F.grouping("lot_id") == 0, "lot").when(F.grouping("product") == 0, "product").otherwise("node")
    sets = [[F.col("lot_id")], [F.col("product")], [F.col("technology_node")]]
    return lot_state(t).groupingSets(sets, "lot_id", "product", "technology_node").agg(level.alias("level"), *_measures()).select("level", "lot_id", "product", "technology_node", "wafer_count", "avg_yield_pct", "avg_defect_density")


def yield_summary(t: Tables) -> dict[str, DataFrame]:
    """The three reports over one join, whose sums by lot are kept in the shared folder."""
    state = kept(lot_state(t))
    return {"by_lot": yield_by_lot(t, state), "by_product": yield_by_product(t, state), "by_node": yield_by_node(t, state)}


def low_yield_wafers(t: Tables, threshold: float = 80.0) -> DataFrame:
    """Records strictly below the threshold, scrapped wafers included, worst first."""
    low = t["yield_records"].where(F.col("yield_pct") < threshold)
    rows = star({**t, "yield_records": low})
    return rows.select("record_id", "wafer_id", "wafer_number", "lot_id", "product", "technology_node", "yield_pct", "defect_density", "die_count", "pass_count").orderBy("yield_pct", "wafer_id", "record_id")


def defect_density_trend(t: Tables) -> DataFrame:
    return yield_by_lot(t).select("lot_id", "start_date", "avg_defect_density").orderBy("start_date", "lot_id")


def overview_kpis(t: Tables, flags: DataFrame) -> DataFrame:
    """One row: lots, wafers, the mean of the lots' rounded yields, flags, active lots; zeros where there is nothing."""
    lots = yield_by_lot(t).agg(F.count(F.lit(1)).alias("lots"), F.coalesce(F.sum("wafer_count"), F.lit(0)).alias("wafers"), rounded(F.avg("avg_yield_pct"), 4).alias("avg_of_lot_avg_yield_pct"), F.coalesce(F.sum((F.col("status") == "active").cast("long")), F.lit(0)).alias("active_lots"))
    total = flags.agg(F.count(F.lit(1)).alias("flags"))
    return lots.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").select("lots", "wafers", "avg_of_lot_avg_yield_pct", "flags", "active_lots")


def lot_status_counts(t: Tables) -> DataFrame:
    return yield_by_lot(t).groupBy("status").agg(F.count(F.lit(1)).alias("lots")).orderBy(F.desc("lots"), "status")


def defect_by_product(t: Tables) -> DataFrame:
    """Mean of the lots' mean densities (each lot counts alike)."""
    return yield_by_lot(t).groupBy("product").agg(rounded(F.avg("avg_defect_density"), 4).alias("mean_lot_density")).orderBy(F.desc("mean_lot_density"), "product")


def defect_box_by_node(t: Tables) -> DataFrame:
    """Quartiles (exact), whiskers within 1.5 IQR and outliers of the lots' densities. Lots may be any number: the quartiles are
    selected by histograms (exact_quantiles), so no node's lots meet in one place."""
    lots = kept(yield_by_lot(t).select("technology_node", F.col("avg_defect_density").alias("d")))
    box = exact_quantiles(lots, "technology_node", "d", [0.25, 0.5, 0.75]).toDF("technology_node", "q1", "median", "q3")
    rows = lots.join(box, "technology_node")
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("d").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return rows.groupBy("technology_node", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("d"))).alias("low_whisker"), F.max(F.when(inside, F.col("d"))).alias("high_whisker"), F.sum((~inside).cast("long")).alias("outliers")).select("technology_node", *(rounded(F.col(c), 6).alias(c) for c in ("q1", "median", "q3", "low_whisker", "high_whisker")), "outliers").orderBy("technology_node")


def _pairs(t: Tables) -> DataFrame:
    return yield_by_lot(t).select("technology_node", F.col("avg_defect_density").alias("x"), F.col("avg_yield_pct").alias("y"))


def yield_defect_ols(t: Tables) -> DataFrame:
    """Yield on defect density over lots, a line for each node (pooled over nodes the sign may turn)."""
    return _pairs(t).groupBy("technology_node").agg(F.regr_count("y", "x").alias("n"), rounded(F.regr_slope("y", "x"), 6).alias("slope"), rounded(F.regr_intercept("y", "x"), 6).alias("intercept"), rounded(F.regr_r2("y", "x"), 6).alias("r2")).orderBy("technology_node")


def yield_defect_corr(t: Tables) -> DataFrame:
    """Correlation over lots: for each node, and for all of them (technology_node 'all')."""
    pairs = _pairs(t)
    each = pairs.select(F.explode(F.array("technology_node", F.lit("all"))).alias("technology_node"), "x", "y")
    return each.groupBy("technology_node").agg(F.count(F.lit(1)).alias("n"), rounded(F.corr("x", "y"), 6).alias("corr")).orderBy("technology_node")


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in NODES.items()], "technology_node STRING, node_die_count INT, area_cm2 DOUBLE, base_density DOUBLE")


def expected_yield(t: Tables, density: str = "defect_density") -> DataFrame:
    """Poisson yield 100 exp(-area * density), held in [70, 98]; scrapped wafers yield 0."""
    rows = star(t).join(F.broadcast(nodes(t["lots"].sparkSession)), "technology_node")
    poisson = F.least(F.lit(98.0), F.greatest(F.lit(70.0), 100 * F.exp(-F.col("area_cm2") * F.col(density))))
    return rows.withColumn("expected_pct", F.when(F.col("wafer_status") == "scrap", F.lit(0.0)).otherwise(poisson))


def expected_yields(t: Tables) -> DataFrame:
    return expected_yield(t).select("record_id", "wafer_id", "technology_node", rounded(F.col("expected_pct"), 6).alias("expected_pct"))


def expected_pass_counts(t: Tables) -> DataFrame:
    """Passing dies of the unrounded expected yield, ties to the even number."""
    rows = expected_yield(t)
    return rows.select("record_id", "wafer_id", F.bround(F.col("die_count") * F.col("expected_pct") / 100, 0).cast("int").alias("expected_pass"))


def yield_gap_by_node(t: Tables) -> DataFrame:
    return expected_yield(t).groupBy("technology_node").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("yield_pct") - F.col("expected_pct")), 6).alias("mean_gap")).orderBy("technology_node")


def penalised_defect_density(t: Tables, outliers: DataFrame) -> DataFrame:
    """Base density of the node, 15 % higher for each outlier of the wafer."""
    rows = t["wafers"].join(t["lots"].select("lot_id", "technology_node"), "lot_id").join(F.broadcast(nodes(t["lots"].sparkSession)), "technology_node")
    return rows.join(outliers, "wafer_id", "left").select("wafer_id", rounded(F.col("base_density") * (1 + 0.15 * F.coalesce("outliers", F.lit(0))), 6).alias("density"))
