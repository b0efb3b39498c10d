"""Every query over the mapped tables, and the same in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.operators import genealogy, process, quality, series, spc, yields
from fabriloom.sources import gate, schemas
from fabriloom.sources import tables as sources
from fabriloom.sources.mapping import oracle_views, tables

VIEWS = oracle_views()


def _r(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {n}) AS DOUBLE)"


STAR = "yield_records y JOIN wafers w USING (wafer_id) JOIN lots l USING (lot_id)"
MEASURES = f"count(record_id) AS wafer_count, {_r('avg(yield_pct)', 2)} AS avg_yield_pct, {_r('avg(defect_density)', 4)} AS avg_defect_density"
BY_LOT = f"by_lot AS (SELECT lot_id, product, technology_node, start_date, l.status AS status, {MEASURES} FROM {STAR} GROUP BY lot_id, product, technology_node, start_date, l.status)"
FLAGS = """lim AS (SELECT step_id, parameter, avg(value) AS mean, stddev_samp(value) AS sd FROM measurements GROUP BY step_id, parameter),
pts AS (SELECT m.measurement_id, m.step_id, m.parameter, m.value, m.timestamp, mean, sd, m.value - lag(m.value) OVER (PARTITION BY m.step_id, m.parameter ORDER BY m.timestamp, m.measurement_id) AS step FROM measurements m JOIN lim ON m.step_id = lim.step_id AND m.parameter = lim.parameter WHERE sd > 0),
ends AS (SELECT *, (sum(CASE WHEN value > mean THEN 1 ELSE 0 END) OVER w8 = 8 OR sum(CASE WHEN value < mean THEN 1 ELSE 0 END) OVER w8 = 8) AS e2,
 (sum(CASE WHEN step > 0 THEN 1 ELSE 0 END) OVER w5 = 5 OR sum(CASE WHEN step < 0 THEN 1 ELSE 0 END) OVER w5 = 5) AS e3,
 (count(*) OVER w3 = 3 AND (sum(CASE WHEN value > mean + 2 * sd THEN 1 ELSE 0 END) OVER w3 >= 2 OR sum(CASE WHEN value < mean - 2 * sd THEN 1 ELSE 0 END) OVER w3 >= 2)) AS e4
 FROM pts WINDOW w8 AS (PARTITION BY step_id, parameter ORDER BY timestamp, measurement_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY step_id, parameter ORDER BY timestamp, measurement_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY step_id, parameter ORDER BY timestamp, measurement_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
hits AS (SELECT *, abs(value - mean) > 3 * sd AS r1, max(CASE WHEN e2 THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) = 1 AS r2, max(CASE WHEN e3 THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 1 AS r3, max(CASE WHEN e4 THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 1 AS r4 FROM ends WINDOW o AS (PARTITION BY step_id, parameter ORDER BY timestamp, measurement_id)),
flags AS (SELECT measurement_id, step_id, parameter, 'rule1_3sigma' AS rule_violated FROM hits WHERE r1 UNION ALL SELECT measurement_id, step_id, parameter, 'rule2_8consec' FROM hits WHERE r2 UNION ALL SELECT measurement_id, step_id, parameter, 'rule3_6trend' FROM hits WHERE r3 UNION ALL SELECT measurement_id, step_id, parameter, 'rule4_2of3_2sigma' FROM hits WHERE r4)"""
DETAIL = "detail AS (SELECT f.measurement_id, rule_violated, f.step_id, step_name, tool_id, f.parameter, value, timestamp AS measured_at, m.wafer_id, wafer_number, l.lot_id, product FROM flags f JOIN measurements m ON m.measurement_id = f.measurement_id JOIN process_steps p ON p.step_id = f.step_id JOIN wafers w ON w.wafer_id = m.wafer_id JOIN lots l ON l.lot_id = w.lot_id)"
NODES = "nodes AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for k, (a, b, c) in yields.NODES.items()) + ") AS v(technology_node, node_die_count, area_cm2, base_density))"
EXPECTED = f"expected AS (SELECT record_id, y.wafer_id, technology_node, yield_pct, die_count, CASE WHEN w.status = 'scrap' THEN 0.0 ELSE least(98.0, greatest(70.0, 100 * exp(-area_cm2 * defect_density))) END AS e FROM {STAR} JOIN nodes USING (technology_node))"
OUTLIERS = "outl AS (SELECT wafer_id, count(*) AS outliers FROM measurements m JOIN (SELECT parameter, avg(value) AS mean, stddev_samp(value) AS sd FROM measurements GROUP BY parameter) s USING (parameter) WHERE abs((value - mean) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END) > 3 GROUP BY wafer_id)"
SEQUENCE = "seq AS (SELECT wafer_id, row_number() OVER (ORDER BY start_date, lot_id, wafer_number, wafer_id) - 1 AS wafer_idx FROM wafers JOIN lots USING (lot_id))"
STEP, PARAMETER = 3, "view"
FLAG_IDS = "spc_flags AS (SELECT measurement_id * 10 + CAST(substr(rule_violated, 5, 1) AS BIGINT) AS flag_id, * FROM flags)"


def four_of_five_beyond_1_sigma(values, mean, sd):
    """Points in a run of five of which four are beyond one standard deviation on the same side."""
    hit = np.zeros(len(values), bool)
    for side in (values > mean + sd, values < mean - sd):
        ends = np.flatnonzero(np.convolve(side, np.ones(5), "valid") >= 4) if len(values) >= 5 else np.zeros(0, int)
        for k in range(5):
            hit[ends + k] = True
    return hit


def far_from_neighbours(values, mean, sd):
    """Points over three standard deviations away from both neighbours."""
    far = np.abs(np.diff(values)) > 3 * sd
    return np.r_[False, far] & np.r_[far, False]


#: rule -> (rule, how far away a value can decide on a point)
USER_RULES = {"four_of_five_1_sigma": (four_of_five_beyond_1_sigma, 4), "far_from_neighbours": (far_from_neighbours, 1)}
_W5 = "(PARTITION BY step_id, parameter ORDER BY timestamp, measurement_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
USER_FLAGS = f"""fives AS (SELECT *, count(*) OVER {_W5} = 5 AND (sum(CASE WHEN value > mean + sd THEN 1 ELSE 0 END) OVER {_W5} >= 4 OR sum(CASE WHEN value < mean - sd THEN 1 ELSE 0 END) OVER {_W5} >= 4) AS e FROM pts),
near AS (SELECT *, max(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY step_id, parameter ORDER BY timestamp, measurement_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) = 1 AS u1, abs(step) > 3 * sd AND abs(lead(step) OVER (PARTITION BY step_id, parameter ORDER BY timestamp, measurement_id)) > 3 * sd AS u2 FROM fives),
user_flags AS (SELECT measurement_id, step_id, parameter, 'four_of_five_1_sigma' AS rule_violated FROM near WHERE u1 UNION ALL SELECT measurement_id, step_id, parameter, 'far_from_neighbours' FROM near WHERE u2)"""


#: Measurements on their way in, made of the stored ones so that each kind of check has something to find: half of the keys are
#: stored already, some repeat, some wafers don't exist, one kind of parameter is missing, and some units are too long.
_ARRIVING = {"measurement_id": "measurement_id * 2 - measurement_id % 3", "wafer_id": "wafer_id * 7", "step_id": "step_id + 1", "parameter": "nullif(parameter, 'view')", "value": "value", "unit": "repeat(unit, step_id * 3)", "timestamp": "timestamp"}
ARRIVING = "arriving AS (SELECT " + ", ".join(f"{how} AS {c}" for c, how in _ARRIVING.items()) + " FROM measurements)"
GATE = [
    "SELECT 'repeated' AS \"check\", 'measurement_id' AS column_name, count(*) AS violations FROM (SELECT measurement_id FROM arriving GROUP BY measurement_id HAVING count(*) > 1)",
    "SELECT 'stored', 'measurement_id', count(DISTINCT measurement_id) FROM arriving WHERE measurement_id IN (SELECT measurement_id FROM measurements)",
    *(f"SELECT 'orphan', '{c}', count(DISTINCT {c}) FROM arriving WHERE {c} NOT IN (SELECT {c} FROM {p})" for c, p in (("wafer_id", "wafers"), ("step_id", "process_steps"))),
    *(f"SELECT 'null', '{c}', count(*) - count({c}) FROM arriving" for c in schemas.COLUMNS["measurements"]),
    *(f"SELECT 'width', '{c}', count(*) FILTER (WHERE length({c}) > {n}) FROM arriving" for c, n in schemas.WIDTHS["measurements"].items()),
    *(f"SELECT 'range', '{r}', count(*) FILTER (WHERE {w}) FROM arriving" for r, w in schemas.RANGES["measurements"].items()),
]


def arriving(t: sources.Tables) -> DataFrame:
    return t["measurements"].selectExpr(*(f"{how} AS {c}" for c, how in _ARRIVING.items()))


def _flags(t: sources.Tables) -> DataFrame:
    return spc.check_all(t["measurements"])


def _with_flags(check: Callable[[sources.Tables], DataFrame]) -> Callable[[sources.Tables], DataFrame]:
    """A check of all tables, the flags among them."""
    return lambda t: check({**t, "spc_flags": spc.with_ids(_flags(t)).select("flag_id", "measurement_id", "step_id", "parameter", "rule_violated")})


def _dated(df: DataFrame) -> DataFrame:
    """Dates as text, which every engine hands over alike."""
    return df.withColumn("start_date", F.col("start_date").cast("string"))


Build = Callable[[sources.Tables], DataFrame]


_ALL = [("lots", ["lot_id", "product", "technology_node", "start_date", "status"]), ("wafers", ["wafer_id", "lot_id", "wafer_number", "status"]), ("process_steps", ["step_id", "step_name", "tool_id", "layer", "sequence_order"]), ("measurements", ["measurement_id", "wafer_id", "step_id", "parameter", "value", "unit", "timestamp"]), ("yield_records", ["record_id", "wafer_id", "die_count", "pass_count", "yield_pct", "defect_density"])]
_EDGES = [("wafers", "lot_id", "lots"), ("measurements", "wafer_id", "wafers"), ("measurements", "step_id", "process_steps"), ("yield_records", "wafer_id", "wafers"), ("spc_flags", "measurement_id", "measurements")]
_CHECKED = [*_ALL, ("spc_flags", ["flag_id", "measurement_id", "step_id", "parameter", "rule_violated"])]
_RULES = [("yield_in_70_98", "yield_records", "pass_count > 0 AND NOT (yield_pct BETWEEN 70 AND 98)"), ("pass_count_le_die_count", "yield_records", "pass_count > die_count"), ("defect_density_positive", "yield_records", "defect_density <= 0"), ("die_count_positive", "yield_records", "die_count <= 0"), ("wafer_number_1_25", "wafers", "NOT (wafer_number BETWEEN 1 AND 25)"), ("known_technology_node", "lots", "technology_node NOT IN ('28nm', '65nm', '130nm', '180nm')"), ("value_is_a_number", "measurements", "isnan(value)")]
_KEYS = {"lots": "lot_id", "wafers": "wafer_id", "process_steps": "step_id", "measurements": "measurement_id", "yield_records": "record_id", "spc_flags": "flag_id"}
_WIDTHS = {"lots": {"product": 64, "technology_node": 16, "status": 16}, "wafers": {"status": 16}, "process_steps": {"step_name": 64, "tool_id": 32, "layer": 32}, "measurements": {"parameter": 32, "unit": 16}, "spc_flags": {"rule_violated": 32}}

#: query -> (builder over the mapped tables, more WITH clauses, SELECT)
PLANS: dict[str, tuple[Build, list[str], str]] = {
    "table_counts": (sources.counts, [], " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t, _ in _ALL)),
    "dq_duplicate_keys": (_with_flags(quality.duplicate_keys), [FLAGS, FLAG_IDS], " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({k} AS BIGINT) AS key, count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1" for t, k in _KEYS.items())),
    "dq_null_counts": (_with_flags(quality.null_counts), [FLAGS, FLAG_IDS], " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS nulls FROM {t}" for t, cs in _CHECKED for c in cs)),
    "dq_orphans": (_with_flags(lambda t: quality.orphans(t, spc.SHARE)), [FLAGS, FLAG_IDS], " UNION ALL ".join(f"SELECT '{a}.{c}' AS edge, CAST({c} AS BIGINT) AS key, count(*) AS n FROM {a} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM {b}) GROUP BY {c}" for a, c, b in _EDGES)),
    "dq_string_length": (_with_flags(quality.long_strings), [FLAGS, FLAG_IDS], " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE length({c}) > {n}) AS too_long FROM {t}" for t, cs in _WIDTHS.items() for c, n in cs.items())),
    "dq_range_rules": (quality.range_rules, [], " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {w}) AS violations FROM {t}" for r, t, w in _RULES)),
    "measurements_for_step": (lambda t: process.measurements_for_step(t, STEP, PARAMETER), [], f"SELECT measurement_id, wafer_id, value, timestamp FROM measurements WHERE step_id = {STEP} AND parameter = '{PARAMETER}'"),
    "measurements_of_step": (lambda t: process.measurements_of_step(t, STEP), [], f"SELECT measurement_id, parameter, value, unit FROM measurements WHERE step_id = {STEP}"),
    "low_yield_wafers": (yields.low_yield_wafers, [], f"SELECT record_id, wafer_id, wafer_number, lot_id, product, technology_node, yield_pct, defect_density, die_count, pass_count FROM {STAR} WHERE yield_pct < 80"),
    "step_lookup": (lambda t: process.step_lookup(t, "NATION_3"), [], "SELECT min(step_id) AS step_id FROM process_steps WHERE step_name = 'NATION_3' HAVING count(*) > 0"),
    "lot_lookup": (lambda t: _dated(process.lot_lookup(t, 7)), [], "SELECT * REPLACE (CAST(start_date AS VARCHAR) AS start_date) FROM lots WHERE lot_id = 7"),
    "flag_history": (lambda t: spc.flag_history(t, _flags(t), STEP), [FLAGS, DETAIL], f"SELECT measurement_id, rule_violated, parameter, value, measured_at, wafer_number, lot_id, product FROM detail WHERE step_id = {STEP}"),
    "flagged_steps": (lambda t: spc.flagged_steps(t, _flags(t)), [FLAGS], "SELECT DISTINCT step_id, concat(step_name, ' (', tool_id, ')') AS label FROM flags JOIN process_steps USING (step_id)"),
    "flagged_parameters": (lambda t: spc.flagged_parameters(_flags(t), STEP), [FLAGS], f"SELECT DISTINCT parameter FROM flags WHERE step_id = {STEP}"),
    "measured_steps": (process.measured_steps, [], "SELECT DISTINCT step_id, concat(step_name, ' (', tool_id, ')') AS label, parameter FROM measurements JOIN process_steps USING (step_id)"),
    "spc_flags_detail": (lambda t: spc.spc_flags_detail(t, _flags(t)), [FLAGS, DETAIL], "SELECT * FROM detail"),
    "lot_genealogy_counts": (lambda t: genealogy.lot_genealogy_counts(t, _flags(t)), [FLAGS], "SELECT l.lot_id, (coalesce(w.n, 0)) AS wafers, coalesce(m.n, 0) AS measurements, coalesce(f.n, 0) AS flags, coalesce(y.n, 0) AS yields FROM lots l LEFT JOIN (SELECT lot_id, count(*) AS n FROM wafers GROUP BY lot_id) w USING (lot_id) LEFT JOIN (SELECT lot_id, count(*) AS n FROM measurements JOIN wafers USING (wafer_id) GROUP BY lot_id) m USING (lot_id) LEFT JOIN (SELECT lot_id, count(*) AS n FROM flags JOIN measurements USING (measurement_id) JOIN wafers USING (wafer_id) GROUP BY lot_id) f USING (lot_id) LEFT JOIN (SELECT lot_id, count(*) AS n FROM yield_records JOIN wafers USING (wafer_id) GROUP BY lot_id) y USING (lot_id)"),
    "yield_by_lot": (lambda t: _dated(yields.yield_by_lot(t)), [BY_LOT], "SELECT * REPLACE (CAST(start_date AS VARCHAR) AS start_date) FROM by_lot"),
    "yield_by_product": (yields.yield_by_product, [], f"SELECT product, {MEASURES} FROM {STAR} GROUP BY product"),
    "yield_by_node": (yields.yield_by_node, [], f"SELECT technology_node, {MEASURES} FROM {STAR} GROUP BY technology_node"),
    "spc_flag_counts": (lambda t: spc.spc_flag_counts(_flags(t)), [FLAGS], "SELECT rule_violated, count(*) AS flag_count FROM flags GROUP BY rule_violated"),
    "process_step_stats": (process.process_step_stats, [], f"SELECT step_id, step_name, tool_id, sequence_order, parameter, n, mean_value, variance, {_r('sqrt(greatest(variance, 0.0))', 6)} AS std_dev FROM (SELECT step_id, parameter, count(*) AS n, {_r('avg(value)', 4)} AS mean_value, {_r('var_pop(value)', 6)} AS variance FROM measurements GROUP BY step_id, parameter) JOIN process_steps USING (step_id)"),
    "series_stats": (process.series_stats, [], f"SELECT step_id, parameter, {_r('avg(value)', 6)} AS mean, {_r('stddev_samp(value)', 6)} AS sd FROM measurements GROUP BY step_id, parameter"),
    "control_limits": (process.control_limits, [], f"SELECT step_id, parameter, {_r('avg(value)', 6)} AS center, {_r('avg(value) - 3 * stddev_samp(value)', 6)} AS lcl, {_r('avg(value) + 3 * stddev_samp(value)', 6)} AS ucl FROM measurements GROUP BY step_id, parameter"),
    "overview_kpis": (lambda t: yields.overview_kpis(t, _flags(t)), [BY_LOT, FLAGS], f"SELECT count(*) AS lots, CAST(coalesce(sum(wafer_count), 0) AS BIGINT) AS wafers, {_r('avg(avg_yield_pct)', 4)} AS avg_of_lot_avg_yield_pct, (SELECT count(*) FROM flags) AS flags, count(*) FILTER (WHERE status = 'active') AS active_lots FROM by_lot"),
    "lot_status_counts": (yields.lot_status_counts, [BY_LOT], "SELECT status, count(*) AS lots FROM by_lot GROUP BY status"),
    "defect_by_product": (yields.defect_by_product, [BY_LOT], f"SELECT product, {_r('avg(avg_defect_density)', 4)} AS mean_lot_density FROM by_lot GROUP BY product"),
    "wafer_outlier_counts": (process.wafer_outlier_counts, [OUTLIERS], "SELECT * FROM outl"),
    "parameter_histogram": (lambda t: process.parameter_histogram(t, STEP), [], f"SELECT parameter, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 30), 29) ELSE 0 END AS INT) AS bin, count(*) AS n FROM measurements JOIN (SELECT parameter, min(value) AS lo, max(value) AS hi FROM measurements WHERE step_id = {STEP} GROUP BY parameter) USING (parameter) WHERE step_id = {STEP} GROUP BY 1, 2"),
    "defect_box_by_node": (yields.defect_box_by_node, [BY_LOT, "q AS (SELECT technology_node, quantile_cont(avg_defect_density, 0.25) AS q1, quantile_cont(avg_defect_density, 0.5) AS med, quantile_cont(avg_defect_density, 0.75) AS q3 FROM by_lot GROUP BY technology_node)"], f"SELECT technology_node, {_r('q1', 6)} AS q1, {_r('med', 6)} AS median, {_r('q3', 6)} AS q3, {_r('min(d) FILTER (WHERE ok)', 6)} AS low_whisker, {_r('max(d) FILTER (WHERE ok)', 6)} AS high_whisker, count(*) FILTER (WHERE NOT ok) AS outliers FROM (SELECT *, avg_defect_density AS d, avg_defect_density BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM by_lot JOIN q USING (technology_node)) GROUP BY technology_node, q1, med, q3"),
    "yield_defect_ols": (yields.yield_defect_ols, [BY_LOT], f"SELECT technology_node, CAST(regr_count(avg_yield_pct, avg_defect_density) AS BIGINT) AS n, {_r('regr_slope(avg_yield_pct, avg_defect_density)', 6)} AS slope, {_r('regr_intercept(avg_yield_pct, avg_defect_density)', 6)} AS intercept, {_r('regr_r2(avg_yield_pct, avg_defect_density)', 6)} AS r2 FROM by_lot GROUP BY technology_node"),
    "yield_defect_corr": (yields.yield_defect_corr, [BY_LOT], f"SELECT technology_node, count(*) AS n, {_r('corr(avg_defect_density, avg_yield_pct)', 6)} AS corr FROM by_lot GROUP BY technology_node UNION ALL SELECT 'all', count(*), {_r('corr(avg_defect_density, avg_yield_pct)', 6)} FROM by_lot HAVING count(*) > 0"),
    "defect_density_trend": (lambda t: _dated(yields.defect_density_trend(t)), [BY_LOT], "SELECT lot_id, CAST(start_date AS VARCHAR) AS start_date, avg_defect_density FROM by_lot"),
    "flagged_point_counts": (lambda t: spc.flagged_point_counts(_flags(t)), [FLAGS], "SELECT step_id, parameter, count(DISTINCT measurement_id) AS points FROM flags GROUP BY step_id, parameter"),
    **{
        f"spc_{name.split('_')[0]}": ((lambda name: lambda t: spc.check_all(t["measurements"], {name: spc.RULES[name]}).drop("rule_violated"))(name), [FLAGS], f"SELECT measurement_id, step_id, parameter FROM flags WHERE rule_violated = '{name}'")
        for name in spc.RULES
    },
    "spc_flags": (_flags, [FLAGS], "SELECT * FROM flags"),
    "spc_flags_bucketed": (lambda t: spc.check_long_series(t["measurements"], 100), [FLAGS], "SELECT * FROM flags"),
    "spc_user_rules": (lambda t: spc.with_ids(spc.check_with(t["measurements"], USER_RULES, 200)).select("measurement_id", "step_id", "parameter", "rule_violated", (F.col("flag_id") < 0).alias("own_id")), [FLAGS, USER_FLAGS], "SELECT measurement_id, step_id, parameter, rule_violated, true AS own_id FROM user_flags"),
    "append_gate": (lambda t: gate.gate({"measurements": arriving(t)}, t), [ARRIVING], "SELECT 'measurements' AS table_name, * FROM (" + " UNION ALL ".join(GATE) + ")"),
    "lot_genealogy_pages": (
        lambda t: genealogy.lot_genealogy_pages(t, _flags(t), 4),
        [FLAGS, "placed AS (SELECT wafer_id, measurement_id, (row_number() OVER (PARTITION BY wafer_id ORDER BY measurement_id) - 1) // 4 AS page FROM measurements), per_flag AS (SELECT measurement_id, count(*) AS f FROM flags GROUP BY measurement_id), pages AS (SELECT wafer_id, page, count(*) AS points, CAST(sum(coalesce(f, 0)) AS INTEGER) AS flags, min(measurement_id) AS first_point, max(measurement_id) AS last_point FROM placed LEFT JOIN per_flag USING (measurement_id) GROUP BY wafer_id, page), records AS (SELECT wafer_id, count(*) AS n FROM yield_records GROUP BY wafer_id)"],
        "SELECT l.lot_id, w.wafer_id, coalesce(page, 0) AS page, CAST(CASE WHEN coalesce(page, 0) = 0 THEN coalesce(r.n, 0) ELSE 0 END AS INTEGER) AS yields, CAST(coalesce(points, 0) AS INTEGER) AS points, coalesce(p.flags, 0) AS flags, first_point, last_point FROM lots l LEFT JOIN wafers w USING (lot_id) LEFT JOIN pages p ON p.wafer_id = w.wafer_id LEFT JOIN records r ON r.wafer_id = w.wafer_id",
    ),
    "yield_summary": (yields.yield_rollup, [BY_LOT], f"SELECT 'lot' AS level, lot_id, CAST(NULL AS VARCHAR) AS product, CAST(NULL AS VARCHAR) AS technology_node, wafer_count, avg_yield_pct, avg_defect_density FROM by_lot UNION ALL SELECT 'product', NULL, product, NULL, {MEASURES} FROM {STAR} GROUP BY product UNION ALL SELECT 'node', NULL, NULL, technology_node, {MEASURES} FROM {STAR} GROUP BY technology_node"),
    "lot_genealogy_points": (lambda t: genealogy.lot_genealogy_points(t, _flags(t)), [FLAGS], "SELECT lot_id, wafer_id, wafer_number, measurement_id, step_name, m.parameter, value, coalesce((SELECT string_agg(rule_violated, ',' ORDER BY rule_violated) FROM flags f WHERE f.measurement_id = m.measurement_id), '') AS flags FROM measurements m JOIN wafers USING (wafer_id) JOIN lots USING (lot_id) LEFT JOIN process_steps USING (step_id)"),
    "process_step_stats_of_one": (lambda t: process.process_step_stats(t, STEP), [], f"SELECT step_id, step_name, tool_id, sequence_order, parameter, n, mean_value, variance, {_r('sqrt(greatest(variance, 0.0))', 6)} AS std_dev FROM (SELECT step_id, parameter, count(*) AS n, {_r('avg(value)', 4)} AS mean_value, {_r('var_pop(value)', 6)} AS variance FROM measurements WHERE step_id = {STEP} GROUP BY step_id, parameter) JOIN process_steps USING (step_id)"),
    "expected_pass_counts": (yields.expected_pass_counts, [NODES, EXPECTED], "SELECT record_id, wafer_id, CAST(round_even(die_count * e / 100, 0) AS INT) AS expected_pass FROM expected"),
    "control_chart": (lambda t: series.control_chart(t, _flags(t), STEP, PARAMETER), [FLAGS], f"SELECT measurement_id, row_number() OVER (ORDER BY timestamp, measurement_id) - 1 AS sample, value, timestamp, {_r('mean', 6)} AS center, {_r('mean - 3 * sd', 6)} AS lcl, {_r('mean + 3 * sd', 6)} AS ucl, measurement_id IN (SELECT measurement_id FROM flags) AS flagged FROM measurements JOIN lim USING (step_id, parameter) WHERE step_id = {STEP} AND parameter = '{PARAMETER}'"),
    "wafer_sequence": (series.wafer_sequence, [SEQUENCE], "SELECT * FROM seq"),
    "drift_early_late": (series.drift_early_late, [], f"SELECT step_id, parameter, {_r('avg(value) FILTER (WHERE u <= 50)', 6)} AS early_mean, {_r('avg(value) FILTER (WHERE d <= 50)', 6)} AS late_mean, {_r('avg(value) FILTER (WHERE u <= 50) - avg(value) FILTER (WHERE d <= 50)', 6)} AS drift FROM (SELECT *, row_number() OVER (PARTITION BY step_id, parameter ORDER BY timestamp, measurement_id) AS u, row_number() OVER (PARTITION BY step_id, parameter ORDER BY timestamp DESC, measurement_id DESC) AS d FROM measurements) GROUP BY step_id, parameter"),
    "drift_slope": (series.drift_slope, [SEQUENCE], f"SELECT tool_id, parameter, count(*) AS n, {_r('regr_slope(value, wafer_idx)', 8)} AS slope FROM measurements JOIN seq USING (wafer_id) JOIN process_steps USING (step_id) GROUP BY tool_id, parameter"),
    "expected_yield": (yields.expected_yields, [NODES, EXPECTED], f"SELECT record_id, wafer_id, technology_node, {_r('e', 6)} AS expected_pct FROM expected"),
    "yield_gap_by_node": (yields.yield_gap_by_node, [NODES, EXPECTED], f"SELECT technology_node, count(*) AS n, {_r('avg(yield_pct - e)', 6)} AS mean_gap FROM expected GROUP BY technology_node"),
    "penalised_defect_density": (lambda t: yields.penalised_defect_density(t, process.wafer_outlier_counts(t)), [NODES, OUTLIERS], f"SELECT wafer_id, {_r('base_density * (1 + 0.15 * coalesce(outliers, 0))', 6)} AS density FROM wafers JOIN lots USING (lot_id) JOIN nodes USING (technology_node) LEFT JOIN outl USING (wafer_id)"),
}


def _query(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(tables(spark, sf_dir))


QUERIES = {name: _query(build) for name, (build, _, _) in PLANS.items()}
#: Nested rows have no SQL of their own; lot_genealogy_points and lot_genealogy_pages compare what is in them.
QUERIES["lot_genealogy"] = _query(lambda t: genealogy.lot_genealogy(t, _flags(t)))
ORACLE_SQL = {name: f"{', '.join([VIEWS, *more])} {select}" for name, (_, more, select) in PLANS.items()}
