"""Rules, reports and loading on small literal tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fabriloom.operators import genealogy, process, quality, series, spc, yields
from fabriloom.sources import tables as sources
from fabriloom.sources.schemas import DDL, FLAGS_DDL
from fabriloom.streaming import arrivals

START = dt.datetime(2025, 10, 1, 8)


# Small tables whose reports are known.
@pytest.fixture(scope="module")
def t(spark):
    rows = {
        "lots": [(1, "AA100", "28nm", dt.date(2025, 10, 1), "complete"), (2, "BB200", "65nm", dt.date(2025, 11, 1), "active")],
        "wafers": [(1, 1, 1, "complete"), (2, 1, 2, "complete"), (3, 1, 3, "complete"), (4, 2, 1, "active")],
        "process_steps": [(1, "lithography", "LITHO-01", "M1", 1)],
        "measurements": [(1, 1, 1, "cd_nm", 100.0, "nm", START), (2, 2, 1, "cd_nm", 101.0, "nm", START + dt.timedelta(hours=1)), (3, 3, 1, "thickness_nm", 50.0, "nm", START)],
        "yield_records": [(1, 1, 250, 200, 80.0, 0.20), (2, 2, 250, 225, 90.0, 0.15), (3, 3, 250, 250, 100.0, 0.05), (4, 4, 250, 150, 60.0, 0.40)],
    }
    return {name: spark.createDataFrame(r, DDL[name]) for name, r in rows.items()}


@pytest.fixture(scope="module")
def flags(spark):
    at = dt.datetime(2025, 10, 1)
    return spark.createDataFrame([(11, 1, 1, "cd_nm", "rule1_3sigma", at), (21, 2, 1, "cd_nm", "rule1_3sigma", at), (32, 3, 1, "thickness_nm", "rule2_8consec", at)], FLAGS_DDL)


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_reports(t, flags):
    assert values(yields.yield_by_lot(t), "lot_id", "wafer_count", "avg_yield_pct", "avg_defect_density") == [(1, 3, 90.0, 0.1333), (2, 1, 60.0, 0.4)]
    assert values(yields.yield_by_product(t), "product", "avg_yield_pct") == [("AA100", 90.0), ("BB200", 60.0)]
    assert values(yields.yield_by_node(t), "technology_node", "avg_yield_pct") == [("28nm", 90.0), ("65nm", 60.0)]
    assert values(spc.spc_flag_counts(flags), "rule_violated", "flag_count") == [("rule1_3sigma", 2), ("rule2_8consec", 1)]
    assert values(process.measurements_for_step(t, 1, "cd_nm"), "value") == [(100.0,), (101.0,)]
    assert not values(process.measurements_for_step(t, 1, "nonexistent"), "value")
    assert values(yields.low_yield_wafers(t, 85), "wafer_id", "yield_pct") == [(4, 60.0), (1, 80.0)]
    assert values(yields.low_yield_wafers(t, 100), "yield_pct") == [(60.0,), (80.0,), (90.0,)]
    assert not values(yields.low_yield_wafers(t, 50), "yield_pct")
    assert values(yields.defect_density_trend(t), "lot_id") == [(1,), (2,)]
    assert set(yields.yield_summary(t)) == {"by_lot", "by_product", "by_node"}
    detail = values(spc.spc_flags_detail(t, flags), "step_name", "measurement_id")
    assert len(detail) == 3 and {x for x, _ in detail} == {"lithography"}
    assert values(process.process_step_stats(t), "parameter", "n", "mean_value", "variance", "std_dev") == [("cd_nm", 2, 100.5, 0.25, 0.5), ("thickness_nm", 1, 50.0, 0.0, 0.0)]
    assert values(yields.overview_kpis(t, flags), "lots", "wafers", "avg_of_lot_avg_yield_pct", "flags", "active_lots") == [(2, 4, 75.0, 3, 1)]
    assert values(series.wafer_sequence(t).orderBy("wafer_id"), "wafer_idx") == [(0,), (1,), (2,), (3,)]


def test_empty_tables(spark, t):
    """Every report of empty tables has no rows, but for the one row of the overview, which has zeros."""
    none = {name: df.limit(0) for name, df in t.items()}
    no_flags = spc.check_series(none["measurements"])
    assert no_flags.count() == 0 and spc.check_all(none["measurements"]).count() == 0 and spc.numbered(none["measurements"]).count() == 0
    assert values(yields.overview_kpis(none, no_flags), "lots", "wafers", "flags", "active_lots") == [(0, 0, 0, 0)]
    m = none["measurements"]
    reports = [
        *yields.yield_summary(none).values(), yields.yield_rollup(none), yields.low_yield_wafers(none), yields.defect_density_trend(none), yields.lot_status_counts(none), yields.defect_by_product(none), yields.defect_box_by_node(none),
        yields.yield_defect_ols(none), yields.yield_defect_corr(none), yields.expected_yields(none), yields.yield_gap_by_node(none), yields.expected_pass_counts(none), yields.penalised_defect_density(none, process.wafer_outlier_counts(none)),
        series.wafer_sequence(none), series.control_chart(none, no_flags, 1, "cd_nm"), series.drift_early_late(none), series.drift_slope(none), genealogy.lot_genealogy(none, no_flags), genealogy.lot_genealogy_counts(none, no_flags), genealogy.lot_genealogy_points(none, no_flags),
        process.measurements_for_step(none, 1, "cd_nm"), process.measurements_of_step(none, 1), process.step_lookup(none, "etch"), process.lot_lookup(none, 1), process.measured_steps(none), process.process_step_stats(none), process.series_stats(none), process.control_limits(none), process.wafer_outlier_counts(none), process.parameter_histogram(none, 1),
        spc.spc_flag_counts(no_flags), spc.spc_flags_detail(none, no_flags), spc.flag_history(none, no_flags, 1), spc.flagged_steps(none, no_flags), spc.flagged_parameters(no_flags, 1), spc.flagged_point_counts(no_flags), spc.check_with(m, {"r": (lambda v, mean, sd: v > mean, 0)}),
        quality.duplicate_keys(none), quality.orphans(none),
    ]
    assert [i for i, df in enumerate(reports) if not df.isEmpty()] == []


def test_genealogy(t, flags):
    wafers = genealogy.lot_genealogy(t, flags).where("lot_id = 1").orderBy("wafer_id", "page").collect()
    assert [(w["wafer_id"], w["page"]) for w in wafers] == [(1, 0), (2, 0), (3, 0)]
    assert wafers[0]["measurements"][0]["flags"] == ["rule1_3sigma"] and wafers[0]["yields"][0]["yield_pct"] == 80.0
    assert values(genealogy.lot_genealogy_counts(t, flags).orderBy("lot_id"), "wafers", "measurements", "flags", "yields") == [(3, 3, 3, 3), (1, 0, 0, 1)]


def points(spark, xs, mean=None, sd=None):
    df = spark.createDataFrame([(i, 1, 1, "p", float(x), "u", START + dt.timedelta(minutes=i)) for i, x in enumerate(xs)], DDL["measurements"])
    return df if mean is None else df.withColumns({"mean": F.lit(float(mean)), "sd": F.lit(float(sd))})


@pytest.mark.parametrize(
    ("rule", "xs", "hit"),
    [
        ("rule1_3sigma", [100] * 9 + [120], {9}), ("rule1_3sigma", [110] * 10, set()),
        ("rule2_8consec", [101] * 8 + [99] * 2, set(range(8))), ("rule2_8consec", [101, 99] * 5, set()), ("rule2_8consec", [99] * 8, set(range(8))),
        ("rule3_6trend", [1, 2, 3, 4, 5, 6, 3, 3], set(range(6))), ("rule3_6trend", [6, 5, 4, 3, 2, 1], set(range(6))), ("rule3_6trend", [100] * 8, set()), ("rule3_6trend", [1, 2, 3, 4, 5, 4], set()),
        ("rule4_2of3_2sigma", [115, 115, 100, 100, 100], {0, 1, 2}), ("rule4_2of3_2sigma", [115, 100, 85, 100, 115, 100, 85], set()), ("rule4_2of3_2sigma", [107.5] * 5, set()),
    ],
)
def test_rules(spark, rule, xs, hit):
    df = spc.marked(points(spark, xs, 100, 5))
    assert {r["measurement_id"] for r in df.where(rule).collect()} == hit


def brute(xs):
    n = len(xs)
    if n < 2:
        return set()
    mean = sum(xs) / n
    sd = (sum((x - mean) ** 2 for x in xs) / (n - 1)) ** 0.5
    if sd == 0:
        return set()
    out = {(i, "rule1_3sigma") for i, x in enumerate(xs) if abs(x - mean) > 3 * sd}
    for size, name, test in ((8, "rule2_8consec", lambda w: all(x > mean for x in w) or all(x < mean for x in w)), (6, "rule3_6trend", lambda w: all(a < b for a, b in zip(w, w[1:])) or all(a > b for a, b in zip(w, w[1:]))), (3, "rule4_2of3_2sigma", lambda w: sum(x > mean + 2 * sd for x in w) > 1 or sum(x < mean - 2 * sd for x in w) > 1)):
        for i in range(n - size + 1):
            if test(xs[i : i + size]):
                out |= {(k, name) for k in range(i, i + size)}
    return out


def test_series_against_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for s in range(30):
        xs = [rng.choice([rng.gauss(0, 1), float(rng.randint(-2, 2)), i / 10]) for i in range(rng.choice([1, 2, 5, 7, 8, 40, 150]))]
        rows += [(s * 1000 + i, 1, s, "p", float(x), "u", START + dt.timedelta(minutes=i)) for i, x in enumerate(xs)]
        want |= {(s * 1000 + i, rule) for i, rule in brute(xs)}
    df = spark.createDataFrame(rows, DDL["measurements"])
    assert set(values(spc.check_series(df), "measurement_id", "rule_violated")) == want
    for size in (1, 20, 37):
        assert set(values(spc.check_long_series(df, size), "measurement_id", "rule_violated")) == want
    assert set(values(spc.check_all(df, rows_per_bucket=100), "measurement_id", "rule_violated")) == want
    # many points of one instant, and cuts with hardly any
    tied = df.withColumn("timestamp", F.when(F.col("measurement_id") % 1000 < 60, F.lit(START)).otherwise(F.col("timestamp")))
    assert set(values(spc.check_long_series(tied, 20), "measurement_id", "rule_violated")) == set(values(spc.check_series(tied), "measurement_id", "rule_violated"))
    assert spc.check_series(points(spark, [105] * 9 + [95])).count() == 9 and spc.check_series(points(spark, [0.1] * 50)).count() == 0
    for size in (1, 20, 10**6):
        assert set(values(spc.check_with(df, {"rule1_3sigma": (lambda v, m, s: abs(v - m) > 3 * s, 0)}, size), "measurement_id", "rule_violated")) == {x for x in want if x[1] == "rule1_3sigma"}


def test_load_and_checks(spark, t, tmp_path):
    csv, db = f"{tmp_path}/csv", f"{tmp_path}/db"
    for name, df in t.items():
        sources.write_csv(df.coalesce(1), f"{csv}/{name}.csv")
    assert sources.seed_if_empty(spark, csv, db)
    assert not sources.seed_if_empty(spark, csv, db)
    assert dict(values(sources.load_all(spark, csv, db), "table_name", "rows")) == {k: df.count() for k, df in t.items()}
    back = sources.read_table(spark, db, "measurements")
    assert sorted(back.select(*t["measurements"].columns).collect()) == sorted(t["measurements"].collect())
    # more points: nine on one side of the mean; flags are replaced, not added
    more = points(spark, [105] * 9 + [95]).withColumn("measurement_id", F.col("measurement_id") + 100)
    sources.append(more, db, "measurements")
    assert sources.read_table(spark, db, "measurements").count() == t["measurements"].count() + 10
    assert sources.recompute_flags(spark, db) == sources.recompute_flags(spark, db) == 9
    stored = sources.read_table(spark, db, "spc_flags")
    assert sorted(values(stored, "flag_id", "measurement_id", "rule_violated")) == [(10 * i + 2, i, "rule2_8consec") for i in range(100, 109)]
    # a load that fails midway leaves everything as it was; one that works drops the flags
    bad = f"{tmp_path}/bad"
    for name, df in t.items():
        sources.write_csv((df.withColumn("die_count", F.lit("many")) if name == "yield_records" else df).coalesce(1), f"{bad}/{name}.csv")
    with pytest.raises(Exception):
        sources.load_all(spark, bad, db)
    assert sources.read_table(spark, db, "measurements").count() == t["measurements"].count() + 10 and sources.read_table(spark, db, "spc_flags").count() == 9
    sources.load_all(spark, csv, db)
    assert sources.read_table(spark, db, "spc_flags").count() == 0


def test_quality(spark, t, flags):
    every = {**t, "spc_flags": flags}
    assert quality.duplicate_keys(every).count() == 0 and quality.orphans(every).count() == 0
    assert {r["rule"]: r["violations"] for r in quality.range_rules(t).collect()}["yield_in_70_98"] == 2
    assert quality.null_counts(every).where("nulls > 0").count() == 0 and quality.long_strings(every).where("too_long > 0").count() == 0
    worse = {**every, "spc_flags": flags.union(spark.createDataFrame([(11, 99, 1, "p", "r" * 33, None)], FLAGS_DDL)), "wafers": t["wafers"].union(spark.createDataFrame([(5, 77, 1, "active")], DDL["wafers"]))}
    assert values(quality.duplicate_keys(worse), "table_name", "key", "n") == [("spc_flags", 11, 2)]
    assert sorted(values(quality.orphans(worse), "edge", "key", "n")) == [("spc_flags.measurement_id", 99, 1), ("wafers.lot_id", 77, 1)]
    assert values(quality.null_counts(worse).where("nulls > 0"), "table_name", "column_name", "nulls") == [("spc_flags", "flagged_at", 1)]
    assert values(quality.long_strings(worse).where("too_long > 0"), "table_name", "column_name") == [("spc_flags", "rule_violated")]


def test_orphans_of_large_parents_are_in_many_tasks(spark):
    lots = spark.range(20_000).selectExpr("id AS lot_id", "'p' AS product", "'28nm' AS technology_node", "DATE '2025-10-01' AS start_date", "'hold' AS status")
    wafers = spark.range(30_000).selectExpr("id AS wafer_id", "CAST(nullif(id % 10000 * 3, 0) AS INT) AS lot_id", "1 AS wafer_number", "'active' AS status")
    found = quality.orphans({"lots": lots, "wafers": wafers}, 1000)
    assert sorted(values(found, "edge", "key", "n")) == [("wafers.lot_id", k, 3) for k in range(20_001, 30_000, 3)]
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < 300


def test_one_step_and_pass_counts(spark, t):
    assert values(process.process_step_stats(t, 1), "parameter", "n") == [("cd_nm", 2), ("thickness_nm", 1)] and not values(process.process_step_stats(t, 2), "n")
    # ties go to the even number: 70 % of 250, 350 and 450 hundredths of dies
    rows = {**t, "yield_records": spark.createDataFrame([(i, 4, n, 0, 0.0, 9.0) for i, n in enumerate((5, 15, 25, 45, 100))], DDL["yield_records"])}
    assert values(yields.expected_pass_counts(rows).orderBy("record_id"), "expected_pass") == [(4,), (10,), (18,), (32,), (70,)]


def test_arrivals(spark, tmp_path):
    stored = points(spark, [1, 2, 3] * 20)
    points(spark, [2, 50, 3, -40]).coalesce(1).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{tmp_path}/in")
    found = arrivals.flag_arrivals(arrivals.read_arrivals(spark, f"{tmp_path}/in"), stored)
    query = found.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination(120)
    assert sorted(values(spark.table("arrived"), "measurement_id", "rule_violated")) == [(1, "rule1_3sigma"), (3, "rule1_3sigma")]
