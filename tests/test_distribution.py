"""Quantiles, genealogy pages, yield sums and buckets: right results without a group in one place."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabriloom.functions.quantiles import exact_quantiles
from fabriloom.operators import genealogy, quality, yields
from fabriloom.sources.bucketed import TooUneven, read_bucketed, write_bucketed
from fabriloom.sources.schemas import DDL
from tests.test_process_control import flags, t, values  # noqa: F401


@pytest.mark.parametrize("bins", [2, 512])
def test_quantiles(spark, bins):
    rng = random.Random(bins)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(300)], "ties": [float(rng.randint(0, 3)) for _ in range(200)], "one": [4.5], "two": [1.0, 2.0], "same": [0.1] * 50,
        "wide": [-1e308, 1e308, 0.0, 1e-300, 5.0], "near": [1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)] * 7, "skewed": [0.0] * 99 + [1e12], None: [3.0, 1.0],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("normal", None), ("normal", float("nan")), ("none", None)]
    rng.shuffle(rows)
    shares = [0.25, 0.5, 0.75, 0.0, 1.0, 0.1]
    got = {r[0]: r[1:] for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", shares, bins).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        own = sorted(xs)
        for share, q in zip(shares, got[k]):
            place = share * (len(own) - 1)
            low, high = own[int(place)], own[min(int(place) + 1, len(own) - 1)]
            assert q == (low if low == high else low + (place - int(place)) * (high - low)) or math.isclose(q, float(np.quantile(own, share)), rel_tol=1e-12)
    assert exact_quantiles(spark.createDataFrame([], "g string, x double"), "g", "x", shares).count() == 0


def test_yield_summary_values(t):  # noqa: F811
    got = yields.yield_summary(t)
    assert values(got["by_lot"], "lot_id", "wafer_count", "avg_yield_pct", "avg_defect_density") == [(1, 3, 90.0, 0.1333), (2, 1, 60.0, 0.4)]
    assert values(got["by_product"], "product", "wafer_count", "avg_yield_pct", "avg_defect_density") == [("AA100", 3, 90.0, 0.1333), ("BB200", 1, 60.0, 0.4)]
    assert values(got["by_node"], "technology_node", "avg_yield_pct", "avg_defect_density") == [("28nm", 90.0, 0.1333), ("65nm", 60.0, 0.4)]
    plan = yields.yield_rollup(t)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin\b", plan)) == 2  # records meet wafers, and sums meet lots, once
    assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in got.values())


def test_genealogy_pages(spark, t, flags):  # noqa: F811
    """A wafer with most of the measurements fills many pages, numbered without gaps, from many tasks."""
    more = spark.range(5000).selectExpr("id + 100 AS measurement_id", "2L AS wafer_id", "1 AS step_id", "'cd_nm' AS parameter", "CAST(id AS DOUBLE) AS value", "'nm' AS unit", "TIMESTAMP_NTZ'2025-10-02 00:00:00' AS timestamp")
    big = {**t, "measurements": t["measurements"].unionByName(more)}
    rows = genealogy.lot_genealogy(big, flags, page=40, salted=300).collect()
    hot = sorted((r["page"], r["measurements"], r["yields"]) for r in rows if r["wafer_id"] == 2)
    assert [p for p, _, _ in hot] == list(range(len(hot))) and all(0 < len(m) <= 40 for _, m, _ in hot)
    ids = [m["measurement_id"] for _, ms, _ in hot for m in ms]
    assert sorted(ids) == [2, *range(100, 5100)] and len(hot) < 5001 / 40 + 18
    assert [len(y) for _, _, y in hot] == [1] + [0] * (len(hot) - 1)
    salts = genealogy._spread(big["measurements"], big["measurements"], 300).where("wafer_id = 2").select("salt").distinct().count()
    assert salts == 17
    assert sorted((r["wafer_id"], r["page"], len(r["measurements"])) for r in rows if r["wafer_id"] != 2) == [(1, 0, 1), (3, 0, 1), (4, 0, 0)]


def test_lots_without_wafers(spark, t, flags):  # noqa: F811
    lone = {**t, "wafers": t["wafers"].where("lot_id = 1")}
    row = genealogy.lot_genealogy(lone, flags).where("lot_id = 2").collect()
    assert [(r["wafer_id"], r["page"], r["yields"], r["measurements"]) for r in row] == [(None, 0, [], [])]


def test_buckets_spare_exchanges(spark, t, flags):  # noqa: F811
    rng = random.Random(1)
    m = [(i, rng.randint(1, 4), 1, "p", 1.0, "u", None) for i in range(300)]
    plain = {**t, "measurements": spark.createDataFrame(m, DDL["measurements"])}
    write_bucketed(plain, "fab_test", 4)
    stored = read_bucketed(spark, "fab_test")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        none = flags.limit(0)
        builds = {"star": yields.star, "state": yields.lot_state, "orphans": quality.orphans, "counts": lambda x: genealogy.lot_genealogy_counts(x, none), "pages": lambda x: genealogy.lot_genealogy_pages(x, none)}
        shuffled = {}
        for name, build in builds.items():
            plan = build(stored)._jdf.queryExecution().executedPlan().toString()
            shuffled[name] = len(re.findall(r"Exchange hashpartitioning\(wafer_id#\d+L?, \d+\)", plan))
            assert sorted(map(str, build(stored).collect())) == sorted(map(str, build(plain).collect()))
        # genealogy's measurements meet flags and steps first, on other keys
        assert {k: v for k, v in shuffled.items() if k in ("star", "state", "orphans")} == {"star": 0, "state": 0, "orphans": 0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_uneven_wafers_are_refused(spark, t):  # noqa: F811
    hot = spark.range(9000).select(F.col("id").alias("measurement_id"), F.when(F.col("id") < 4000, F.lit(1)).otherwise(F.col("id")).cast("long").alias("wafer_id"), F.lit(1).alias("step_id"), F.lit("p").alias("parameter"), F.lit(1.0).alias("value"), F.lit("u").alias("unit"), F.lit(None).cast("timestamp_ntz").alias("timestamp"))
    with pytest.raises(TooUneven):
        write_bucketed({**t, "measurements": hot}, "fab_uneven", 16)
