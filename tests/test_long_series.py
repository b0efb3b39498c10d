"""Series cut into buckets: points of one instant, ids without order, user rules with a reach, numbering."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabriloom.operators import series, spc
from fabriloom.sources.schemas import DDL

START = dt.datetime(2025, 10, 1, 8)


@pytest.fixture(scope="module")
def tangled(spark):
    """One long series with many points of one instant and ids in no order, a short one, one that never varies, NaNs."""
    rng = random.Random(12)
    ids = list(range(6000))
    rng.shuffle(ids)
    rows = []
    for n, i in enumerate(ids):
        s = 1 if n < 5000 else 2 if n < 5900 else 3
        at = START + dt.timedelta(minutes=0 if rng.random() < 0.6 else rng.randrange(500))
        value = 7.0 if s == 3 else rng.choice([rng.gauss(0, 1), float(rng.randint(-2, 2)), n / 500])
        rows.append((i, 1, s, "p", float("nan") if n % 97 == 0 else value, "u", at))
    return spark.createDataFrame(rows, DDL["measurements"]).repartition(7).cache()


def flags(df):
    return sorted((r["measurement_id"], r["rule_violated"]) for r in df.collect())


@pytest.mark.parametrize("size", [1, 64, 1000])
def test_buckets_equal_whole_series(tangled, size, monkeypatch):
    want = flags(spc.check_series(tangled))
    assert want and flags(spc.check_long_series(tangled, size)) == want
    monkeypatch.setattr(spc, "SAMPLES", 1500)  # fewer sampled points, so larger buckets
    assert flags(spc.check_long_series(tangled, size)) == want


def test_points_of_one_instant_spread(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("id AS measurement_id", "1L AS wafer_id", "1 AS step_id", "'p' AS parameter", "CAST(hash(id) % 1000 AS DOUBLE) AS value", "'u' AS unit", "TIMESTAMP_NTZ'2025-10-01 00:00:00' AS timestamp")
    sizes = [r["n"] for r in spc.dealt(df, 50_000, n).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 15 and max(sizes) < 130_000 and n <= sum(sizes) < 1.4 * n


def test_two_scans(tangled):
    """One scan of the measurements for limits and cuts, one for the points; the count before reads no column."""
    plan = spc.check_long_series(tangled, 500, total=6000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 2


def test_user_rules_equal_whole_series(tangled):
    def run_of_four(values, mean, sd):
        hit = np.zeros(len(values), bool)
        for i in range(len(values) - 3):
            if (values[i : i + 4] > mean).all():
                hit[i : i + 4] = True
        return hit

    rules = {"run_of_four": (run_of_four, 3), "jump": (lambda v, m, s: np.r_[False, np.abs(np.diff(v)) > 2 * s], 1)}
    want = []
    frame = tangled.where("NOT isnan(value)").toPandas().sort_values(["step_id", "timestamp", "measurement_id"])
    for _, own in frame.groupby("step_id"):
        v = own["value"].to_numpy()
        if v.std(ddof=1) > 0:
            want += [(i, name) for name, (rule, _) in rules.items() for i in own.loc[rule(v, v.mean(), v.std(ddof=1)), "measurement_id"]]
    for size in (1, 200, 10**6):
        assert flags(spc.check_with(tangled, rules, size)) == sorted(want)
    biggest = spc.dealt(tangled, 200, 6000, 3).groupBy("step_id", "bucket").count().agg(F.max("count")).first()[0]
    assert biggest < 1000 and flags(spc.check_with(tangled, {})) == []


def test_ids_of_user_rules_differ(spark):
    named = spark.range(20_000).selectExpr("id AS measurement_id", "explode(array('a', 'b', 'rule1_3sigma', 'rule4_2of3_2sigma')) AS rule_violated")
    with_ids = spc.with_ids(named)
    assert with_ids.select("flag_id").distinct().count() == 80_000
    assert with_ids.where("(flag_id > 0) <> (rule_violated LIKE 'rule%')").count() == 0


def test_numbers_of_long_series(tangled):
    want = sorted((r["measurement_id"], r["sample"]) for r in spc.numbered(tangled).select("measurement_id", "sample").collect())
    got = sorted((r["measurement_id"], r["sample"]) for r in spc.numbered(tangled, 100).select("measurement_id", "sample").collect())
    assert got == want and len(got) == 6000
    none = tangled.limit(0).selectExpr("measurement_id", "step_id", "parameter")
    charts = [series.control_chart({"measurements": tangled.withColumn("value", F.nanvl("value", F.lit(0.0)))}, none, 1, "p", size).collect() for size in (100, 10**6)]
    assert charts[0] == charts[1] and [r["sample"] for r in charts[0]] == list(range(5000))


def test_cuts_stay_out_of_the_points_rows(tangled):
    """Sampled points are made distinct by hash, and explode gets numbers only, not its series' cuts."""
    plan = spc.dealt(tangled, 100, 6000)._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode" in line]
    assert exploded and not any("cuts" in line or "before" in line for line in exploded)
    assert "array_distinct" not in plan


def test_repeated_points_do_not_meet_in_the_cuts(tangled):
    """A point that is there 40 times is one sampled point, so the halo of its bucket is no shorter."""
    often = tangled.withColumn("again", F.explode(F.sequence(F.lit(1), F.when(F.pmod("measurement_id", F.lit(500)) == 0, 40).otherwise(1)))).drop("again")
    want = sorted(set(flags(spc.check_series(often))))
    assert want and sorted(set(flags(spc.check_long_series(often, 64)))) == want


def test_buckets_of_one_series_are_in_many_tasks(spark):
    """Also where the join has dealt the points by series."""
    n, before = 1_000_000, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df = spark.range(n).selectExpr("id AS measurement_id", "1L AS wafer_id", "1 AS step_id", "'p' AS parameter", "CAST(hash(id) % 1000 AS DOUBLE) AS value", "'u' AS unit", "TIMESTAMP_NTZ'2025-10-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS timestamp")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spc.marked(spc.dealt(df, 2000, n), [*spc.SERIES, "bucket"])
        sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(sizes) >= 8 and max(sizes) < 250_000
