"""Statistical process control: four run rules over every (step, parameter) series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabriloom.operators.process import SERIES, limits
from fabriloom.sources.tables import Tables

#: Rows on either side of a point that can decide whether it is flagged.
REACH = 7
#: Points of a series that one task takes; sampled points of all series together, at most about (a hash decides).
ROWS, SAMPLES = 1_000_000, 2_000_000
#: Points that a task gets when buckets are dealt out.
SHARE = 100_000


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("timestamp", "measurement_id")


def _any_window(hit: Column, size: int, keys: list[str]) -> Column:
    """Whether the row is in a window of `size` rows whose last row has `hit`."""
    return F.max(hit.cast("int")).over(_order(keys).rowsBetween(0, size - 1)) == 1


def beyond_3_sigma(keys: list[str]) -> Column:
    return F.abs(F.col("value") - F.col("mean")) > 3 * F.col("sd")


def eight_on_one_side(keys: list[str]) -> Column:
    back = _order(keys).rowsBetween(-7, 0)
    above = F.sum((F.col("value") > F.col("mean")).cast("int")).over(back) == 8
    below = F.sum((F.col("value") < F.col("mean")).cast("int")).over(back) == 8
    return above | below


def six_in_a_trend(keys: list[str]) -> Column:
    back = _order(keys).rowsBetween(-4, 0)
    return (F.sum(F.coalesce((F.col("step") > 0).cast("int"), F.lit(0))).over(back) == 5) | (F.sum(F.coalesce((F.col("step") < 0).cast("int"), F.lit(0))).over(back) == 5)


def two_of_three_beyond_2_sigma(keys: list[str]) -> Column:
    back = _order(keys).rowsBetween(-2, 0)
    high = F.sum((F.col("value") > F.col("mean") + 2 * F.col("sd")).cast("int")).over(back) >= 2
    low = F.sum((F.col("value") < F.col("mean") - 2 * F.col("sd")).cast("int")).over(back) >= 2
    return (F.count(F.lit(1)).over(back) == 3) & (high | low)


#: rule -> (condition on a window's last row, window size)
RULES: dict[str, tuple[Callable[[list[str]], Column], int]] = {
    "rule1_3sigma": (beyond_3_sigma, 1),
    "rule2_8consec": (eight_on_one_side, 8),
    "rule3_6trend": (six_in_a_trend, 6),
    "rule4_2of3_2sigma": (two_of_three_beyond_2_sigma, 3),
}


def marked(points: DataFrame, keys: list[str] = SERIES, rules: dict | None = None) -> DataFrame:
    """points (with mean and sd) and a boolean column for each rule. All windows share one shuffle and sort."""
    rules = RULES if rules is None else rules
    df = points.withColumn("step", F.col("value") - F.lag("value").over(_order(keys)))
    df = df.withColumns({f"{name}_end": build(keys) for name, (build, _) in rules.items()})
    return df.withColumns({name: F.coalesce(_any_window(F.col(f"{name}_end"), size, keys) if size > 1 else F.col(f"{name}_end"), F.lit(False)) for name, (_, size) in rules.items()}).drop("step", *(f"{n}_end" for n in rules))


def as_rows(df: DataFrame, rules: list[str]) -> DataFrame:
    names = F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in rules)))
    return df.withColumn("rule_violated", F.explode(names)).drop(*rules)


def check_series(measurements: DataFrame, rules: dict | None = None) -> DataFrame:
    """One row for each point and rule that it violates. Limits come first, from an aggregate of one row for each
    series; series that never vary have none and no flags."""
    rules = RULES if rules is None else rules
    own = limits(measurements).where("sd > 0")
    points = measurements.where(~F.isnan("value")).select("measurement_id", *SERIES, "value", "timestamp").join(own, SERIES)
    return as_rows(marked(points, SERIES, rules), list(rules)).select("measurement_id", *SERIES, "rule_violated")


def _sampling(rows_per_bucket: int, total: int, reach: int) -> tuple[int, int]:
    """Sampled points that a bucket has at least, and of how many points one is sampled."""
    spare = 8 * (reach + 1)
    return spare, max(1, rows_per_bucket // spare, -(-total // SAMPLES))


def splitters(measurements: DataFrame, rows_per_bucket: int, total: int, reach: int = REACH) -> DataFrame:
    """(step_id, parameter, mean, sd, cuts, before, after) of every series, in one aggregate. A sample by a hash of
    measurement_id (about SAMPLES points of all series at most) is sorted by (timestamp, measurement_id); every so many of
    it, one begins a bucket. Sampled points are points of the series, so each bucket has at least that many, and at least
    `reach` lie between the sampled points before[i] and after[i] and the cut between them: a bucket's neighbours never
    reach further."""
    spare, rate = _sampling(rows_per_bucket, total, reach)
    at = F.struct("timestamp", "measurement_id")
    # a set: array_distinct compares each struct with every other one
    sample = F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("measurement_id"), F.lit(rate)) == 0, at)))
    series = measurements.where(~F.isnan("value")).groupBy(*SERIES).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), sample.alias("s"))
    # a last bucket with fewer sampled points than spare joins the one before it
    starts = F.when(F.size("s") >= 2 * spare, F.sequence(F.lit(spare), F.size("s") - spare, F.lit(spare))).otherwise(F.array().cast("array<int>"))
    take = lambda off: F.transform(starts, lambda i: F.col("s")[i + off])
    return series.select(*SERIES, "mean", "sd", take(0).alias("cuts"), take(-reach - 1).alias("before"), take(reach).alias("after"))


def in_buckets(points: DataFrame, series: DataFrame, rows_per_bucket: int, total: int, reach: int = REACH) -> DataFrame:
    """points joined with their series' row of splitters(), and each point's bucket: how many cuts are not above it, by halving.
    The steps suffice for a series of all points, every one of them sampled if need be."""
    spare, rate = _sampling(rows_per_bucket, total, reach)
    most = total // spare if rate == 1 else 2 * total // (rate * spare) + 64
    df = points.join(series, SERIES).withColumn("bucket", F.lit(0))
    for k in reversed(range(most.bit_length())):
        df = df.withColumn("bucket", F.when(F.get("cuts", F.col("bucket") + ((1 << k) - 1)) <= F.struct("timestamp", "measurement_id"), F.col("bucket") + (1 << k)).otherwise(F.col("bucket")))
    return df


def dealt(measurements: DataFrame, rows_per_bucket: int, total: int, reach: int = REACH) -> DataFrame:
    """The points of all series that vary, with mean and sd, dealt into buckets of consecutive points; home says to which bucket
    a point belongs, and those near a cut are also in the bucket on its other side. One scan makes the limits and
    cuts, one deals the points."""
    points = measurements.where(~F.isnan("value")).select("measurement_id", *SERIES, "value", "timestamp")
    home = in_buckets(points, splitters(measurements, rows_per_bucket, total, reach).where("sd > 0"), rows_per_bucket, total, reach)
    at = F.struct("timestamp", "measurement_id")
    near_next = (F.col("bucket") < F.size("cuts")) & (F.get("before", F.col("bucket")) <= at)
    near_last = (F.col("bucket") > 0) & (F.get("after", F.col("bucket") - 1) >= at)
    # only numbers go on to explode: a row that carries its series' cuts would copy them, tens of kilobytes, for every point
    own = home.select("measurement_id", *SERIES, "value", "timestamp", "mean", "sd", "bucket", F.when(near_last, F.col("bucket") - 1).alias("last"), F.when(near_next, F.col("bucket") + 1).alias("next"))
    places = F.explode(F.array("bucket", "last", "next")).alias("place")
    rows = own.select("measurement_id", *SERIES, "value", "timestamp", "mean", "sd", "bucket", places).where("place is not null")
    rows = rows.select("measurement_id", *SERIES, "value", "timestamp", "mean", "sd", F.col("place").alias("bucket"), (F.col("place") == F.col("bucket")).alias("home"))
    # the join may have dealt the points by series, which would do for what groups by bucket, but puts a series in one task
    return rows.repartition(-(-total // SHARE) or 1, *SERIES, "bucket")


def numbered(measurements: DataFrame, rows_per_bucket: int = ROWS) -> DataFrame:
    """measurements with sample, each point's place in its series from 0. Long series are numbered bucket by bucket, after
    the counts of the buckets before."""
    total, order = measurements.count(), ["timestamp", "measurement_id"]
    if total <= rows_per_bucket:
        return measurements.withColumn("sample", (F.row_number().over(_order(SERIES)) - 1).cast("long"))
    home = in_buckets(measurements, splitters(measurements, rows_per_bucket, total).select(*SERIES, "cuts"), rows_per_bucket, total).drop("cuts")
    sizes = home.groupBy(*SERIES, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(*SERIES, "bucket", (F.sum("n").over(Window.partitionBy(*SERIES).orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy(*SERIES, "bucket").orderBy(*order)) - 1
    return home.withColumn("place", place).join(before, [*SERIES, "bucket"]).withColumn("sample", F.col("before") + F.col("place")).drop("bucket", "before", "place")


def check_long_series(measurements: DataFrame, rows_per_bucket: int = ROWS, rules: dict | None = None, total: int | None = None) -> DataFrame:
    """check_series() for series too long for one task: each is cut into buckets of about rows_per_bucket points (see splitters(),
    which cuts between points of one instant too), and a bucket also gets the points around it that can decide."""
    rules = RULES if rules is None else rules
    rows = dealt(measurements, rows_per_bucket, measurements.count() if total is None else total)
    return as_rows(marked(rows, [*SERIES, "bucket"], rules).where("home"), list(rules)).select("measurement_id", *SERIES, "rule_violated")


def check_all(measurements: DataFrame, rules: dict | None = None, rows_per_bucket: int = ROWS) -> DataFrame:
    """check_series(), or check_long_series() if there are more points than a bucket takes. That count reads no column, and of
    Parquet only the footers."""
    total = measurements.count()
    return check_series(measurements, rules) if total <= rows_per_bucket else check_long_series(measurements, rows_per_bucket, rules, total)


#: A user rule: f(values, mean, sd) gives a boolean array, and no value further away than reach decides on a point.
UserRule = tuple[Callable, int]


def check_with(measurements: DataFrame, rules: dict[str, UserRule], rows_per_bucket: int = ROWS) -> DataFrame:
    """User rules in Python over every series: name -> (f, reach). Series are cut as in check_long_series(), with as many
    points around a bucket as the rule that reaches furthest asks for, and f sees a bucket's values in order with the
    mean and standard deviation of the whole series. So no task holds a long series, and a rule that keeps to its reach
    gives what it gives on the whole series."""
    reach = max((r for _, r in rules.values()), default=0)
    rows = dealt(measurements, max(rows_per_bucket, 8 * (reach + 1)), measurements.count(), reach)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("timestamp", "ascending"), ("measurement_id", "ascending")])
        values, home = table.column("value").to_numpy(), table.column("home").to_numpy()
        mean, sd = table.column("mean")[0].as_py(), table.column("sd")[0].as_py()
        hits = []
        for name, (rule, _) in rules.items():
            hit = table.filter(pa.array(np.asarray(rule(values, mean, sd), bool) & home)).select(["measurement_id", *SERIES])
            hits.append(hit.append_column("rule_violated", pa.array([name] * hit.num_rows, pa.string())))
        return pa.concat_tables(hits)

    return rows.groupBy(*SERIES, "bucket").applyInArrow(run, "measurement_id long, step_id int, parameter string, rule_violated string") if rules else check_series(measurements.limit(0))


def with_ids(flags: DataFrame) -> DataFrame:
    """flags with flag_id, the same in every run: the measurement and the number of a built-in rule make a positive one, a hash
    of measurement and name a negative one for user rules (63 bits; should two ever meet, the store refuses them)."""
    number = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule_violated"))
    other = -1 - F.shiftrightunsigned(F.xxhash64("measurement_id", "rule_violated"), 1)
    return flags.withColumn("flag_id", F.when(number > 0, F.col("measurement_id") * 10 + number).otherwise(other))


def run_spc(measurements: DataFrame, flagged_at=None, rules: dict[str, UserRule] | None = None) -> DataFrame:
    """All flags of the built-in rules and of user rules, with one time of flagging."""
    found = check_all(measurements)
    if rules:
        found = found.unionByName(check_with(measurements, rules))
    at = F.current_timestamp().cast("timestamp_ntz") if flagged_at is None else F.lit(flagged_at).cast("timestamp_ntz")
    return with_ids(found).withColumn("flagged_at", at).select("flag_id", "measurement_id", *SERIES, "rule_violated", "flagged_at")


def spc_flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("rule_violated").agg(F.count(F.lit(1)).alias("flag_count")).orderBy(F.desc("flag_count"), "rule_violated")


def spc_flags_detail(t: Tables, flags: DataFrame) -> DataFrame:
    """Flags with measurement, step, wafer and lot, newest first. Only flagged measurements go on to the wafers."""
    m = t["measurements"].select("measurement_id", "wafer_id", "value", F.col("timestamp").alias("measured_at"))
    rows = flags.join(m, "measurement_id").join(t["process_steps"].select("step_id", "step_name", "tool_id"), "step_id")
    rows = rows.join(t["wafers"].select("wafer_id", "lot_id", "wafer_number"), "wafer_id").join(t["lots"].select("lot_id", "product"), "lot_id")
    order = [F.desc("flagged_at")] if "flagged_at" in flags.columns else []
    return rows.select("measurement_id", "rule_violated", *(["flagged_at"] if order else []), "step_id", "step_name", "tool_id", "parameter", "value", "measured_at", "wafer_id", "wafer_number", "lot_id", "product").orderBy(*order, "measurement_id", "rule_violated")


def flag_history(t: Tables, flags: DataFrame, step_id: int) -> DataFrame:
    one = spc_flags_detail(t, flags.where(F.col("step_id") == F.lit(step_id)))
    return one.select("measurement_id", "rule_violated", "parameter", "value", "measured_at", "wafer_number", "lot_id", "product")


def flagged_steps(t: Tables, flags: DataFrame) -> DataFrame:
    steps = flags.select("step_id").distinct().join(t["process_steps"], "step_id")
    return steps.select("step_id", F.format_string("%s (%s)", "step_name", "tool_id").alias("label")).distinct().orderBy("label", "step_id")


def flagged_parameters(flags: DataFrame, step_id: int) -> DataFrame:
    return flags.where(F.col("step_id") == F.lit(step_id)).select("parameter").distinct().orderBy("parameter")


def flagged_point_counts(flags: DataFrame) -> DataFrame:
    """Points with any flag in each series; a point under two rules counts once."""
    return flags.select(*SERIES, "measurement_id").distinct().groupBy(*SERIES).agg(F.count(F.lit(1)).alias("points"))
