"""Exact quantiles of groups of any size: no group's values ever meet in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins into which each pass cuts the interval around a wanted rank.
BINS = 512


def exact_quantiles(df: DataFrame, key: str, value: str, shares: list[float], bins: int = BINS) -> DataFrame:
    """(key, q0, q1, ...): the quantile of each share, between two values by linear interpolation. Nulls and NaN are left out;
    groups without values have no row.

    Each pass counts the values of a histogram around every wanted rank, with the least and greatest value of each bin, and goes
    on inside the bin that holds the rank, until the bin holds one value only (which may stand there many times). A pass is
    one aggregate with at most bins rows for each rank and group, combined before the shuffle; the ranks' intervals, two
    for each share and group, are what the driver keeps, so groups are to be few (values may be any number)."""
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    wanted = {}  # (group, rank) -> (rank inside the interval, least, greatest value of the interval)
    for r in ends:
        for share in shares:
            place = share * (r["n"] - 1)
            for rank in {int(place), min(int(place) + 1, r["n"] - 1)}:
                wanted[r["k"], rank] = (rank, r["lo"], r["hi"])
    while open_ranks := {w: x for w, x in wanted.items() if x[1] < x[2]}:
        ask = df.sparkSession.createDataFrame([(k, rank, float(lo), float(hi)) for (k, rank), (_, lo, hi) in open_ranks.items()], f"k {df.schema[key].dataType.simpleString()}, rank LONG, lo DOUBLE, hi DOUBLE")
        # halves first, so that the width of no interval overflows; rounding may only move a value to a neighbouring bin in order
        part = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins)
        place = F.when(F.col("v") >= F.col("hi"), F.lit(bins)).otherwise(F.least(part, F.lit(bins - 1))).cast("int")
        near = rows.join(F.broadcast(ask), rows["k"].eqNullSafe(ask["k"])).select(ask["k"].alias("g"), "rank", "lo", "hi", "v").where(F.col("v").between(F.col("lo"), F.col("hi")))
        counted = near.groupBy("g", "rank", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found = counted.groupBy("g", "rank").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "lo", "hi"))).alias("b"))
        for r in found.collect():
            left = wanted[r["g"], r["rank"]][0]
            for b in r["b"]:
                if left < b["n"]:
                    wanted[r["g"], r["rank"]] = (left, b["lo"], b["hi"])
                    break
                left -= b["n"]
    out = []
    for r in ends:
        got = []
        for share in shares:
            place = share * (r["n"] - 1)
            low, high = wanted[r["k"], int(place)][1], wanted[r["k"], min(int(place) + 1, r["n"] - 1)][1]
            got.append(low if low == high else low + (place - int(place)) * (high - low))
        out.append((r["k"], *got))
    columns = ", ".join(f"q{i} DOUBLE" for i in range(len(shares)))
    return df.sparkSession.createDataFrame(out, f"{key} {df.schema[key].dataType.simpleString()}, {columns}")
