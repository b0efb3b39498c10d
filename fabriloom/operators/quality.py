"""Data-quality checks; each returns its findings as rows. Tables that aren't given (such as the flags) are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabriloom.sources.schemas import PRIMARY_KEYS, RANGES, REFERENCES, WIDTHS
from fabriloom.sources.tables import Tables


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(tables: Tables) -> DataFrame:
    """(table_name, key, n) of primary keys that occur more than once."""
    return _union([tables[t].groupBy(F.col(k).cast("long").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(t).alias("table_name"), "key", "n") for t, k in PRIMARY_KEYS.items() if t in tables])


def null_counts(tables: Tables) -> DataFrame:
    """(table_name, column_name, nulls) of every column, in one pass over each table."""
    parts = []
    for t, df in tables.items():
        names = df.columns
        sums = df.agg(*(F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in names))
        parts.append(sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in names))).alias("x")).select(F.lit(t).alias("table_name"), "x.*"))
    return _union(parts)


def orphans(tables: Tables, rows_per_task: int | None = None) -> DataFrame:
    """(edge, key, n): child rows whose parent is missing. With rows_per_task, the keys of parents that have more rows are
    dealt out in as many parts as that asks for, whatever number Spark would choose; tables stored in buckets need none.
    Flags are not counted for it, as that would work them out twice: a measurement has a few at most."""
    parts = []
    for child, column, parent, key in REFERENCES:
        if child not in tables or parent not in tables:
            continue
        keys = tables[parent].select(F.col(key).alias("parent_key"))
        rows = tables[child].select(column).where(F.col(column).isNotNull())
        if rows_per_task and (many := tables[parent].count()) > rows_per_task:
            many = -(-max(many, 0 if child == "spc_flags" else tables[child].count()) // rows_per_task)
            # as one type, or else equal keys would be dealt to different parts
            rows, keys = (df.withColumn(c, F.col(c).cast("long")).repartition(many, c) for df, c in ((rows, column), (keys, "parent_key")))
        # rows of one key are counted before they are sorted for the join
        found = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        lost = found.join(keys, F.col(column) == F.col("parent_key"), "left_anti")
        parts.append(lost.select(F.lit(f"{child}.{column}").alias("edge"), F.col(column).cast("long").alias("key"), "n"))
    return _union(parts)


def long_strings(tables: Tables) -> DataFrame:
    """(table_name, column_name, too_long) of every text column with a declared width."""
    parts = []
    for t, widths in ((t, w) for t, w in WIDTHS.items() if t in tables):
        sums = tables[t].agg(*(F.coalesce(F.sum((F.length(c) > n).cast("long")), F.lit(0)).alias(c) for c, n in widths.items()))
        parts.append(sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("too_long")) for c in widths))).alias("x")).select(F.lit(t).alias("table_name"), "x.*"))
    return _union(parts)


def range_rules(tables: Tables) -> DataFrame:
    """(rule, violations) of the value ranges that the model promises; a null violates none of them."""
    parts = []
    for t, rules in RANGES.items():
        sums = tables[t].agg(*(F.coalesce(F.sum(F.coalesce(F.expr(broken).cast("long"), F.lit(0))), F.lit(0)).alias(rule) for rule, broken in rules.items()))
        parts.append(sums.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules))).alias("x")).select("x.*"))
    return _union(parts)
