"""What rows must satisfy before they become part of the stored tables: no nulls, no text beyond its width, keys that nothing
else has, references that something has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabriloom.sources.schemas import COLUMNS, PRIMARY_KEYS, RANGES, REFERENCES, WIDTHS

Finding = tuple[str, str, str, int]
#: Findings of these checks don't stop a load: the model promises the ranges, but the schema doesn't enforce them.
REPORTED = {"range"}


class Refused(ValueError):
    """Rows that break a constraint; findings has (table, check, column or rule, violations) of each."""

    def __init__(self, findings: list[Finding]):
        super().__init__("; ".join(f"{t}.{c}: {n} ({check})" for t, check, c, n in findings))
        self.findings = findings


def column_checks(table: str) -> list[tuple[str, str, Column]]:
    """(check, column or rule, whether a row violates it) that a row's own values decide."""
    nulls = [("null", c, F.col(c).isNull()) for c in COLUMNS[table]]
    widths = [("width", c, F.length(c) > n) for c, n in WIDTHS.get(table, {}).items()]
    return nulls + widths + [("range", rule, F.expr(broken)) for rule, broken in RANGES.get(table, {}).items()]


def metrics(table: str) -> list[Column]:
    """Rows, and the violations of each column check, as aggregates: for observe() during a write, or for agg()."""
    sums = (F.coalesce(F.sum(F.coalesce(broken.cast("long"), F.lit(0))), F.lit(0)).alias(f"{check}:{name}") for check, name, broken in column_checks(table))
    return [F.count(F.lit(1)).alias("rows"), *sums]


def column_findings(table: str, measured: dict[str, int]) -> list[Finding]:
    return [(table, check, name, measured[f"{check}:{name}"]) for check, name, _ in column_checks(table) if measured[f"{check}:{name}"]]


def _found(rows: DataFrame, table: str, check: str, column: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("table_name"), F.lit(check).alias("check"), F.lit(column).alias("column_name"), "violations")


def key_findings(incoming: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """(table_name, check, column_name, violations), a row for each constraint between rows: keys that stand more than once in
    incoming (repeated), that stored has already (stored), and references to keys that neither has (orphan). Keys are
    counted, not rows, and nulls are left to the null check. Incoming keys meet stored ones in semi and anti joins, so an
    append of few rows is broadcast by Spark and the stored keys aren't shuffled."""
    parts = []
    for table, df in incoming.items():
        key = PRIMARY_KEYS[table]
        own = df.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(_found(own.where("n > 1"), table, "repeated", key))
        if table in stored:
            known = stored[table].select(key).join(own.select(key), key, "left_semi").distinct()
            parts.append(_found(known, table, "stored", key))
    for child, column, parent, key in REFERENCES:
        if child not in incoming:
            continue
        asked = incoming[child].select(F.col(column).alias("asked")).where(F.col(column).isNotNull()).distinct()
        for side in (incoming, stored):
            if parent in side:
                asked = asked.join(side[parent].select(F.col(key).alias("asked")), "asked", "left_anti")
        parts.append(_found(asked, child, "orphan", column))
    return reduce(DataFrame.unionByName, parts)


def gate(incoming: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """All checks of incoming rows against themselves and the stored tables, as key_findings() with a row for each check."""
    parts = [key_findings(incoming, stored)]
    for table, df in incoming.items():
        found = df.agg(*metrics(table)[1:])
        named = F.array(*(F.struct(F.lit(check).alias("check"), F.lit(name).alias("column_name"), F.col(f"`{check}:{name}`").alias("violations")) for check, name, _ in column_checks(table)))
        parts.append(found.select(F.lit(table).alias("table_name"), F.explode(named).alias("x")).select("table_name", "x.*"))
    return reduce(DataFrame.unionByName, parts)


def require(findings: list[Finding]) -> None:
    """Raises Refused if any finding is more than a report."""
    if broken := [f for f in findings if f[1] not in REPORTED and f[3]]:
        raise Refused(broken)
