"""The versioned store: what the gate refuses, and what readers see when something fails midway."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from fabriloom.sources import gate
from fabriloom.sources import tables as sources
from fabriloom.sources.schemas import DDL, FLAGS_DDL

START = dt.datetime(2025, 10, 1, 8)
ROWS = {
    "lots": [(1, "P1", "28nm", dt.date(2025, 10, 1), "complete"), (2, "P2", "65nm", dt.date(2025, 11, 1), "active")],
    "wafers": [(1, 1, 1, "complete"), (2, 2, 1, "active")],
    "process_steps": [(1, "etch", "E-1", "M1", 1)],
    "measurements": [(i, 1 + i % 2, 1, "cd", 100.0 + i, "nm", START + dt.timedelta(minutes=i)) for i in range(10)],
    "yield_records": [(1, 1, 250, 200, 80.0, 0.2)],
}


def extracts(spark, folder, **changed):
    for table, rows in {**ROWS, **changed}.items():
        sources.write_csv(spark.createDataFrame(rows, DDL[table]).coalesce(1), f"{folder}/{table}.csv")
    return str(folder)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    sources.load_all(spark, extracts(spark, folder / "csv"), f"{folder}/db")
    return f"{folder}/db"


@pytest.fixture()
def db(loaded, tmp_path):
    return shutil.copytree(loaded, f"{tmp_path}/db")


def state(spark, db):
    return sources.manifest(spark, db), {t: sorted(map(str, sources.read_table(spark, db, t).collect())) for t in sources.ALL}


def point(key, wafer=1, step=1, parameter="cd", value=1.0, unit="nm", at=START):
    return (key, wafer, step, parameter, value, unit, at)


@pytest.mark.parametrize(
    ("rows", "found"),
    [
        ([point(3)], ("measurements", "stored", "measurement_id", 1)),
        ([point(50), point(50, wafer=2)], ("measurements", "repeated", "measurement_id", 1)),
        ([point(None)], ("measurements", "null", "measurement_id", 1)),
        ([point(51, at=None)], ("measurements", "null", "timestamp", 1)),
        ([point(52, wafer=9), point(53, wafer=9), point(54, wafer=8)], ("measurements", "orphan", "wafer_id", 2)),
        ([point(55, step=7)], ("measurements", "orphan", "step_id", 1)),
        ([point(56, unit="u" * 17)], ("measurements", "width", "unit", 1)),
    ],
)
def test_refused_appends_change_nothing(spark, db, rows, found):
    before = state(spark, db)
    with pytest.raises(gate.Refused) as refused:
        sources.append(spark.createDataFrame(rows + [point(60)], DDL["measurements"]), db, "measurements")
    assert refused.value.findings == [found]
    assert state(spark, db) == before
    files, path = sources._files(spark, f"{db}/measurements/change=*")
    assert len(files.globStatus(path)) == 1  # what was written for it is gone


def test_ranges_are_reported_only(spark, db):
    low = spark.createDataFrame([(2, 2, 250, 10, 4.0, 0.2)], DDL["yield_records"])
    assert sources.append(low, db, "yield_records") == 1
    found = gate.gate({"yield_records": low}, {t: sources.read_table(spark, db, t) for t in ("wafers",)}).where("violations > 0").collect()
    assert [tuple(r) for r in found] == [("yield_records", "range", "yield_in_70_98", 1)]


def test_counts_come_from_the_write(spark, db):
    assert sources.stored_counts(spark, db) == {**{t: len(r) for t, r in ROWS.items()}, "spc_flags": 0}
    sources.append(spark.createDataFrame([point(70), point(71)], DDL["measurements"]), db, "measurements")
    assert sources.stored_counts(spark, db)["measurements"] == sources.read_table(spark, db, "measurements").count() == 12


def test_append_leaves_stored_files_alone(spark, db):
    names = lambda: {f for f in sources.read_table(spark, db, "measurements").inputFiles()}
    before = names()
    sources.append(spark.createDataFrame([point(70)], DDL["measurements"]), db, "measurements")
    assert before < names()


def test_load_without_clearing(spark, db, tmp_path):
    sources.recompute_flags(spark, db)
    more = {"lots": [(3, "P3", "28nm", dt.date(2025, 12, 1), "active")], "wafers": [(3, 3, 1, "active")], "process_steps": [(2, "cmp", "C-1", "M2", 2)], "measurements": [point(100, wafer=3, step=2), point(101, wafer=1)], "yield_records": [(3, 3, 250, 1, 70.0, 0.1)]}
    before = state(spark, db)
    with pytest.raises(gate.Refused):
        sources.load_all(spark, extracts(spark, tmp_path / "same"), db, clear=False)
    assert state(spark, db) == before
    loaded = sources.load_all(spark, extracts(spark, tmp_path / "more", **more), db, clear=False)
    assert dict(map(tuple, loaded.collect())) == {t: len(r) for t, r in more.items()}
    assert sources.stored_counts(spark, db)["measurements"] == 12 and sources.read_table(spark, db, "measurements").where("measurement_id >= 100").count() == 2


@pytest.mark.parametrize("bad", [{"wafers": [(1, 1, 1, "complete"), (1, 2, 1, "active")]}, {"wafers": [(1, 77, 1, "complete"), (2, 2, 1, "active")]}, {"lots": [(1, "P1", "28nm", None, "complete"), (2, "P2", "65nm", dt.date(2025, 11, 1), "active")]}])
def test_refused_loads_change_nothing(spark, db, tmp_path, bad):
    before = state(spark, db)
    with pytest.raises(gate.Refused):
        sources.load_all(spark, extracts(spark, tmp_path / "bad", **bad), db)
    assert state(spark, db) == before


def series(spark, db):
    rows = [point(1000 + i, value=105.0 if i < 9 else 95.0, parameter="p", at=START + dt.timedelta(minutes=i)) for i in range(10)]
    sources.append(spark.createDataFrame(rows, DDL["measurements"]), db, "measurements")


def test_failures_midway(spark, db, monkeypatch):
    series(spark, db)
    assert sources.recompute_flags(spark, db) == sources.recompute_flags(spark, db) > 0
    before = state(spark, db)

    def fails(*_):
        raise OSError("the disk is full")

    for name in ("commit", "write_table"):
        with monkeypatch.context() as m:
            m.setattr(sources, name, fails)
            for change in (lambda: sources.recompute_flags(spark, db), lambda: sources.append(spark.createDataFrame([point(80)], DDL["measurements"]), db, "measurements")):
                with pytest.raises(OSError):
                    change()
                assert state(spark, db) == before
    # a task that fails while flags are written
    with pytest.raises(Exception):
        sources.recompute_flags(spark, db, rules={"broken": (lambda v, m, s: 1 / 0, 1)})
    assert state(spark, db) == before


def test_old_flags_are_seen_until_the_commit(spark, db, monkeypatch):
    series(spark, db)
    sources.recompute_flags(spark, db, dt.datetime(2025, 1, 1))
    seen, real = [], sources.commit

    def watched(*args):
        seen.append({r["flagged_at"] for r in sources.read_table(spark, db, "spc_flags").collect()})
        return real(*args)

    monkeypatch.setattr(sources, "commit", watched)
    sources.recompute_flags(spark, db, dt.datetime(2026, 1, 1))
    assert seen == [{dt.datetime(2025, 1, 1)}]
    assert {r["flagged_at"] for r in sources.read_table(spark, db, "spc_flags").collect()} == {dt.datetime(2026, 1, 1)}
    last = sources.versions(spark, db)[-1]
    assert {r["flagged_at"] for r in sources.read_table(spark, db, "spc_flags", last - 1).collect()} == {dt.datetime(2025, 1, 1)}


def test_one_of_two_writers_wins(spark, db, monkeypatch):
    real = sources.write_table

    def slow(df, path, table):
        out = real(df, path, table)
        monkeypatch.setattr(sources, "write_table", real)
        sources.append(spark.createDataFrame([point(90)], DDL["measurements"]), db, "measurements")  # another writer, meanwhile
        return out

    monkeypatch.setattr(sources, "write_table", slow)
    with pytest.raises(sources.Conflict):
        sources.append(spark.createDataFrame([point(91)], DDL["measurements"]), db, "measurements")
    assert [r["measurement_id"] for r in sources.read_table(spark, db, "measurements").where("measurement_id >= 90").collect()] == [90]


def test_vacuum(spark, db):
    sources.append(spark.createDataFrame([point(70)], DDL["measurements"]), db, "measurements")
    sources.recompute_flags(spark, db)
    sources.recompute_flags(spark, db)
    before = state(spark, db)
    sources.vacuum(spark, db)
    assert state(spark, db) == before and len(sources.versions(spark, db)) == 1
    assert sources.manifest(spark, f"{db}/nothing") == {"version": 0, "tables": {}}


def test_user_rules_reach_the_store(spark, db):
    series(spark, db)
    rules = {"above": (lambda v, m, s: v > m + 0.1 * s, 0), "below": (lambda v, m, s: v < m, 0)}
    n = sources.recompute_flags(spark, db, rules=rules)
    stored = sources.read_table(spark, db, "spc_flags")
    assert n == stored.count() == stored.select("flag_id").distinct().count()
    kinds = {(r["rule_violated"], r["flag_id"] < 0) for r in stored.collect()}
    assert {("above", True), ("below", True), ("rule2_8consec", False)} <= kinds
    ids = sorted(r["flag_id"] for r in stored.collect())
    sources.recompute_flags(spark, db, rules=rules)
    assert sorted(r["flag_id"] for r in sources.read_table(spark, db, "spc_flags").collect()) == ids
    # flags are held to their schema too
    with pytest.raises(gate.Refused):
        sources.append(spark.createDataFrame([(1, 4242, 1, "cd", "x", START)], FLAGS_DDL), db, "spc_flags")
    assert sources.append(stored.where("flag_id > 0").limit(1).withColumn("flag_id", F.lit(5).cast("long")), db, "spc_flags") == 1
