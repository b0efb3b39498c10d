"""CSV extracts in, versioned Parquet tables out.

A store is a folder of data folders and manifests. A manifest is one small file that names, for each table, the
folders that make it up and their rows; the one with the highest number holds. Every change writes new folders, checks
what it wrote, and commits by renaming a manifest into place under the next number, which fails if another writer was first.
So a reader sees the tables before or after a change and nothing between, whatever fails midway, and an append touches no
file of the rows that were there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fabriloom.sources import gate
from fabriloom.sources.schemas import COLUMNS, DDL, FLAGS_DDL

Tables = dict[str, DataFrame]
ALL = {**DDL, "spc_flags": FLAGS_DDL}


class Conflict(RuntimeError):
    """Another writer committed first; nothing was changed."""


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One extract with its fixed schema; a value that doesn't fit stops the job."""
    reader = spark.read.schema(DDL[table]).option("header", True).option("mode", "FAILFAST")
    return reader.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("dateFormat", "yyyy-MM-dd").csv(path)


def read_extracts(spark: SparkSession, directory: str) -> Tables:
    return {table: read_csv(spark, f"{directory}/{table}.csv", table) for table in DDL}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_table(df: DataFrame, path: str, table: str) -> dict[str, int]:
    """Writes a table's rows to a new folder and returns gate.metrics() of them, which the write itself gathers (in its last
    stage, where a row counts once even if tasks run again). Measurements and flags are partitioned by step and sorted by
    series inside the files; a long series is split over tasks by day (flags: by measurement), so that none writes it alone.
    The other tables are plain."""
    seen = Observation()
    if table in ("measurements", "spc_flags"):
        part, order = (F.to_date("timestamp"), ["parameter", "timestamp"]) if table == "measurements" else (F.pmod("measurement_id", F.lit(64)), ["parameter"])
        rows = df.repartition("step_id", "parameter", part).sortWithinPartitions("step_id", *order)
        rows.observe(seen, *gate.metrics(table)).write.partitionBy("step_id").parquet(path)
    else:
        df.observe(seen, *gate.metrics(table)).write.parquet(path)
    return seen.get


def _files(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers of all committed manifests."""
    files, pattern = _files(spark, f"{target}/manifest-*.json")
    return sorted(int(x.getPath().getName()[9:-5]) for x in files.globStatus(pattern) or ())


def _read_text(spark: SparkSession, path: str) -> str:
    files, jvm_path = _files(spark, path)
    stream = files.open(jvm_path)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def manifest(spark: SparkSession, target: str, version: int | None = None) -> dict:
    """{"version": n, "tables": {table: [{"folder": f, "rows": n}]}}: the newest state, or an older one that is still there; version
    0 without tables if nothing was committed yet."""
    known = versions(spark, target)
    if version is None and not known:
        return {"version": 0, "tables": {}}
    return json.loads(_read_text(spark, f"{target}/manifest-{known[-1] if version is None else version:020d}.json"))


def commit(spark: SparkSession, target: str, base: dict, tables: dict) -> int:
    """Makes tables the newest state, if base still is the newest."""
    jvm = spark.sparkContext._jvm
    version = base["version"] + 1
    files, draft = _files(spark, f"{target}/draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
    out.close()
    final = _files(spark, f"{target}/manifest-{version:020d}.json")[1]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as failed:
        files.delete(draft, False)
        if files.exists(final):
            raise Conflict(f"version {version} of {target} was committed by another writer") from failed
        raise
    return version


def _folders(spark: SparkSession, target: str, table: str, entries: list[dict]) -> DataFrame:
    paths = [f"{target}/{e['folder']}" for e in entries if e["rows"]]
    if not paths:
        return spark.createDataFrame([], ALL[table])
    return spark.read.schema(ALL[table]).option("basePath", f"{target}/{table}").parquet(*paths).select(*COLUMNS[table])


def read_table(spark: SparkSession, target: str, table: str, version: int | None = None) -> DataFrame:
    """A table as the newest manifest has it, or an older one."""
    return _folders(spark, target, table, manifest(spark, target, version)["tables"].get(table, []))


def stored_counts(spark: SparkSession, target: str) -> dict[str, int]:
    """Rows of each table, from the manifest alone."""
    return {t: sum(e["rows"] for e in entries) for t, entries in manifest(spark, target)["tables"].items()}


def counts(tables: Tables) -> DataFrame:
    """(table_name, rows) of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()))


def change(spark: SparkSession, target: str, rows: Tables, replaced: tuple[str, ...] = ()) -> dict[str, int]:
    """Adds rows to their tables, of which the replaced ones lose what they had, all in one commit; returns how many rows came
    in. Counts, nulls, widths and ranges come from the writes themselves; keys and references are then checked over the
    written key columns and what stays of the stored tables (nothing that stays may refer to a replaced table). If anything is refused or fails, the new folders go, and
    the tables are as they were."""
    base = manifest(spark, target)
    kept = {t: e for t, e in base["tables"].items() if t not in replaced}
    _files(spark, target)[0].mkdirs(_files(spark, target)[1])
    own, added, findings = f"change={uuid.uuid4().hex}", {}, []
    try:
        for table, df in rows.items():
            measured = write_table(df, f"{target}/{table}/{own}", table)
            findings += gate.column_findings(table, measured)
            added[table] = {"folder": f"{table}/{own}", "rows": measured["rows"]}
        gate.require(findings)
        new = {t: _folders(spark, target, t, [e]) for t, e in added.items()}
        old = {t: _folders(spark, target, t, e) for t, e in kept.items()}
        gate.require([tuple(r) for r in gate.key_findings(new, old).where("violations > 0").collect()])
        commit(spark, target, base, {t: [*kept.get(t, []), *([added[t]] if t in added else [])] for t in ALL})
    except Exception:
        for table in rows:
            files, folder = _files(spark, f"{target}/{table}/{own}")
            files.delete(folder, True)
        raise
    return {t: e["rows"] for t, e in added.items()}


def append(df: DataFrame, target: str, table: str) -> int:
    """More rows for a table. Refused, with the tables left as they were, if a key is repeated or stored already, a
    reference leads nowhere, or a value is null or too long."""
    return change(df.sparkSession, target, {table: df.select(*COLUMNS[table])})[table]


def load_all(spark: SparkSession, source: str, target: str, clear: bool = True) -> DataFrame:
    """Loads all extracts in one commit and returns (table_name, rows) of what was loaded. With clear they replace all tables,
    and the flags derived from the old ones go; without it they are added to what is there. The state before stays
    readable as a version; older ones go."""
    loaded = change(spark, target, read_extracts(spark, source), tuple(ALL) if clear else ())
    vacuum(spark, target, 2)
    return spark.createDataFrame(list(loaded.items()), "table_name STRING, rows LONG")


def vacuum(spark: SparkSession, target: str, keep: int = 1) -> None:
    """Deletes all but the newest states and the data folders of older ones that they don't name. Folders of changes that are
    under way are not touched: only what a deleted manifest named goes."""
    known = versions(spark, target)
    named = lambda vs: {e["folder"] for v in vs for es in manifest(spark, target, v)["tables"].values() for e in es}
    gone, held = named(known[:-keep]), named(known[-keep:])
    for folder in gone - held:
        files, path = _files(spark, f"{target}/{folder}")
        files.delete(path, True)
    for v in known[:-keep]:
        files, path = _files(spark, f"{target}/manifest-{v:020d}.json")
        files.delete(path, False)


def recompute_flags(spark: SparkSession, target: str, flagged_at=None, rules: dict | None = None) -> int:
    """Checks all stored measurements by the built-in rules and by user rules (see spc.check_with), replaces the stored flags by
    what is found, and returns how many there are. Running it again gives the same flags. Readers see the old flags until the
    new ones are committed."""
    from fabriloom.operators.spc import run_spc

    found = run_spc(read_table(spark, target, "measurements"), flagged_at, rules)
    return change(spark, target, {"spc_flags": found}, ("spc_flags",))["spc_flags"]


def seed_if_empty(spark: SparkSession, source: str, target: str, load: Callable = load_all) -> bool:
    """Loads the extracts and flags them, unless there are lots already; whether it did."""
    if stored_counts(spark, target).get("lots"):
        return False
    load(spark, source, target)
    recompute_flags(spark, target)
    return True
