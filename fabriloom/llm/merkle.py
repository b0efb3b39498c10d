"""Merkle manifest of a dataset: a tree of 16 children a node over each source's rows, one over the sources' roots, and
membership proofs.

Levels are built by sibling shifts: every node in slot zero of its run asks for the nodes at its own index plus 0 to 15,
an equijoin finds them, and the slot-zero row emits the parent. Proofs come down again level by level: a run's rows take
over what stands above their parent, so a leaf's shuffle carries one row for its run and none for each sibling.

Ids need not differ: equal doc_ids stand in the order of their leaves, so rows that are alike in all five columns have
leaves that are alike. A null doc_id comes first and is never tampered with; a null source is a source of its own, the
first. An empty table has no root and gives no rows. Columns beside the five are not part of a leaf, whatever their names."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fabriloom.llm.common import stage
from fabriloom.llm.native_text import _LOWER, _UPPER

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def leaf_of(*values: Column) -> Column:
    """sha256 over each value as byte count, colon and UTF-8 text, or as a dash if null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256)


def lower_cased(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with src (a number for each value of the string column group, rising with it) and idx (place in its group by
    order, from 0). Rows are dealt by ranges of group and order, so a group of any size is spread; ties among equal rows
    are broken by where they stand. Only a range's first group can have begun in an earlier one: what came before is a
    row for each range."""

    def number(batches):
        part, at, last, start = TaskContext.get().partitionId() << 33, 0, None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column(batch.schema.get_field_index(group)))
            ends, n = runs.run_ends.to_numpy(), batch.num_rows
            begins = np.r_[0, ends[:-1]].astype(np.int64) + at
            if last is not None and runs.values[0].as_py() == last:
                begins[0] = start
            own = np.repeat(begins, np.diff(np.r_[0, ends]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part + own, pa.int64()), pa.array(at + np.arange(n) - own, pa.int64())], names=[*batch.schema.names, "src", "idx"])
            at, last, start = at + n, runs.values[-1].as_py(), int(begins[-1])

    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order, "tie").drop("tie")
    local = stage(dealt.mapInArrow(number, StructType([*dealt.schema.fields, StructField("src", LongType()), StructField("idx", LongType())])), "placed")
    size = local.groupBy(group, "src").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(group).orderBy("src")
    size = size.select("src", F.min("src").over(own).alias("first"), F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    carried = F.broadcast(size.where("before > 0"))  # at most one row for each range
    return local.join(carried, "src", "left").withColumns({"src": F.coalesce("first", "src"), "idx": F.col("idx") + F.coalesce("before", F.lit(0))}).drop("first", "before")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The levels over nodes (src, idx, hash): (src, run, children, hash, last), a row for each run of 16 nodes. A run that is
    its level's only node is what remains of its src (last); its hash is that node's."""
    levels = []
    while True:
        wanted = nodes.where(F.col("idx") % ARITY == 0).select("src", (F.col("idx") / ARITY).cast("long").alias("run"), F.explode(F.sequence("idx", F.col("idx") + ARITY - 1)).alias("idx"))
        family = wanted.join(nodes, ["src", "idx"]).groupBy("src", "run").agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("m"))
        runs = family.select("src", "run", F.col("m.hash").alias("children"), ((F.col("run") == 0) & (F.size("m") == 1)).alias("last"))
        runs = stage(runs.withColumn("hash", F.when(F.col("last"), F.col("children")[0]).otherwise(F.sha2(F.array_join("children", ""), 256))), "level")
        levels.append(runs)
        nodes = runs.where(~F.col("last")).select("src", F.col("run").alias("idx"), "hash")
        if nodes.isEmpty():
            return levels


def remains(levels: list[DataFrame]) -> DataFrame:
    """(src, hash): the root of each src."""
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("last").select("src", "hash")


def path_of(slot: Column) -> Column:
    """What stands beside slot's node of a run (children, last, above), and above its parent."""
    step = F.struct(F.array_join(F.slice("children", F.lit(1), slot), "").alias("before"), F.array_join(F.slice("children", slot + 2, F.lit(ARITY)), "").alias("after"))
    return F.when(F.col("last"), F.col("above")).otherwise(F.concat(F.array(step), F.col("above")))


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's runs with above: the path from their parent up. tops (src, above) is the path over each src's root."""
    under: DataFrame | None = None
    for level in reversed(levels):
        runs = level.where("last").join(tops, "src")
        if under is not None:
            runs = runs.unionByName(level.where(~F.col("last")).join(under, ["src", "run"]))
        if level is levels[0]:
            return runs
        nodes = runs.select("src", "run", "last", "above", "children", F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("slot"))
        under = stage(nodes.select("src", (F.col("run") * ARITY + F.col("slot")).alias("run"), path_of(F.col("slot")).alias("above")), "paths")


@dataclass
class Manifest:
    """leaves: (src, idx, doc_id, source, leaf, altered); sources: (src, source, subroot); root: null for an empty table."""

    leaves: DataFrame
    sources: DataFrame
    root: str | None
    levels: list[DataFrame]
    tops: DataFrame

    def proofs(self) -> DataFrame:
        """Each leaf with its subroot's src and path: (before, after), the siblings' hashes on either side, from its own run up
        to the root. A level without siblings has two empty strings; the level at which a tree's last node stands has none."""
        runs = descend(self.levels, self.tops)
        own = self.leaves.withColumns({"run": F.floor(F.col("idx") / ARITY), "slot": (F.col("idx") % ARITY).cast("int")})
        return own.join(runs.select("src", "run", "children", "last", "above"), ["src", "run"]).withColumn("path", path_of(F.col("slot"))).drop("children", "last", "above", "run", "slot")


def manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The trees over docs (doc_id, source, lang, n_chars, text). altered, if given, is text as someone claims it to be; where
    it differs, leaves keep its leaf as well."""
    fields = [F.col(f) for f in FIELDS]
    leaf = leaf_of(*fields)
    other = F.lit(None).cast("string") if altered is None else F.when(altered.eqNullSafe(F.col("text")), None).otherwise(leaf_of(*fields[:-1], altered))
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # null before every source
    leaves = stage(docs.select("doc_id", "source", group.alias("own_group"), leaf.alias("leaf"), other.alias("altered")), "leaves")
    leaves = placed(leaves, "own_group", "doc_id", "leaf").drop("own_group")
    levels = climb(leaves.select("src", "idx", F.col("leaf").alias("hash")))
    subroots = placed(remains(levels).select(F.lit("").alias("all"), F.col("src").alias("own"), F.col("hash")), "all", "own").drop("all")
    above = climb(subroots.select("src", "idx", "hash"))
    found = remains(above).first()
    empty = remains(above).select("src", F.array().cast(_PATH).alias("above"))
    runs = descend(above, empty)
    nodes = subroots.withColumns({"run": F.floor(F.col("idx") / ARITY), "slot": (F.col("idx") % ARITY).cast("int")}).join(runs.drop("hash"), ["src", "run"])
    tops = stage(nodes.select(F.col("own").alias("src"), path_of(F.col("slot")).alias("above"), F.col("hash").alias("subroot")), "tops")
    return Manifest(leaves, tops.select("src", "subroot"), found and found["hash"], levels, tops.select("src", "above"))


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower_cased(F.col("text"))).otherwise(F.col("text"))
    found = manifest(docs, claimed)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    rows = found.proofs().join(found.sources, "src").withColumns({"root": F.lit(found.root).cast("string"), "proof_sha256": F.sha2(siblings, 256), "folded_root": folded(F.coalesce("altered", "leaf"), F.col("path"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
