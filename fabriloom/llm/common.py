"""Staging in the shared folder, bit maps of bounded size, and label sampling."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only if that is unset and Spark runs in this process alone (tests), a folder of
    our own. On a cluster a folder that all machines share must be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fabriloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; Hadoop deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, jvm_path = _hadoop(spark, path)
    files.deleteOnExit(jvm_path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes the files of tables made by stage() that nothing reads any more."""
    for df in staged:
        files, jvm_path = _hadoop(df.sparkSession, df._staged_path)
        files.delete(jvm_path, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 22) -> None:
    """Has Spark hand rows to Python in batches of at most so many rows and bytes: texts are long, and a batch is held
    by the JVM and by Python."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name)
        if not now.isdigit() or int(now) > most:
            spark.conf.set(name, str(most))


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name, begun with name, that none of the tables has."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:8]}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))  # a new array, the only one besides the shifted ones
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Seen:
    """Which keys (64-bit hashes) came lately, in a table of fixed size: a new key takes the place of an older one. It
    only spares rows, which later aggregates would combine anyhow."""

    def __init__(self, bits: int = 16):
        self.slots, self.mask = np.zeros(1 << bits, np.int64), (1 << bits) - 1

    def new(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys aren't known; all are afterwards."""
        keys = np.asarray(keys).view(np.int64)
        at = keys & self.mask
        out = self.slots[at] != keys
        self.slots[at] = keys
        return out

    def first(self, key: int) -> bool:
        at = key & self.mask
        if self.slots[at] == key:
            return False
        self.slots[at] = key
        return True


class BitMap:
    """A Bloom filter of two hashes, of a number of bits chosen by the number of keys up to a fixed bound.

    It only thins out what the executors send to an exact join, so a false positive costs a row of
    shuffle and never changes a result."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        a = mix64(keys.astype(np.uint64, copy=False) ^ np.uint64(0x9E3779B97F4A7C15))
        low = np.uint64((1 << bits) - 1)
        return a & low, (a >> np.uint64(32)) & low

    def __contains__(self, _):
        raise TypeError("use hit()")

    def hit(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for slot in self.slots(keys, self.bits):
            got = (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
            out = got if out is None else out & got
        return out.astype(bool)


def bit_map(keys: DataFrame, most: int = 26) -> BitMap:
    """The BitMap of the one long column of keys, which are counted first: about 16 bits for each, but 2^most bits (8 MB)
    at most; with more keys it lets more rows through to the exact join. Every task sends the 64-bit words of its map
    that are not zero, Spark ORs them by word, and the driver receives at most 2^(bits-6) of them."""
    bits = max(16, min(most, 4 + keys.count().bit_length()))

    def words(batches):
        own = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for slot in BitMap.slots(k, bits):
                np.bitwise_or.at(own, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at].view(np.int64))], names=["word", "value"])

    got = keys.mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    all_words = np.zeros(1 << (bits - 6), np.uint64)
    all_words[got.column("word").to_numpy()] = got.column("value").to_numpy().view(np.uint64)
    return BitMap(bits, all_words)


def held_out(doc_id, mod: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == remainder, F.lit(True))


def label_sample(rows: DataFrame, by: str, per_class: int, seed: int = 7, classes: int = 64, total: int | None = None) -> DataFrame:
    """About per_class rows of each value of by, chosen by the hash of doc_id over all rows. Of more than so many
    values the most frequent are learned. With total, many values share so many rows evenly.

    The counts come from one aggregate over every row; what is returned is bounded by the number of
    classes times per_class, however large the input is."""
    counts = rows.groupBy(by).count().orderBy(F.desc("count"), by).limit(classes).collect()
    if not counts:
        return rows.limit(0)
    if total is not None:
        per_class = min(per_class, -(-total // len(counts)))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(by) == F.lit(r[by]), F.lit(min(1.0, per_class / r["count"]))).otherwise(share)
    return rows.where((F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) < share).limit(2 * per_class * len(counts))


def sample_texts(docs: DataFrame, chosen: DataFrame, label: str, on: tuple[str, ...] = ("doc_id",), size: int = 48 << 20) -> pa.Table:
    """(text, label) of the rows of docs (text and the columns of on) that chosen (doc_id, label) names, in the order of doc_id. chosen
    is bounded by label_sample(), and so may be broadcast and put in one window. Of rows that share a doc_id and label
    one is taken, and of texts so many bytes in all: whole texts in the order of a hash, until the next would go beyond."""
    one = F.min(F.struct(F.xxhash64("text").alias("draw"), "text")).alias("m")
    rows = docs.select(*on, "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), list(on)).groupBy("doc_id", label).agg(one)
    total = F.sum(F.octet_length("m.text").cast("long")).over(Window.partitionBy(F.lit(1)).orderBy("m.draw", "doc_id", label))
    return rows.withColumn("total", total).where(F.col("total") <= size).orderBy("doc_id", label).select("m.text", label).toArrow()
