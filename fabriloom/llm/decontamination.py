"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of `window` consecutive words (an item of fewer words is one window). A
window that stands in a document brings all its shingles along, so a join on one of them, the necessary prefix for
a containment of 1, finds every occurrence. The join takes the shingle that is rarest over all documents. Its
position gives the only place where the window can start; the length and positional bounds are that it starts at 0 or
later and ends by the last word. What passes is compared word for word.

Items and their windows stay a distributed table of any size: the executors thin out document shingles with a Bloom
filter of fixed size, and only what passes goes into the exact join. The prefix table is broadcast only up to
BROADCAST_ROWS rows, and shuffled beyond that.

Defined results: null, empty and wordless texts have no words and hit nothing; null, empty and wordless items
have no windows; items with equal texts each count; repeated item rows (same id and text) count once; repeated
document rows are answered each; a null item_id is listed as an empty string; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabriloom.llm import textops as T
from fabriloom.llm.common import bit_map, small_batches, stage, BitMap

#: Words in a window; words in a shingle (1 in windows of fewer words); rows up to which the prefix table is broadcast.
WINDOW, SHINGLE, BROADCAST_ROWS = 10, 3, 200_000
_ONE = np.uint64(0x5851F42D4C957F2D)


def _tokens(words: np.ndarray, rows: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, index of its first word) of all shingles of q words and of all single words."""
    shingle, _, at = T.shingle_hashes(words, rows, q, short=False)
    return np.r_[shingle, words * _ONE], np.r_[at, np.arange(len(words))]


def benchmark_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, window id, its words, its candidate tokens and their offsets), one row for each window."""

    def run(batches):
        for batch in batches:
            out = {"item_id": [], "words": [], "token": [], "offset": []}
            ids = T.column(batch, "item_id").to_pylist()
            for lo, _, data, offsets in T.blocks(T.column(batch, "text")):
                words, row, start, end = T.word_hashes(data, offsets, T.ALNUM)
                low = T.LOWER[data].tobytes()
                text = [low[a:z].decode() for a, z in zip(start, end)]
                for r in np.unique(row):
                    a, z = np.searchsorted(row, [r, r + 1])
                    size = min(window, z - a)
                    q = shingle if size >= shingle else 1
                    for i in range(a, z - size + 1):
                        own, zero = words[i : i + size], np.zeros(size, np.int64)
                        token, at = _tokens(own, zero, q)
                        token, at = (token[: size - q + 1], at[: size - q + 1]) if q > 1 else (token[-size:], at[-size:])
                        out["item_id"].append(ids[lo + r])
                        out["words"].append(text[i : i + size])
                        out["token"].append(token.view(np.int64))
                        out["offset"].append(at)
            yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.string()), pa.array(out["words"], pa.list_(pa.string())), pa.array(out["token"], pa.list_(pa.int64())), pa.array(out["offset"], pa.list_(pa.int32()))], names=["item_id", "words", "token", "offset"])

    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    found = items.mapInArrow(run, "item_id string, words array<string>, token array<long>, offset array<int>")
    return found.groupBy("words").agg(F.first("token").alias("token"), F.first("offset").alias("offset"), F.collect_set("item_id").alias("items")).withColumn("window_id", F.xxhash64("words"))


def token_counts(docs: DataFrame, bits: BitMap, shingle: int = SHINGLE) -> DataFrame:
    """How often each token that may be the benchmark's stands in all documents."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in T.blocks(T.column(batch, "text")):
                words, row, *_ = T.word_hashes(data, offsets, T.ALNUM)
                token, _ = _tokens(words, row, shingle)
                token, count = np.unique(token[bits.hit(token)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rarest token of each window over all documents; a window with a token that no document has needs no row."""
    each = windows.select("window_id", "words", "items", F.explode(F.arrays_zip("token", "offset")).alias("t")).select("window_id", "words", "items", "t.token", "t.offset")
    ranked = each.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("window_id").agg(F.min(F.struct("n", "token", "offset", "words", "items")).alias("m"))
    return rarest.where("m.n > 0").select("m.token", "window_id", "m.offset", "m.words", "m.items")


def scan(docs: DataFrame, bits: BitMap, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """docs with n_words and, for every place of a token that may be a prefix, the words around it."""

    def run(batches):
        for batch in batches:
            column = T.column(batch, "text")
            n_words, places = np.zeros(len(column), np.int64), [[] for _ in range(len(column))]
            for lo, hi, data, offsets in T.blocks(column):
                words, row, start, end = T.word_hashes(data, offsets, T.ALNUM)
                n_words[lo:hi] = np.bincount(row, minlength=hi - lo)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                token, at = _tokens(words, row, shingle)
                hit = np.flatnonzero(bits.hit(token))
                low = None
                for j in hit:
                    i = at[j]
                    low = T.LOWER[data].tobytes() if low is None else low
                    a, z = first[row[i]], first[row[i] + 1]
                    b, e = max(a, i - window), min(z, i + window)
                    places[lo + row[i]].append({"token": int(token[j].view(np.int64)), "at": int(i - a), "before": int(i - b), "words": [low[start[k] : end[k]].decode() for k in range(b, e)]})
            keep = [T.column(batch, name) for name in batch.schema.names if name != "text"]
            kind = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n_words), pa.array(places, kind)], names=[*(n for n in batch.schema.names if n != "text"), "n_words", "places"])

    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{ids}, n_words long, places array<struct<token:long,at:int,before:int,words:array<string>>>")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) with row_id, n_words and one row for each occurrence of a window: start, size, items.
    A row without any has nulls there."""
    windows = stage(benchmark_windows(items, window, shingle), "windows")
    counts = token_counts(docs, bit_map(windows.select(F.explode("token").alias("token")), 22), shingle)
    index = stage(prefixes(windows, counts), "prefixes")
    rows = scan(docs.select("doc_id", "text"), bit_map(index.select("token"), 22), window, shingle)
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    each = rows.select("row_id", "doc_id", "n_words", F.explode_outer("places").alias("p"))
    small = index.count() <= BROADCAST_ROWS
    # rows without a place need a key of their own: a null one would send all of them to one task
    each = each.withColumn("key", F.coalesce("p.token", F.xxhash64("row_id")))
    index = index.withColumnRenamed("token", "prefix")
    skip = F.col("p.before") - F.col("offset")
    # arrays are sliced only inside their bounds, which are the positional and length bounds of the method
    fits = F.col("p").isNotNull() & (skip >= 0) & (skip + F.size("words") <= F.size("p.words"))
    same = F.when(fits, F.slice("p.words", F.when(fits, skip + 1).otherwise(1), F.size("words")) == F.col("words")).otherwise(False)
    joined = each.join(F.broadcast(index) if small else index, F.col("key") == F.col("prefix"), "left")
    return joined.select("row_id", "doc_id", "n_words", F.when(same, F.col("p.at") - F.col("offset")).alias("start"), F.when(same, F.size("words")).alias("size"), F.when(same, F.col("items")).alias("items"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document row: n_words, hit words, and the items whose windows occur."""
    found = occurrences(docs, items, window, shingle)
    # overlapping occurrences: each adds the words beyond those that end furthest before it; sizes are at most a window
    place = Window.partitionBy("row_id").orderBy(F.col("start").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(place), F.lit(0))))
    part = found.withColumn("new", F.coalesce(new, F.lit(0)))
    return part.groupBy("row_id", "doc_id", "n_words").agg(F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return hits(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
