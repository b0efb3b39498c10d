"""Scores of texts by an n-gram language model of the corpus, kept in Elias-Fano tries.

Texts are cut into tokens once, in blocks of some megabytes: each block is one row of word hashes, token places and
counts. A block's distinct n-grams go to shards by their first word (a frequent first word is spread by the second one),
each with its count in the learned documents. A shard adds the counts of all blocks up, builds the trie of what was
learned (elias_fano.Trie) with quantised smoothed probabilities, saves it to a file of the task, maps that into memory, and
looks every n-gram of every block up in it. The answers meet their blocks again, and each document's tokens are summed up.
So what is shuffled is distinct n-grams of blocks and never a row for each token, and no task holds more than a block or a
shard; the number of shards follows the number of tokens.

Smoothing is by Dirichlet priors: p(w | context) = a(context, w) + b(context) p(w | shorter context), with
a = count(context, w) / (count(context) + PRIOR) and b = PRIOR / (count(context) + PRIOR); the last resort is the
add-one unigram, which gives all unknown words together one place. a is stored as a code of 1/32 octave and rounded
down, so that probabilities never sum to more than 1. Texts are scored from a begin mark to an end mark; the begin mark
is context only.

Words are 64-bit hashes, words that follow 48 bits of them: of a context with a million different followers two are taken
for one with a probability of 0.002, which changes their stored probability and no count that is returned.

A null text is empty (one end token), a null doc_id is scored and never learned from, repeated rows are rows of their own,
an empty table gives no rows. Without learned documents every score is 0. Columns besides the two used are ignored."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from fabriloom.llm import textops as T
from fabriloom.llm.common import held_out, mix64, small_batches, stage
from fabriloom.llm.elias_fano import Trie

#: n of the longest n-grams; weight of the shorter context; tokens of a block; n-grams of a shard (more where there would be
#: over 2^20 shards); tokens for which the estimate of word counts keeps about one entry.
ORDER, PRIOR, BLOCK, SHARD, THIN = 2, 256.0, 2_500_000, 1_000_000, 4096
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_U, _LOW = np.uint64, np.uint64((1 << 32) - 1)
_KINDS = "u1 u2 u4 u8 i4 i8".split()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one string of bytes."""
    head = np.array([[_KINDS.index(a.dtype.str[1:]), len(a)] for a in arrays], np.int64)
    return b"".join([np.int64(len(arrays)).tobytes(), head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpacked(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 + 16 * n
    for kind, size in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2):
        out.append(np.frombuffer(raw, _KINDS[kind], int(size), at))
        at += out[-1].nbytes
    return out


def pressed(a: np.ndarray) -> bytes:
    """An array compressed, its bytes of equal weight beside one another."""
    flat = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.T).tobytes())


def restored(raw: bytes, kind) -> np.ndarray:
    got = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(got.reshape(size, -1).T).view(kind).ravel()


def coded(p: np.ndarray) -> np.ndarray:
    """Probabilities as codes of 1/32 octave, rounded down; 0 means none."""
    return np.where(p > 0, np.minimum(np.ceil(-np.log2(np.where(p > 0, p, 1.0)) * 32), 65534) + 1, 0).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2((1.0 - codes) / 32), 0.0)


def blocks(batches, key: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, learn, text) as blocks of about size tokens: the documents' keys, learn flags and token counts, the sorted hashes
    of the words, each token's place among them, and entries (word, n) that are expected to add up to the words' counts."""
    number, ids, flags, sizes, hashes, n = 0, [], [], [], [], 0

    def row() -> pa.RecordBatch:
        lens, learn = np.concatenate(sizes).astype(np.int32), np.concatenate(flags)
        words, ranks, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        block = (TaskContext.get().partitionId() << 33) + number
        every, many = np.r_[words, BEGIN], np.r_[counts, len(lens)]
        draw = mix64(every ^ mix64(np.array([block], _U))) / 2.0**64
        kept = np.flatnonzero(draw * THIN < many)
        heavy = pa.StructArray.from_arrays([pa.array(every[kept].view(np.int64)), pa.array(np.maximum(many[kept], THIN))], names=["word", "n"])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        learned = int((lens[learn] + 1).sum())
        columns = [pa.array([block]), one(pa.concat_arrays(ids)), pa.array([learn.tobytes()], pa.binary()), pa.array([lens.tobytes()], pa.binary()), pa.array([pressed(np.diff(words, prepend=_U(0)))]), pa.array([pressed(ranks.astype(np.uint32))]), one(heavy), pa.array([int(lens.sum()) + 2 * len(lens)]), pa.array([learned])]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "learn", "lens", "words", "ranks", "heavy", "tokens", "learned"])

    for batch in batches:
        key_of, learn = T.column(batch, key), T.column(batch, "learn").to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in T.blocks(T.column(batch, "text")):
            found, row_of, _, _ = T.word_hashes(data, offsets, T.NOT_SPACE)
            ids.append(key_of.slice(lo, hi - lo))
            flags.append(learn[lo:hi].astype(bool))
            sizes.append(np.bincount(row_of, minlength=hi - lo))
            hashes.append(found)
            n += len(found) + hi - lo
            if n >= size:
                yield row()
                number, ids, flags, sizes, hashes, n = number + 1, [], [], [], [], 0
    if ids:
        yield row()


class Layout:
    """A block's n-grams as they go to the shards. levels[k] has the distinct grams of k + 1 words, sorted by shard, first word
    and so on: parent (their place on the level before) and word (its rank); at[k] has each token place's gram (-1: the text
    ends before it). Ranks beyond the words' are the end and begin marks."""

    def __init__(self, row: dict, shards: int, hot: tuple[np.ndarray, np.ndarray], order: int):
        words = np.cumsum(restored(row["words"], _U), dtype=_U)
        ranks, self.lens = restored(row["ranks"], np.uint32), np.frombuffer(row["lens"], np.int32).astype(np.int64)
        self.words, self.learn = np.r_[words, END, BEGIN], np.frombuffer(row["learn"], bool)
        last = np.cumsum(self.lens + 2) - 1
        self.begin, self.end = last - self.lens - 1, last
        y = np.full(int(self.lens.sum()) + 2 * len(self.lens), len(words) + 1, np.int64)
        y[last] = len(words)
        inner = np.ones(len(y), bool)
        inner[self.begin] = inner[last] = False
        y[inner] = ranks
        self.y = y
        self.learned = np.repeat(self.learn, self.lens + 2)
        parts = np.ones(len(self.words), np.int64)
        place = np.minimum(np.searchsorted(hot[0], self.words), max(0, len(hot[0]) - 1))
        if len(hot[0]):
            parts = np.where(hot[0][place] == self.words, hot[1][place], 1)
        rank = np.repeat(np.arange(len(self.words)), parts)
        part = np.arange(len(rank)) - np.repeat(np.cumsum(parts) - parts, parts)
        roots = np.unique(shard_of(self.words[rank], part, shards).astype(np.int64) << 32 | rank)
        self.shard, self.levels = roots >> 32, [(np.zeros(len(roots), np.int64), roots & 0xFFFFFFFF)]
        home = np.searchsorted(roots, shard_of(self.words, np.zeros(len(self.words), np.int64), shards).astype(np.int64) << 32 | np.arange(len(self.words)))
        first = home[y]
        spread = np.flatnonzero(parts[y[:-1]] > 1)
        part = (mix64(self.words[y[spread + 1]]) % parts[y[spread]].astype(_U)).astype(np.int64)
        first[spread] = np.searchsorted(roots, shard_of(self.words[y[spread]], part, shards).astype(np.int64) << 32 | y[spread])
        self.at, before = [first], first
        left = np.repeat(last, self.lens + 2) - np.arange(len(y))  # tokens that follow in the text
        for k in range(1, order):
            some = np.flatnonzero(left >= k)
            grams, place = np.unique(before[some] << 32 | y[some + k], return_inverse=True)
            before = np.full(len(y), -1, np.int64)
            before[some] = place
            self.at.append(before)
            self.levels.append((grams >> 32, grams & 0xFFFFFFFF))

    def counts(self, k: int) -> np.ndarray:
        """How often each gram of level k stands in learned documents."""
        if k == 0:
            return np.bincount(self.y[self.learned], minlength=len(self.words))[self.levels[0][1]]
        at = self.at[k][self.learned]
        return np.bincount(at[at >= 0], minlength=len(self.levels[k][0]))

    def slices(self) -> Iterator[tuple[int, list[slice]]]:
        """Each shard with its stretch of every level."""
        cuts = np.flatnonzero(np.r_[True, self.shard[1:] != self.shard[:-1], True])
        bounds = [cuts]
        for parent, _ in self.levels[1:]:
            bounds.append(np.searchsorted(parent, bounds[-1]))
        for i in range(len(cuts) - 1):
            yield int(self.shard[cuts[i]]), [slice(int(b[i]), int(b[i + 1])) for b in bounds]


def shard_of(words: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return mix64(words + part.astype(_U) * _U(0x9E3779B97F4A7C15)) % _U(shards)


def spread(layout: Layout) -> Iterator[tuple[int, bytes]]:
    """What a block sends to each shard: its words with their counts and, for each level, the parents' numbers of
    children and the children's words and counts."""
    counts = [layout.counts(k).astype(np.uint32) for k in range(len(layout.levels))]
    follow = layout.words >> _U(16)
    high, low = (follow >> _U(16)).astype(np.uint32), follow.astype(np.uint16)
    kids = [np.bincount(parent, minlength=len(layout.levels[k][0])).astype(np.uint32) for k, (parent, _) in enumerate(layout.levels[1:])]
    for shard, own in layout.slices():
        arrays = [layout.words[layout.levels[0][1][own[0]]], counts[0][own[0]]]
        for k in range(1, len(own)):
            rank = layout.levels[k][1][own[k]]
            arrays += [kids[k - 1][own[k - 1]], high[rank], low[rank], counts[k][own[k]]]
        yield shard, packed(*arrays)


def answers(shard: int, shards: int, payloads: list[bytes], prior: float) -> tuple[int, list[bytes]]:
    """Builds a shard's trie from what the blocks sent and looks all of their grams up in it: the number of learned words
    that are this shard's own, and for each block counts of words, then for each level codes of its grams' probabilities
    and (but for the last) of the weight that their continuations leave to shorter contexts."""
    sent = [unpacked(p) for p in payloads]
    order = 1 + (len(sent[0]) - 2) // 4
    both = lambda i: np.concatenate([s[i] for s in sent])
    words, place = np.unique(both(0), return_inverse=True)
    total = np.bincount(place, both(1), len(words)).astype(np.int64)
    followers = [both(4 * k - 1).astype(_U) << _U(16) | both(4 * k) for k in range(1, order)]
    known = [both(4 * k + 1) for k in range(1, order)]
    vocabulary, ident = np.unique(np.concatenate([*followers, np.zeros(0, _U)]), return_inverse=True)
    listed = np.bincount(ident, np.concatenate([*known, np.zeros(0)]), len(vocabulary)) > 0
    new = np.cumsum(listed) - 1
    nodes, levels, places, lo, above, rank = [], [], [place], 0, total, np.cumsum(total > 0) - 1
    for k in range(1, order):
        own = ident[lo : lo + len(followers[k - 1])]
        lo += len(own)
        grams, place = np.unique(np.repeat(places[-1], both(4 * k - 2)) << 32 | own, return_inverse=True)
        count = np.bincount(place, known[k - 1], len(grams))
        parent, word = grams >> 32, grams & 0xFFFFFFFF
        some = count > 0
        codes = [coded(count[some] / (above[parent[some]] + prior))]
        if k < order - 1:
            codes.append(coded(prior / (count[some] + prior)))
        levels.append((rank[parent[some]], new[word[some]], np.array(codes)))
        nodes.append((parent, word))
        places.append(place)
        above, rank = count, np.cumsum(some) - 1
    with tempfile.TemporaryDirectory() as folder:
        Trie.of(words[total > 0], total[total > 0], vocabulary[listed], levels).save(path := os.path.join(folder, "trie"))
        trie = Trie.open(path)
        at, there = trie.root(words)
        found = [[np.where(there, np.asarray(trie.counts)[np.minimum(at, max(0, len(trie.counts) - 1))] if len(trie.counts) else 0, 0)]]
        mine = int((there & (words != BEGIN) & (shard_of(words, np.zeros(len(words), np.int64), shards) == shard)).sum())
        name, named = trie.vocabulary.successor(vocabulary)
        for k, (parent, word) in enumerate(nodes):
            at, there = trie.child(k, at[parent], name[word], there[parent] & named[word])
            codes = trie.levels[k][2]
            found.append([np.where(there, codes[j][at] if codes.shape[1] else 0, 0).astype(np.uint16) for j in range(len(codes))])
        del trie, codes
    out, lows = [], [0] * order
    for s in sent:
        sizes = [len(s[0]), *(len(s[4 * k]) for k in range(1, order))]
        arrays = [a[places[k][lows[k] : lows[k] + sizes[k]]] for k in range(order) for a in found[k]]
        lows = [a + b for a, b in zip(lows, sizes)]
        out.append(packed(*arrays))
    return mine, out


def scored(layout: Layout, got: dict[int, bytes], total: int, distinct: int, prior: float) -> list[np.ndarray]:
    """Of each document of a block: tokens, known tokens, base score and score. got: the shards' answers."""
    order = len(layout.levels)
    count = np.zeros(len(layout.words), np.int64)
    codes = [[np.zeros(len(parent), np.uint16) for _ in range(1 + (k < order - 2))] for k, (parent, _) in enumerate(layout.levels[1:])]
    for shard, own in layout.slices():
        arrays = iter(unpacked(got[shard]))
        count[layout.levels[0][1][own[0]]] = next(arrays)
        for k, kinds in enumerate(codes, 1):
            for kind in kinds:
                kind[own[k]] = next(arrays)
    base = (count + 1.0) / (total + distinct + 1.0)
    p = base[layout.y]
    for k, kinds in enumerate(codes, 1):
        here = np.flatnonzero(layout.at[k] >= 0)
        shorter = prior / (count[layout.y[here]] + prior) if k == 1 else np.where(codes[k - 2][1] > 0, decoded(codes[k - 2][1]), 1.0)[layout.at[k - 1][here]]
        p[here + k] = decoded(kinds[0])[layout.at[k][here]] + shorter * p[here + k]
    known = (count > 0)[layout.y].astype(np.int64)
    plain, full = np.log10(base)[layout.y], np.log10(p)
    for a in (known, plain, full):
        a[layout.begin] = 0
    return [layout.lens + 1, *(np.add.reduceat(a, layout.begin) if len(layout.begin) else a for a in (known, plain, full))]


def score(docs: DataFrame, learn: Column, key: str = "doc_id", order: int = ORDER, prior: float = PRIOR, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(key, learn, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (key, text), by a model of the rows
    where learn holds."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType
    binary = lambda name: StructField(name, BinaryType())
    number = lambda name: StructField(name, LongType())
    heavy = StructField("heavy", ArrayType(StructType([number("word"), number("n")])))
    schema = StructType([number("block"), StructField("ids", ArrayType(kind)), *map(binary, ("learn", "lens", "words", "ranks")), heavy, number("tokens"), number("learned")])
    held = stage(docs.select(key, F.coalesce(learn, F.lit(False)).alias("learn"), "text").mapInArrow(lambda batches: blocks(batches, key, block), schema), "blocks")
    sums = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("learned"), F.lit(0)).alias("learned")).first()
    size = max(shard, sums["tokens"] >> 20)
    shards = max(1, -(-sums["tokens"] // size))
    part = max(1, size // 4)  # a word is spread once it is expected to take a quarter of a shard: at most 4 words a shard
    many = held.select(F.explode("heavy").alias("h")).groupBy("h.word").agg(F.sum("h.n").alias("n")).where(F.col("n") > part).orderBy("word").collect() if shards > 1 else []
    words = np.array([r["word"] for r in many], np.int64).view(_U)
    order_of = np.argsort(words)
    hot = words[order_of], np.array([min(shards, math.ceil(r["n"] / part)) for r in many], np.int64)[order_of]

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for to, payload in spread(Layout(row, shards, hot, order)):
                    yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([row["block"]]), pa.array([payload])], names=["shard", "block", "payload"])

    def answer(table: pa.Table) -> pa.Table:
        to = table.column("shard")[0].as_py()
        mine, out = answers(to, shards, table.column("payload").to_pylist(), prior)
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "words": pa.array([mine] + [0] * (len(out) - 1)), "payload": pa.array(out, pa.binary())})

    grams = held.select("block", "learn", "lens", "words", "ranks").mapInArrow(send, "shard int, block long, payload binary")
    found = stage(grams.groupBy("shard").applyInArrow(answer, "block long, shard int, words long, payload binary"), "answers")
    total, distinct = sums["learned"], found.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()["v"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in ("learn", "lens", "words", "ranks")}
        layout = Layout(row, shards, hot, order)
        got = dict(zip(right.column("shard").to_pylist(), right.column("payload").to_pylist()))
        tokens, known, plain, full = scored(layout, got, total, distinct, prior)
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table({key: ids, "learn": pa.array(layout.learn), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(tokens), total), pa.int64()), "base_score": pa.array(plain), "score": pa.array(full)})

    out = StructType([docs.schema[key], *StructType.fromDDL("learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    texts = held.select("block", "ids", "learn", "lens", "words", "ranks").groupBy("block")
    return texts.cogroup(found.select("block", "shard", "payload").groupBy("block")).applyInArrow(finish, out)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = score(docs, ~held_out(F.col("doc_id"), 7, 2))
    return rows.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op13_language_model that SQL can express; the base score to six digits behind the point."""
    rows = op13_language_model(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))
