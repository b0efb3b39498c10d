"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its 3-, 5- and 7-byte n-grams (with the blanks around it) and of itself. The embeddings of all
subwords of a passage of 8 words are averaged and go into a linear softmax over (clean, toxic); a document is as
toxic as its passages pooled by a smooth maximum, so that one insult in a long text is not averaged away.
Embeddings and softmax are trained jointly in numpy on a bounded sample of labelled rows. As the softmax is
linear, an embedding enters a score only as its dot product with the softmax weights, and that is what the
executors look up. A misspelling nobody has seen shares most n-grams with the word that it comes from.

Defined results: a null or empty text, or one without a word, has no passage and gets the score of the bias
alone; without a labelled row of each class every score is 0; if the sample's documents share no subword, every score is
the share of toxic ones among them; a null doc_id counts as held out; repeated rows are scored each; extra columns
are ignored by score() and kept by reject(). Very long texts are scored whole, in blocks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.llm import textops as T
from fabriloom.llm.common import held_out, label_sample, sample_texts, small_batches

#: log2 of the number of embeddings; their size; words in a passage; about so many toxic and clean labelled rows to
#: learn from.
BITS, SIZE, PASSAGE, TOXIC, CLEAN = 17, 8, 8, 400, 1000
GRAMS = (3, 5, 7)
_MULTIPLY = {n: np.uint64(x) for n, x in zip(GRAMS, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))}


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes with a blank before each row and at the end, and blanks for all but word bytes."""
    low = T.LOWER[data]
    low = np.where(T.ALNUM[low], low, np.uint8(32))
    return np.append(np.insert(low, offsets[:-1], 32), np.uint8(32)), offsets + np.arange(len(offsets))


def _subwords(data: np.ndarray, offsets: np.ndarray, bits: int):
    """Yields (position, bucket) arrays of the n-grams, then returns (word start, word end, row, word bucket)."""
    s, at = _padded(data, offsets)
    start, end, row = T.word_bounds(s, at, T.ALNUM)
    letters = np.r_[0, np.cumsum(s != 32)]
    grams, packed = [], s.astype(np.uint64)
    for n in range(2, min(max(GRAMS), len(s)) + 1):
        packed = packed[: len(s) - n + 1] | (s[n - 1 :].astype(np.uint64) << np.uint64(8 * n - 8))
        if n in _MULTIPLY:
            i = np.flatnonzero(letters[n - 1 : len(s)] - letters[1 : len(s) - n + 2] == n - 2)
            grams.append((i, ((packed[i] * _MULTIPLY[n]) >> np.uint64(64 - bits)).astype(np.int64)))
    whole = T.span_hashes(s, start, end) >> np.uint64(64 - bits)
    return grams, start, end, row, whole.astype(np.int64), len(s)


def _passages(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage, and its row."""
    if not len(row):
        return np.zeros(0, np.int64), row
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    p = np.flatnonzero(rank % PASSAGE == 0)
    return p, row[p]


def passage_sums(data, offsets, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each passage: sum of values over its subwords, their number, its row."""
    grams, start, end, row, whole, n = _subwords(data, offsets, bits)
    first, passage_row = _passages(row)
    if not len(first):
        return np.zeros(0), np.ones(0), passage_row
    total, count = values[whole].astype(np.float64), np.ones(len(start))
    for i, bucket in grams:
        own = np.zeros(n)
        own[i] = values[bucket]
        total += np.add.reduceat(own, np.c_[start - 1, end].ravel())[::2]
        lo, hi = np.searchsorted(i, start - 1), np.searchsorted(i, end)
        count += hi - lo
    return np.add.reduceat(total, first), np.add.reduceat(count, first), passage_row


def pooled(z: np.ndarray, rows: np.ndarray, n: int, bias: float) -> np.ndarray:
    """The smooth maximum log(sum(exp(z))) of each row's passages; the bias alone for a row without any."""
    out = np.full(n, float(bias))
    if len(z):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        top = np.maximum.reduceat(z, first)
        many = np.diff(np.r_[first, len(z)])
        out[rows[first]] = top + np.log(np.add.reduceat(np.exp(z - np.repeat(top, many)), first))
    return out


def train(texts: pa.Array, labels: np.ndarray, bits: int = BITS, rounds: int = 90, rate: float = 4.0, shrink: float = 0.01, seed: int = 3) -> dict:
    """Embeddings and softmax by gradient steps on the whole sample at once; returns each embedding's softmax value."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return {"values": np.zeros(1 << bits, np.float32), "bias": -np.inf, "bits": bits}
    bucket, passage, rows, n_passages, n_rows, docs_with = [], [], [], 0, len(labels), np.zeros(1 << bits, np.int64)
    for lo, _, data, offsets in T.blocks(texts):
        grams, start, end, row, whole, n = _subwords(data, offsets, bits)
        if not len(row):
            continue
        first, passage_row = _passages(row)
        of_word = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(row)])) + n_passages
        word_at = np.zeros(n + 1, np.int64)
        word_at[start] = 1
        word_at = np.cumsum(word_at) - 1
        own = np.concatenate([whole, *(b for _, b in grams)])
        at = np.concatenate([of_word, *(of_word[word_at[i + 1]] for i, _ in grams)])
        docs_with += np.bincount(np.unique(own * n_rows + np.concatenate([row, *(row[word_at[i + 1]] for i, _ in grams)])) // n_rows, minlength=1 << bits)
        bucket.append(own.astype(np.int32))
        passage.append(at.astype(np.int32))
        rows.append(passage_row + lo)
        n_passages += len(first)
    bucket, passage, rows = (np.concatenate([np.zeros(0, x[0].dtype if x else np.int32), *x]) for x in (bucket, passage, rows))
    size = np.bincount(passage, minlength=n_passages).astype(np.float64)
    used = np.flatnonzero(docs_with)
    if docs_with.max() < 2:
        share = labels.mean()
        return {"values": np.zeros(1 << bits, np.float32), "bias": float(np.log(share / (1 - share))), "bits": bits, "flat": True}
    # what few documents hold can only memorise wrong labels: its embedding moves so much more slowly
    trust = (docs_with[used] / (docs_with[used] + shrink * len(labels))) ** 2
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    kept = place[bucket] >= 0
    bucket, passage = place[bucket[kept]], passage[kept]
    parts = [slice(k, k + (1 << 20)) for k in range(0, len(bucket), 1 << 20)]

    def summed(to: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """bincount(to, values[of], n), a part of the pairs at a time."""
        return sum((np.bincount(to[c], values[of[c]], n) for c in parts), np.zeros(n))

    rng = np.random.default_rng(seed)
    e, w, bias = rng.normal(0, 0.1, (len(used), SIZE)) * trust[:, None], rng.normal(0, 0.5, (SIZE, 2)), -4.0
    importance = np.full(len(labels), 1 / len(labels))
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    many, doc = np.diff(np.r_[first, len(rows)]), rows[first]
    for step in range(rounds):
        direction = w[:, 1] - w[:, 0]
        z = summed(passage, e @ direction, bucket, n_passages) / size + bias
        top = np.maximum.reduceat(z, first)
        share = np.exp(z - np.repeat(top, many))
        total = np.add.reduceat(share, first)
        p = 1 / (1 + np.exp(-np.clip(top + np.log(total), -50, 50)))
        slope = np.repeat(importance[doc] * (p - labels[doc]) / total, many) * share
        g = summed(bucket, slope / size, passage, len(used))
        g_e, g_w = np.outer(trust * g, direction), e.T @ g
        pace = rate * (1 - step / rounds) ** 0.5
        # steps in proportion to the slopes: what many documents share moves, what a few have hardly does
        e -= pace * g_e / (np.abs(g_e).max() + 1e-30)
        w += 0.02 * pace * np.c_[g_w, -g_w] / (np.abs(g_w).max() + 1e-30)
        bias -= 0.3 * pace * slope.sum()
    values = np.zeros(1 << bits, np.float32)
    values[used] = e @ (w[:, 1] - w[:, 0])
    return {"values": values, "bias": float(bias), "bits": bits}


def scores(texts: pa.Array, model: dict) -> np.ndarray:
    out = np.full(len(texts), model["bias"])
    for lo, hi, data, offsets in T.blocks(texts) if not model.get("flat") and np.isfinite(model["bias"]) else ():
        total, count, rows = passage_sums(data, offsets, model["values"], model["bits"])
        out[lo:hi] = pooled(total / count + model["bias"], rows, hi - lo, model["bias"])
    return np.where(np.isneginf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> dict:
    """The model of a sample of about so many toxic and clean labelled rows, none of them held out."""
    usable = labels.select("doc_id", F.col("toxic").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0))
    chosen = label_sample(usable.where("label = 1"), "label", toxic).union(label_sample(usable.where("label = 0"), "label", clean))
    got = sample_texts(docs, chosen, "label")
    return train(got.column("text").cast(pa.large_string()).combine_chunks(), got.column("label").to_numpy())


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text) with score and predicted; every whole text is read once, without a shuffle."""

    def run(batches):
        for batch in batches:
            s = scores(T.column(batch, "text"), model)
            yield pa.RecordBatch.from_arrays([T.column(batch, "doc_id"), T.column(batch, "held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(T.column(batch, "text"), model) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
