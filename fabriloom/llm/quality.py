"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of 32 words. Each passage is encoded as the frequencies of its byte classes and
of pairs of neighbouring classes, its mean word length, and how much its words repeat. Gated attention
(softmax of w . (tanh(V h) * sigmoid(U h))) weighs the passages; the weighted representation goes through a
logistic layer. The encoder is fixed and standardised by the sample's mean and deviation; attention and output are trained in
numpy on document labels only, from a bounded sample of labelled rows.

Defined results: a null or empty text, or one of blanks only, is one passage of zeros; with no labelled row every
score is 0.5, with a single class in the labels the model learns that; a null doc_id counts as held out; repeated
rows are scored each; extra columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.llm import textops as T
from fabriloom.llm.common import held_out, label_sample, sample_texts, small_batches

#: Words in a passage, size of the attention layer, labelled rows of each class to learn from.
PASSAGE, HIDDEN, PER_CLASS = 32, 16, 1500
_CLASSES = [b" \t\r", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"|#*&%$@~^_=+<>", b"'\"()[]{}/\\-", bytes(range(0x80, 0x100))]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _i
N_CLASSES = len(_CLASSES) + 1
WIDTH = N_CLASSES + N_CLASSES**2 + 4


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, its row); every row has a passage at least."""
    n = len(offsets) - 1
    words, row, start, _ = T.word_hashes(data, offsets, T.NOT_SPACE)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    head = np.flatnonzero(rank % PASSAGE == 0)
    none = np.setdiff1d(np.arange(n), row)
    passage_row = np.r_[row[head], none]
    # a passage's bytes begin with its first word, or where its row begins
    begin = np.where(rank[head] == 0, offsets[row[head]], start[head])
    out = np.zeros((len(passage_row), WIDTH))
    if len(head):
        owner = np.zeros(len(data) + 1, np.int64)
        owner[begin] = 1
        owner = np.cumsum(owner)[:-1] - 1
        kind = _CLASS[data]
        covered = owner >= 0
        m = len(head)
        out[:m, :N_CLASSES] = np.bincount(owner[covered] * N_CLASSES + kind[covered], minlength=m * N_CLASSES).reshape(m, -1)
        same = covered[:-1] & (owner[1:] == owner[:-1])
        pair = owner[:-1][same] * N_CLASSES**2 + kind[:-1][same] * N_CLASSES + kind[1:][same]
        out[:m, N_CLASSES:-4] = np.bincount(pair, minlength=m * N_CLASSES**2).reshape(m, -1)
        size = np.maximum(out[:m, :N_CLASSES].sum(1, keepdims=True), 1)
        out[:m, :-4] /= size
        of = np.repeat(np.arange(m), np.diff(np.r_[head, len(words)]))
        many = np.bincount(of, minlength=m)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        order = np.lexsort((words, of))
        twice = np.zeros(len(words), bool)
        twice[1:] = (words[order][1:] == words[order][:-1]) & (of[order][1:] == of[order][:-1])
        out[:m, -4] = size[:, 0] / many / 16
        out[:m, -3] = np.bincount(of, again, m) / many
        out[:m, -2] = np.bincount(of[order], twice, m) / many
        out[:m, -1] = many / PASSAGE
    order = np.argsort(passage_row, kind="stable")
    return out[order], passage_row[order]


def _forward(h, rows, first, many, p):
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -50, 50)))
    a = (t * s) @ p["a"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), many))
    a /= np.repeat(np.add.reduceat(a, first), many)
    z = np.add.reduceat(a[:, None] * h, first)
    return t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ p["w"] + p["b"], -50, 50)))


def train(texts: pa.Array, labels: np.ndarray, rounds: int = 120, rate: float = 0.03, decay: float = 1e-4, seed: int = 5) -> dict:
    """Gated attention and output layer by Adam, the whole sample in each step."""
    labels = np.asarray(labels, np.float64)
    if not len(labels):
        return {}
    parts = [(h, rows + lo) for lo, _, data, offsets in T.blocks(texts) for h, rows in [encode(data, offsets)]]
    h, rows = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    mean, scale = h.mean(0), h.std(0) + 0.02
    h = (h - mean) / scale
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    many = np.diff(np.r_[first, len(rows)])
    rng = np.random.default_rng(seed)
    p = {"v": rng.normal(0, 0.05, (h.shape[1], HIDDEN)), "u": rng.normal(0, 0.05, (h.shape[1], HIDDEN)), "a": rng.normal(0, 0.3, HIDDEN), "w": np.zeros(h.shape[1]), "b": np.zeros(1)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        t, s, a, z, y = _forward(h, rows, first, many, p)
        d = (y - labels) / len(labels)
        d_a = np.repeat(d, many) * (h @ p["w"] - np.repeat(z @ p["w"], many)) * a
        d_ts = d_a[:, None] * p["a"]
        grads = {"w": z.T @ d, "b": np.array([d.sum()]), "a": (t * s).T @ d_a, "v": h.T @ (d_ts * s * (1 - t * t)), "u": h.T @ (d_ts * t * s * (1 - s))}
        for k, g in grads.items():
            g = g + decay * p[k]
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.01 * (g * g - m2[k])
            p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return p | {"mean": mean, "scale": scale}


def scores(texts: pa.Array, model: dict) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    for lo, hi, data, offsets in T.blocks(texts) if model else ():
        h, rows = encode(data, offsets)
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[lo:hi] = _forward((h - model["mean"]) / model["scale"], rows, first, np.diff(np.r_[first, len(rows)]), model)[-1]
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """The model of a sample of about per_class labelled rows of each class, none of them held out."""
    usable = labels.select("doc_id", F.col("quality").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), 4, 2))
    chosen = label_sample(usable, "label", per_class)
    got = sample_texts(docs, chosen, "label")
    return train(got.column("text").cast(pa.large_string()).combine_chunks(), got.column("label").to_numpy())


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """docs (doc_id, text) with score and predicted; every whole text is read once, without a shuffle."""

    def run(batches):
        for batch in batches:
            s = scores(T.column(batch, "text"), model)
            yield pa.RecordBatch.from_arrays([T.column(batch, "doc_id"), T.column(batch, "held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
