"""Language identification by error-correcting output codes.

Every learned language gets a binary codeword, any two of them at least three bits apart, so that one wrong bit is
corrected; for each bit a logistic classifier over hashed 1- to 4-byte n-grams learns whether the language of a text has
that bit. Two or three languages don't have so many different bits: there a bit is asked several times, each time of a
classifier that sees other n-grams (as do all: each a random three quarters of them), so that they err apart. A text is decoded to the language whose codeword has the
least loss against the margins of all bits, each bit weighted by how well it did in training. When the runner-up
is nearly as close, the answer is flagged as ambiguous.

Defined results: null, empty and letterless texts are `und` with score 0 and are not ambiguous; with no labelled
text at all every text is `und`; with a single learned language that is the answer; a null doc_id counts as held
out; repeated rows are answered each; extra columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.llm import textops as T
from fabriloom.llm.common import held_out, label_sample, sample_texts, small_batches

#: log2 of the n-gram buckets; labelled texts of each language to learn from, and of all together; languages that codewords are
#: made for (a table of lang with more values learns the most frequent); largest margin gap called ambiguous.
BITS, PER_LANGUAGE, TEXTS, LANGUAGES, AMBIGUOUS = 12, 600, 38_400, 2_000, 0.1
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def codewords(n: int, longest: int = 15, draws: int = 200, seed: int = 11) -> np.ndarray:
    """n rows of -1/+1. Up to seven languages have all ways to split them in two (the exhaustive code), or the best draw of
    `longest` of them; more have the best draw of random columns. Columns repeat only where there are under 6 different ones."""
    if n < 2:
        return np.ones((n, 1), int)
    rng = np.random.default_rng(seed)
    every = np.array([[1 if (k >> r) & 1 else -1 for r in range(n)] for k in range(1, 1 << (n - 1))]).T if n <= 7 else None
    if every is not None and every.shape[1] <= longest:
        return np.tile(every, (1, -(-6 // every.shape[1])))
    size = longest if n <= 7 else max(longest, 5 * (n - 1).bit_length())
    best, least = None, -1
    for _ in range(draws if n <= 200 else 5):
        code = every[:, rng.choice(every.shape[1], size, replace=False)] if n <= 7 else rng.choice((-1, 1), (n, size))
        apart = int(((size - code.astype(np.float32) @ code.T) / 2 + size * np.eye(n)).min())
        if apart > least and (np.abs(code.sum(0)) < n).all():
            best, least = code, apart
    return best


def histograms(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each row the square roots of its n-gram bucket counts, scaled to length 1."""
    n, size = len(offsets) - 1, 1 << bits
    low = T.LOWER[data]
    low = np.where(T.ALNUM[low] & ~((low >= 48) & (low < 58)), low, np.uint8(32)).astype(np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    out, packed = np.zeros(n * size), low
    for k in range(1, 5):
        if k > 1:
            packed = packed[: max(0, len(low) - k + 1)] | (low[k - 1 :] << np.uint64(8 * k - 8))
        own = row[: len(packed)]
        keep = (own == row[k - 1 :]) & (packed != np.uint64(0x20202020 & ((1 << 8 * k) - 1)))
        bucket = ((packed + np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        out += np.bincount(own[keep] * size + bucket[keep].astype(np.int64), minlength=n * size)
    out = np.sqrt(out.reshape(n, size))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def train(texts: pa.Array, langs: list[str], bits: int = BITS, rounds: int = 150) -> dict:
    names = sorted(set(langs))
    if not names:
        return {"names": [], "bits": bits}
    code = codewords(len(names))
    x = np.concatenate([histograms(data, offsets, bits) for _, _, data, offsets in T.blocks(texts)])
    place = np.array([names.index(v) for v in langs])
    y = code[place]
    weight = 1 / np.bincount(place, minlength=len(names))[place]
    weight /= weight.sum()
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    sees = np.random.default_rng(13).random(w.shape) < 0.75
    v_w, v_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        slope = -y / (1 + np.exp(np.clip(y * (x @ w + b), -50, 50))) * weight[:, None]
        v_w = 0.9 * v_w - 4.0 * (x.T @ slope + 1e-5 * w) * sees
        v_b = 0.9 * v_b - 1.0 * slope.sum(0)
        w, b = w + v_w, b + v_b
    right = ((np.sign(x @ w + b) == y) * weight[:, None]).sum(0)
    trust = np.maximum(right - 0.5, 0.01)
    return {"names": names, "bits": bits, "w": w.astype(np.float32), "b": b, "code": code, "trust": trust / trust.sum()}


def decode(margin: np.ndarray, model: dict) -> np.ndarray:
    """Each language's share of the answer, for margins (a row for each text, a column for each bit): the less loss of its
    codeword, weighted by how far each bit is trusted, the more."""
    loss = (np.log1p(np.exp(-np.clip(margin[:, None, :] * model["code"][None], -50, 50))) * model["trust"]).sum(2)
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    return p / p.sum(1, keepdims=True)


def predict(texts: pa.Array, model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of each text."""
    langs, score, ambiguous = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if not model["names"]:
        return langs, score, ambiguous
    for lo, _, data, offsets in T.blocks(texts, 1 << 18):
        p = decode(histograms(data, offsets, model["bits"]) @ model["w"] + model["b"], model)
        near = np.sort(p, 1)
        letters = np.r_[0, np.cumsum(_ASCII_LETTER[data])][offsets]
        for i, best in enumerate(p.argmax(1)):
            a, z = offsets[i], offsets[i + 1]
            if letters[i + 1] > letters[i] or z > a and _LETTER.search(data[a:z].tobytes().decode()):
                langs[lo + i], score[lo + i] = model["names"][best], p[i, best]
                ambiguous[lo + i] = len(model["names"]) > 1 and near[i, -1] - near[i, -2] < AMBIGUOUS
    return langs, score, ambiguous


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model of about per_language texts of each language (of TEXTS in all, if there are more than 64 languages), none of
    them held out. Texts are whole; of the drawn ones as many are taken, in the order of a hash, as sample_texts() has
    bytes for."""
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    got = sample_texts(usable, label_sample(usable, "lang", per_language, classes=LANGUAGES, total=TEXTS).select("doc_id", "lang").distinct(), "lang", ("doc_id", "lang"))
    return train(got.column("text").cast(pa.large_string()).combine_chunks(), got.column("lang").to_pylist())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) with lang_pred, score and ambiguous; every whole text is read once, without a shuffle."""

    def run(batches):
        for batch in batches:
            langs, score, ambiguous = predict(T.column(batch, "text"), model)
            yield pa.RecordBatch.from_arrays([T.column(batch, "doc_id"), T.column(batch, "held_out"), pa.array(langs, pa.string()), pa.array(score), pa.array(ambiguous)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
