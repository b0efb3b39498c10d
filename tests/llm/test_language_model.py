"""Elias-Fano sequences and tries against plain searches; the language model against counts in plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fabriloom.llm import language_model as lm
from fabriloom.llm.elias_fano import Sequence, Trie


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=90), st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=40))
def test_sequence(values, queries):
    v = np.array(sorted(values), np.uint64)
    s = Sequence.of(v)
    assert (s.get(np.arange(len(v))) == v).all()
    q = np.array(queries + values, np.uint64)
    at, equal = s.successor(q)
    assert (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()


def test_sequence_is_compact():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 200_000, dtype=np.uint64))
    s = Sequence.of(v)
    assert 8 * sum(a.nbytes for a in s.parts().values()) / len(v) < 40 - math.log2(len(v)) + 6
    assert (s.successor(v)[0] == np.searchsorted(v, v)).all()


@pytest.mark.parametrize("n", [0, 1, 500])
def test_trie_file(tmp_path, n):
    rng = random.Random(n)
    grams = sorted({(rng.randrange(40), rng.randrange(60)) for _ in range(n)})
    words = sorted({a for a, _ in grams})
    vocabulary = sorted({b for _, b in grams})
    parent, word = np.array([words.index(a) for a, _ in grams], np.int64), np.array([vocabulary.index(b) for _, b in grams], np.int64)
    codes = np.arange(len(grams), dtype=np.uint16)[None]
    Trie.of(np.array(words, np.uint64), np.array(words, np.int64), np.array(vocabulary, np.uint64), [(parent, word, codes)]).save(f"{tmp_path}/t")
    trie = Trie.open(f"{tmp_path}/t")
    ask = [(a, b) for a in range(45) for b in range(65)]
    at, there = trie.root(np.array([a for a, _ in ask], np.uint64))
    ident, listed = trie.vocabulary.successor(np.array([b for _, b in ask], np.uint64))
    where, hit = trie.child(0, at, ident, there & listed)
    assert [g for g, h in zip(ask, hit) if h] == grams
    assert [int(trie.levels[0][2][0][i]) for i, h in zip(where, hit) if h] == list(range(len(grams)))


def brute(rows, learn, order, prior):
    texts = [[*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    grams = [Counter() for _ in range(order)]
    for t, yes in zip(texts, learn):
        for k in range(order if yes else 0):
            full = ["<", *t]
            grams[k].update(tuple(full[i : i + k + 1]) for i in range(len(full) - k))
    words = {g: c for g, c in grams[0].items() if g != ("<",)}
    total, distinct = sum(words.values()), len(words)
    rounded = lambda p: float(lm.decoded(lm.coded(np.array([p])))[0])
    out = []
    for t in texts:
        full, base, score = ["<", *t], 0.0, 0.0
        for i in range(1, len(full)):
            one = p = (grams[0][full[i],] + 1) / (total + distinct + 1)
            for k in range(1, order):
                if i - k >= 0:
                    context, gram = tuple(full[i - k : i]), tuple(full[i - k : i + 1])
                    c = grams[k - 1][context]
                    b = prior / (c + prior)
                    p = rounded(grams[k][gram] / (c + prior)) + (b if k == 1 or not c else rounded(b)) * p
            base, score = base + math.log10(one), score + math.log10(p)
        out.append((len(t), sum(grams[0][w,] > 0 for w in t), total, base, score))
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "The", "ä", "ÄB", "x-1", "ab"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words if rng.random() < 0.6 else ["the", "of"]) for _ in range(rng.choice([0, 1, 2, 9, 60])))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "the " * 4000), (None, "the null id"), (5, rows[5][1]), (5, "other text of one id")]


@pytest.mark.parametrize(("order", "block", "shard"), [(2, 2_500_000, 1_000_000), (2, 300, 200), (3, 500, 900), (3, 10_000, 150)])
def test_against_plain_counts(spark, order, block, shard, monkeypatch):
    monkeypatch.setattr(lm, "THIN", 16)
    rows = corpus(order + block)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"learn": F.lit("x"), "block": F.lit(1), "shard": F.lit(2)}).repartition(4)
    got = lm.score(df, F.col("doc_id") % 3 != 0, order=order, prior=8.0, block=block, shard=shard).collect()
    want = brute(rows, [i is not None and i % 3 != 0 for i, _ in rows], order, 8.0)
    key = lambda r: (str(r[0]), r[1:4], round(r[5], 6))
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], 0, r["base_score"], r["score"]) for r in got), key=key)
    theirs = sorted(((i, *w[:3], 0, *w[3:]) for (i, _), w in zip(rows, want)), key=key)
    assert [m[:5] for m in mine] == [t[:5] for t in theirs]
    assert np.allclose([m[5:] for m in mine], [t[5:] for t in theirs], rtol=1e-9)


def test_codes_round_down():
    """So that a context's stored probabilities and the weight left to shorter contexts never sum to more than 1."""
    p = np.r_[10.0 ** -np.arange(12.0), np.random.default_rng(2).random(500)]
    kept = lm.decoded(lm.coded(p))
    assert (kept <= p * (1 + 1e-12)).all() and (kept > p * 0.978).all() and lm.coded(np.zeros(1))[0] == 0


@pytest.mark.parametrize("rows", [[], [(2, None)], [(9, "only held out")]])
def test_odd_tables(spark, rows):
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()
    assert [(r["doc_id"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(i, 0, 0, 0.0, 0.0) for i, _ in rows]


def test_query(spark, tmp_path):
    rows = corpus(11)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op13_language_model(spark, str(tmp_path)).collect()
    learn = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    want = brute(rows, learn, lm.ORDER, lm.PRIOR)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in got) == sorted((str(i), not yes, *w[:2], round(w[4], 6)) for (i, _), yes, w in zip(rows, learn, want))
