"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fabriloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The levels over nodes, lowest first, up to the one that has a single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((run[: i % 16], run[i % 16 + 1 :]))
        i //= 16
    return out


def brute(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([leaf(r) for r in by[s]]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (s, t) in enumerate(zip(names, trees)):
        for i, r in enumerate(by[s]):
            path = beside(t, i) + beside(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if bad else leaf(r)
            for a, b in path:
                node = h(*a, node, *b)
            out.append((r[0], leaf(r), t[-1][0], top[-1][0], h(*(x for a, b in path for x in (*a, *b))), node, node == top[-1][0]))
    return out


def query(spark, tmp_path, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return merkle.op11_merkle(spark, str(tmp_path))


def key(rows):
    return sorted(map(repr, rows))


def test_against_plain_trees(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 300 + [None, "one", "twö", ""] * 9), rng.choice([None, "de"]), rng.choice([None, 7]), rng.choice([None, "", "plain", "With CAPITALS Ä", "x" * 50_000])) for i in range(700)]
    rows += [(3, "single", "de", 1, "Alone"), *[(9, "hot", "de", 7, "Same")] * 40, *[(None, "hot", None, None, None)] * 3]
    # seventeen: a run of sixteen and one of one
    rows += [(1000 + i, "seventeen", None, i, "T") for i in range(17)] + [(2000 + i, f"s{i:03d}", None, i, "U") for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"src": F.lit(1), "hash": F.lit("x"), "idx": F.lit(2), "run": F.lit(3)}).repartition(5)
    got = query(spark, tmp_path, df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert key(map(tuple, got.collect())) == key(brute(rows))


@pytest.mark.parametrize("n", [0, 1, 16])
def test_small_tables(spark, tmp_path, n):
    rows = [(i, "a", None, 1, "Text") for i in range(n)]
    assert key(map(tuple, query(spark, tmp_path, spark.createDataFrame(rows, SCHEMA)).collect())) == key(brute(rows))


def test_manifest_finds_what_was_changed(spark):
    rows = [(i, f"s{i % 3}", "de", i, f"Text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(docs, F.when(F.col("doc_id") == 42, "forged").otherwise(F.col("text")))
    proofs = found.proofs().withColumn("now", merkle.folded(F.coalesce("altered", "leaf"), F.col("path")))
    assert [r["doc_id"] for r in proofs.where(F.col("now") != found.root).collect()] == [42]
    assert found.sources.count() == 3 and merkle.manifest(docs.where("doc_id <> 5")).root != found.root == merkle.manifest(docs.repartition(7)).root
