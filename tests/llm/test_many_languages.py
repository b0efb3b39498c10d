"""More languages than a byte of code tells apart."""

import random

import pytest

from fabriloom.llm import language


@pytest.mark.parametrize("n", [8, 70, 300])
def test_codewords_differ_by_three_bits(n):
    code = language.codewords(n)
    assert min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) >= 3


def test_seventy_languages(spark):
    rng = random.Random(4)
    sounds = [[f"{a}{b}" for a, b in zip(rng.sample("bcdfghjklmnprstvwz", 9), rng.choices(["a", "e", "ei", "o", "u", "ya", "ö", "î"], k=9))] for _ in range(70)]
    text = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(40))
    rows = [(i, text(sounds[i % 70]), f"l{i % 70:02d}") for i in range(70 * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model["names"]) == 70
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    held = [(got[i]["lang_pred"] == lang, lang) for i, _, lang in rows if got[i]["held_out"]]
    assert sum(ok for ok, _ in held) / len(held) > 0.97
    assert {lang for ok, lang in held if ok} == {f"l{k:02d}" for k in range(70)}
