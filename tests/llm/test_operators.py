"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and
columns that clash with its own."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fabriloom.llm import decontamination, fingerprints, jaccard_join, language, licenses, mixing, quality, suffix_dedup, toxicity, warc
from fabriloom.llm import textops as T

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PLAIN = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, n long, token string, class string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    rng = random.Random(8)
    words = [a + b for a in "ba ce di fo gu ha ké lo mü na".split() for b in "ra se ti vo ny x".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    out = [None, "", " \t\n", "One", "one two", "Zwei, Wörter!", text(4), text(5), "ha " * 300, "ha " * 301, text(20000)]
    for _ in range(12):
        base = text(rng.randint(30, 300)).split()
        out.append(" ".join(base))
        out.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            for _ in range(rng.randint(1, 4)):
                near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near))
        out.append(text(20) + " " + passage + " " + text(30))
    out += ["Licensed under the Apache License, Version 2.0.", "x cc by-nc cc by nc y under the MIT license", "This work is licensed under the GNU General Public License, version 3."]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "a", "b") for i, t in corpus()]
    return spark.createDataFrame(rows + rows[3:4] + rows[20:21], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        assert out.setdefault(r["doc_id"], r) == r or "_id" in r
    return out


def test_jaccard_join(docs, empty):
    shingles = {}
    for i, t in corpus():
        w = PLAIN.findall(low(t))
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in shingles}
    for a in shingles:
        for b in shingles:
            x, y = shingles[a], shingles[b]
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    got = jaccard_join.components(docs)
    assert got.count() == docs.count()
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(got).items()} == {i: (len(s), root[i]) for i, s in shingles.items()}
    assert jaccard_join.components(empty).count() == 0
    # where names of sets collide, the same
    assert by_id(jaccard_join.components(docs, bits=3).drop("class")) == by_id(got.drop("class"))


def test_jaccard_join_of_hostile_texts(spark):
    # Thue-Morse words and their complements agree modulo 2^64 under every polynomial over bytes, or over blocks of 8 bytes
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    blocks = ["ccccccc" + "".join(f"{two[bin(k).count('1') % 2]}ccccccc" for k in range(n)) for n in (4, 256, 1024) for two in ("ab", "ba")]
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    # a large comp in several units, with a text that is similar to one of its members only
    base = [word() for _ in range(60)]
    rows = [thue[:1024], thue[1024:], thue, *blocks, *(" ".join([*base[:k % 7], word(), *base[k % 7 :]]) for k in range(200))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in (t.split() for t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if v == old else v for v in root]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(docs).collect()}
    assert got == dict(enumerate(root)) and len(set(root[:9])) == 9


@pytest.mark.parametrize(("many", "hot", "piece"), [(1000, 2000, 1 << 22), (2, 1000, 1 << 22), (2, 2, 1000)])
def test_suffix_dedup(docs, empty, many, hot, piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    n = {}
    for _, t in rows:
        for k in range(len(t) - 199):
            n[t[k : k + 200]] = n.get(t[k : k + 200], 0) + 1
    want, runs = {}, {}
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if n[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs[i], gone = int((gone[1:] < gone[:-1]).sum()), gone[:-1]
        want[i] = bytes(np.frombuffer(t, np.uint8)[~gone])
    got = suffix_dedup.removed(docs, piece=piece).collect()
    assert len(got) == docs.count()
    for r in got:
        t, kept = dict(rows)[r["doc_id"]], want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(t), len(t) - len(kept), hashlib.sha256(kept).hexdigest())
        assert r["n_spans"] == runs[r["doc_id"]]
    if many > 2:
        assert suffix_dedup.remove_repeats(empty).count() == suffix_dedup.removed(empty).count() == 0
        clash = docs.withColumns({c: F.lit(c) for c in ("spans", "text_key", "maybe", "phrase", "rows")})
        assert suffix_dedup.remove_repeats(clash).columns == clash.columns and suffix_dedup.remove_repeats(clash).where("spans = 'spans' and text_key = 'text_key'").count() == docs.count()
        assert {r["doc_id"]: r["text"] or "" for r in suffix_dedup.remove_repeats(docs).collect()} == {i: t.decode("utf-8", "ignore") for i, t in want.items()}


def test_decontamination(spark, docs, empty):
    texts = dict(corpus())
    items = [("10", " ".join(texts[11].split()[3:16])), ("2", texts[20].upper()), ("3", "ONE"), ("4", None), ("5", "!"), ("6", " ".join(texts[17].split()[-10:])), ("6", " ".join(texts[17].split()[-10:])), ("7", "nowhere at all")]
    table = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {}
    for i, t in texts.items():
        w, hit, found = WORD.findall(low(t)), set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in windows}:
                if own := windows.get(tuple(w[k : k + size])) if k + size <= len(w) else None:
                    hit |= set(range(k, k + size))
                    found |= own
        want[i] = (len(w), len(hit), sorted(found))
    got = decontamination.hits(docs, table)
    assert got.count() == docs.count()
    assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in by_id(got.drop("row_id")).items()} == want
    assert decontamination.hits(empty, table).count() == 0 and {r["n_hit"] for r in decontamination.hits(docs, table.limit(0)).collect()} == {0}


def test_licenses(docs, empty):
    got = by_id(licenses.scan(docs, licenses.word_idf(docs, licenses.vocabulary())))
    for i, t in corpus():
        w = WORD.findall(low(t))
        at = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert [got[len(corpus()) - k]["labels"] for k in (3, 1)] == ["apache-2", "gpl-3"]
    assert licenses.scan(empty, licenses.word_idf(empty, licenses.vocabulary())).count() == 0


def test_licenses_with_many_telling_words(spark):
    notices = [t for _, t, *_ in licenses.TEMPLATES]
    chance = " ".join("person charge copy files software source binary mozilla gnu creative attribution permission".split() * 40)
    rng = random.Random(4)
    texts = [notices[1] + " all rights reserved", *(f"{a} x {b} y {c}" for a, b, c in ((rng.choice(notices), rng.choice(notices), rng.choice(notices)) for _ in range(30)))]
    texts += [f"{chance} {t} {chance}" for t in notices] + [" ".join(notices), " ".join(rng.sample(chance.split(), 200))]
    # notices with some words changed
    texts += [" ".join(w if rng.random() > 0.1 else "zz" for w in t.split()) + " " + notices[8] for t in notices for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = licenses.word_idf(docs, licenses.vocabulary())
    got = by_id(licenses.scan(docs, idf))
    for i, text in enumerate(texts):
        w, want, best = text.split(), set(), 0.0
        for label, template, keys, others in licenses.TEMPLATES:
            parts = template.split()
            total = sum(idf[x] for x in parts if x in idf)
            first = [next(p for p in range(len(parts)) if parts[p : p + len(k.split())] == k.split()) for k in keys]
            for at in range(-len(parts), len(w)):
                here = lambda p: w[at + p] if 0 <= at + p < len(w) else None  # noqa: B023, E731
                other = any(w[max(0, at + min(first)) :][: len(o.split())] == o.split() for o in others)
                if not other and all(here(f + j) == x for f, k in zip(first, keys) for j, x in enumerate(k.split())):
                    held = sum(idf[x] for p, x in enumerate(parts) if x in idf and here(p) == x) / total
                    if held >= licenses.LEAST:
                        want.add(label)
                        best = max(best, held)
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == want | base, text
        assert abs(got[i]["score"] - (1.0 if base else min(1.0, best))) < 1e-9


def test_fingerprints(docs, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()))
    got = fingerprints.fingerprints(docs).collect()
    want = sorted((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][: len(t) // 4]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    texts, prints = dict(rows), {}
    for r in got:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.fingerprints(empty).count() == 0


def test_ranges_of_fingerprints_are_in_many_tasks(spark):
    docs = spark.range(12_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    rows = fingerprints.with_next(docs)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 5 * (fingerprints.RANGE + 60) and sum(sizes) == 12_020


def test_fingerprints_of_texts_outside_the_band(spark):
    rng = random.Random(9)
    common = [f"w{k}" for k in range(400)]
    base, tongue, other = ([f"{x}{k}" for k in range(100)] for x in "bto")
    texts = [" ".join(rng.choice(common) for _ in range(60)) for _ in range(1200)]
    for _ in range(600):  # a third of all rows are near copies, by words that others have
        near = list(base)
        for _ in range(2):
            near[rng.randrange(100)] = rng.choice(common)
        texts.append(" ".join(near))
    # texts of their own words, and near copies on both sides of THIN
    texts += [" ".join(tongue), " ".join(tongue[1:] + ["u"]), " ".join(other[:60] + common[:19]), " ".join(other[:60] + common[:21])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(texts)
    group = [got[i] for i in range(1200, 1799)]
    assert np.mean([r["near_next"] for r in group]) > 0.5 and np.mean([r["near_next"] > 0.2 for r in group]) > 0.95
    assert np.mean([r["near_edited"] for r in group]) > 0.2  # a quarter of the text is replaced
    assert got[1800]["near_next"] > 0.5 and got[1802]["near_next"] > 0.5
    assert np.mean([got[i]["near_next"] for i in range(1199)]) < 0.1 and got[1799]["near_next"] == got[1801]["near_next"] == 0


def test_warc(spark, tmp_path):
    trap = "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/", "a" + trap + "b"), (2, "u", trap), (3, "u\r\nX: y", None), (4, None, "x\r\n"), (5, "u", "a" + trap + "b"), (6, "u", trap[:4]), (7, "u", ""), (8, "u", "é" * 70000), (9, "u", "plain")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    warc.write_archive(df, f"{tmp_path}/warc")
    found = warc.captures(warc.read_records(spark, f"{tmp_path}/warc")).collect()
    page = {r["record_id"]: int(r["metadata"][0]["text"].split(":")[1]) for r in found}
    first = {}
    for i, _, html in pages:
        first.setdefault((html or "").encode(), i)
    assert len(found) == len(pages) and all(len(r["requests"]) == len(r["metadata"]) == 1 for r in found)
    for r in found:
        payload = (dict((i, h) for i, _, h in pages)[page[r["record_id"]]] or "").encode()
        assert r["response"]["digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if first[payload] == page[r["record_id"]]:
            assert r["response"]["warc_type"] == "response" and bytes(r["response"]["payload"]) == payload
        else:
            assert r["response"]["warc_type"] == "revisit" and page[r["response"]["refers_to"]] == first[payload]


def test_hashes_of_spans():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 6000).astype(np.uint8)
    start = rng.integers(0, 5800, 4000)
    end = start + rng.integers(0, 140, 4000)
    texts = [bytes(data[a:z]) for a, z in zip(start, end)]
    # equal bytes, and only they, have equal hashes, wherever they stand
    pairs = set(zip(texts, T.span_hashes(data, start, end).tolist()))
    assert len(pairs) == len(set(texts)) == len({h for _, h in pairs})
    moved = np.concatenate([data[:3], data])
    assert (T.span_hashes(moved, start + 3, end + 3) == T.span_hashes(data, start, end)).all()
    for width in (8, 13, 50, 200):
        runs = [bytes(data[k : k + width]) for k in range(len(data) - width + 1)]
        pairs = set(zip(runs, T.grams(data, width).tolist()))
        assert len(pairs) == len(set(runs)) == len({h for _, h in pairs})
    assert len(T.grams(data[:7], 8)) == 0
    assert not np.intersect1d(T.grams(data, 50), T.grams(data, 50, 1)).size


def test_second_triggers():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 99, 3000).astype(np.uint8))
    found = suffix_dedup.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    whole, pieces = {}, {}
    for first, last in zip(found["first"], found["last"]):
        body = text[first : last + 200]
        second, low, high = suffix_dedup.second_cuts(body, 200, 50)
        # every window of a phrase stands in one piece
        assert [k for a, z in zip(low, high) for k in range(a, z + 1)] == list(range(last - first + 1))
        for trigger, a, z in zip(second, low, high):
            for k in range(a, z + 1):
                grams = T.grams(np.frombuffer(body[k : k + 200], np.uint8), 50)
                assert trigger in grams and trigger >> np.uint64(28) == np.sort(grams >> np.uint64(28))[1]
                # and equal windows have equal second triggers
                assert pieces.setdefault(body[k : k + 200], trigger) == trigger
        whole[body] = True
    assert len(whole) > 10


def test_tiny_blocks():
    rng = np.random.default_rng(1)
    model = toxicity.train(pa.array(["a bad word here", "a good word here"] * 10), np.array([1, 0] * 10))
    for _ in range(300):
        texts = ["".join(rng.choice(list("ab é"), rng.integers(0, 9))) for _ in range(rng.integers(1, 4))]
        every = toxicity.scores(pa.array(texts), model)
        # a text's score doesn't depend on the block that it stands in
        assert np.allclose(every, [toxicity.scores(pa.array([t]), model)[0] for t in texts])
    for texts, labels in ((["", "!"], [1, 0]), (["abc", "xyz"], [1, 0])):
        assert toxicity.scores(pa.array(["abc", ""]), toxicity.train(pa.array(texts), np.array(labels))).tolist() == [0.5, 0.5]
    assert toxicity.scores(pa.array(["a", None]), toxicity.train(pa.array(["a"]), np.array([0]))).tolist() == [0, 0]


@pytest.mark.parametrize("n", range(2, 12))
def test_codewords_correct_a_bit(n):
    code = language.codewords(n)
    assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 3
    model = {"code": code, "trust": np.full(code.shape[1], 1 / code.shape[1])}
    for bit in range(code.shape[1]):
        margin = 2.0 * code
        margin[:, bit] *= -1
        assert (language.decode(margin, model).argmax(1) == np.arange(n)).all()


def test_classifiers_through_spark(spark, tmp_path):
    """The registered queries on a small folder with nulls, repeated rows and clashing columns; held-out rows are told apart."""
    import zlib

    rng = random.Random(3)
    word = lambda s: "".join(rng.choice(s) for _ in range(3))
    tongues = {"aa": ["ra", "ti", "no"], "bb": ["kö", "mi", "zu"], "cc": ["sha", "lee", "wo"]}
    rows, marks = [], []
    for i in range(900):
        lang, toxic, good = list(tongues)[i % 3], i % 5 == 0, i % 2
        own = [word(tongues[lang]) for _ in range(40)]
        if toxic:
            own[rng.randrange(40)] = rng.choice(["xkqwzert", "xkqwzerts"])
        rows.append((i, " ".join(own) if good else "!! ## ".join(own), lang if i % 4 else None, "s", 1, 1.0, "und"))
        marks.append((i, good, int(toxic)))
    rows += [(900, None, "aa", None, 1, 1.0, "x"), (901, "", "aa", None, 1, 1.0, "x"), (None, "ratino", None, None, 1, 1.0, "x"), rows[7], (902, "12 !", "bb", "s", 1, 1.0, "x")]
    marks += [(900, 1, 0), (901, None, None), (None, 1, 1), marks[7]]
    full, none = f"{tmp_path}/full", f"{tmp_path}/none"
    schemas = {"documents": "doc_id long, text string, lang string, source string, label int, score double, draw string", "labels": "doc_id long, quality int, toxic int"}
    for name, data in (("documents", rows), ("labels", marks)):
        df = spark.createDataFrame(data, schemas[name])
        df.repartition(3).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{none}/{name}.parquet")
    held = lambda i, mod, left: i is None or zlib.crc32(str(i).encode()) % mod == left
    truth = {i: (q, t) for i, q, t in marks}
    for query, mod, left, least, place in ((toxicity.op3_toxicity, 5, 0, 0.5, 1), (quality.op6_quality, 4, 2, 0.7, 0)):
        got = query(spark, full).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(r["held_out"] == held(r["doc_id"], mod, left) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in got)
        assert np.mean([r["predicted"] == truth[r["doc_id"]][place] for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]) > 0.95
        assert query(spark, none).count() == 0
    got = language.op4_language(spark, full).collect()
    assert len(got) == len(rows) and all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == list(tongues)[r["doc_id"] % 3] for r in got if r["doc_id"] is not None and r["doc_id"] < 900]) > 0.98
    assert {r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)} == {"und"}
    assert language.op4_language(spark, none).count() == 0


def test_registered_queries(spark, docs, tmp_path):
    """Every opN query runs on a small folder and keeps the rows; what SQL can express is compared with it elsewhere."""
    from fabriloom.llm.queries import QUERIES

    plain_docs = docs.select("doc_id", "text", F.lit("aa").alias("lang"), F.lit("web").alias("source"), F.length("text").alias("n_chars"))
    plain_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", dict(corpus())[20])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "v", None), (4, "v", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(20)] + [(20, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    counts = {"op2_warc": 4, "op12_whitening": 40, "embedding_deviations": 40}
    for name, query in QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == counts.get(name, docs.count()), name
        if name == "op2_warc":
            digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
            assert sorted(tuple(r) for r in rows) == [(1, 1, digest(b"x"), "response", None), (2, 1, digest(b"x"), "revisit", 1), (3, 0, digest(b""), "response", None), (4, 0, digest(b""), "revisit", 3)]


def test_mixing_goes_by_text(spark):
    rows = [(None, "one two", 5), (None, "one two " * 25, 6), (3, "a b", 7), (3, "c " * 40, 8), (4, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mix_id int").withColumn("text_key", F.lit("k"))
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels)
    assert out.columns[:4] == docs.columns and {r["mix_id"]: r["n_tokens"] for r in out.collect()} == {5: 2, 6: 50, 7: 2, 8: 40, 9: 0}


def test_classifiers():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ra", "ti", "no", "el", "us"]) for _ in range(3))
    texts, toxic = [], []
    for k in range(300):
        own = [word() for _ in range(40)]
        if k % 3 == 0:
            own[rng.randrange(40)] = rng.choice(["xkqwzert", "xkqwzerts", "xkqwzex"])
        texts.append(" ".join(own))
        toxic.append(int(k % 3 == 0))
    model = toxicity.train(pa.array(texts[:200]), np.array(toxic[:200]))
    assert ((toxicity.scores(pa.array(texts[200:]), model) >= 0.5) == np.array(toxic[200:])).mean() > 0.9
    assert toxicity.scores(pa.array(["", None]), model).shape == (2,)
    assert toxicity.scores(pa.array(["a"]), toxicity.train(pa.array(["a"]), np.array([0]))).max() < 1e-9
    model = quality.train(pa.array(texts[:100] + [t.replace(" ", "!! ## ").upper() for t in texts[:100]]), np.array([1] * 100 + [0] * 100))
    assert (quality.scores(pa.array(texts[100:150]), model) > 0.7).all() and (quality.scores(pa.array([t.upper().replace(" ", "!! ## ") for t in texts[100:150]]), model) < 0.5).all()
    assert quality.scores(pa.array(["", None, " "]), model).shape == (3,) and quality.scores(pa.array(["a"]), {}).tolist() == [0.5]
    other = ["".join(rng.choice(["ka", "mö", "yi"]) for _ in range(12)) for _ in range(100)]
    model = language.train(pa.array(texts[:100] + other), ["x"] * 100 + ["y"] * 100)
    names, scores, _ = language.predict(pa.array([texts[150], "mökayi kakamö", "", None, "12 3"]), model)
    assert [str(n) for n in names] == ["x", "y", "und", "und", "und"] and scores[2:].max() == 0
    assert language.predict(pa.array(["a"]), language.train(pa.array([], pa.string()), []))[0] == ["und"]


def test_mixing(spark, docs, empty):
    rng, kinds = random.Random(6), ["alpha beta gamma", "delta epsilon", "zeta eta theta"]
    rows = [(i, " ".join(rng.choice((kinds[i % 3] + " common words").split()) for _ in range(rng.randint(5, 60))), 1, "a", "b") for i in range(90)]
    rows += [(90, None, 1, "a", "b"), (91, "", 1, "a", "b"), (None, "alpha", 1, "a", "b"), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    n = F.col("n_tokens")
    total = out.agg(*(F.sum(n * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in mixing.TARGETS), F.sum(n).alias("n")).first()
    assert all(abs(total[d] / total["n"] - share) < 0.03 for d, share in mixing.TARGETS.items())
    assert out.where("rate < 0").count() == 0
    # the same descent in numpy
    scored = [((r["n_tokens"]), np.array(r["p"])) for r in mixing.rates(docs, labels)[0].collect()]
    tokens, p = np.array([x for x, _ in scored]), np.array([x for _, x in scored])
    steps = mixing.fit(spark.createDataFrame([(int(a), [float(y) for y in b]) for a, b in scored], "n_tokens long, p array<double>"), mixing.TARGETS)
    rate = np.ones(len(tokens))
    for s in steps:
        rate = np.maximum(0, rate - p @ np.array(s))
    assert np.abs((rate * tokens) @ p / tokens.sum() - np.array(list(mixing.TARGETS.values()))).max() < 0.03
    assert mixing.mix(empty, labels).count() == 0 and mixing.mix(docs, labels.limit(0)).count() == docs.count()


@pytest.mark.parametrize("shares", [(0.4, 0.5, 0.1), (0.1, 0.3, 0.6), (0.01, 0.01, 0.98), (0.5, 0.5, 0)])
def test_mixing_converges_under_bounds(spark, shares):
    rng = np.random.default_rng(3)
    kind = rng.choice(3, 600, p=shares)
    p = np.exp(1.5 * (rng.normal(size=(600, 3)) + 3 * np.eye(3)[kind]))
    p[:, 2] *= shares[2] > 0  # with no share, a domain that no document may belong to
    p /= p.sum(1, keepdims=True)
    tokens = rng.integers(1, 500, 600)
    mass, target = tokens / tokens.sum(), np.array(list(mixing.TARGETS.values()))
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(tokens, p)], "n_tokens long, p array<double>")
    rate = np.ones(600)
    for s in mixing.fit(table, mixing.TARGETS):
        rate = np.maximum(0, rate - p @ np.array(s))
    # accelerated projected gradient with restart, run on until it stands
    pace, want, look, t = 1 / np.linalg.eigvalsh((p.T * mass) @ p)[-1], np.ones(600), np.ones(600), 1.0
    for _ in range(100_000):
        new = np.maximum(0, look - pace * p @ ((look * mass) @ p - target))
        if (look - new) @ (mass * (new - want)) > 0:
            t = 1.0
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look, want = new + (before - 1) / t * (new - want), new
    assert (rate >= 0).all() and np.abs((rate * mass) @ p - (want * mass) @ p).max() < 1e-3
    steps, residual = mixing.solve(table, mixing.TARGETS)
    assert np.abs(residual - ((rate * mass) @ p - target)).max() < 1e-6


def similar_groups(texts):
    """For each text the least index of its group of similar texts; None if it has no words."""
    words = [PLAIN.findall(low(t)) for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} - {()}) for w in words]
    root = [i if x else None for i, x in enumerate(sets)]
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and root[a] != root[b] and 100 * len(x & y) >= 75 * len(x | y):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if v == old else v for v in root]
    return root


def without_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    n = {}
    for t in raw:
        for k in range(len(t) - 199):
            n[t[k : k + 200]] = n.get(t[k : k + 200], 0) + 1
    out = []
    for t in raw:
        kept = np.ones(len(t), bool)
        for k in range(len(t) - 199):
            if n[t[k : k + 200]] > 1:
                kept[k : k + 200] = False
        out.append(np.frombuffer(t, np.uint8)[kept].tobytes().decode("utf-8", "ignore"))
    return out


def benchmark_hit(text, windows):
    w = WORD.findall(low(text))
    return any(tuple(w[k : k + size]) in windows for size in {len(x) for x in windows} for k in range(len(w) - size + 1))


def listed(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_pipeline(spark, tmp_path, clash):
    """Every stage against brute force on its own input. With clash, ids repeat and are null, columns hold nulls and are
    named like columns of the stages."""
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{source}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    windows = set()
    for w in (WORD.findall(low(t)) for t in items):
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} - {()}
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, two, passage = text(60), text(60), text(50)
    item = max(items, key=lambda t: len(t or ""))
    extra = [(1, one), (1, two), (None, one), (None, one + " end"), (2, f"{text(20)} {item} {text(20)}"), (2, text(30)), (None, f"{text(20)} {item}"), (3, None), (3, ""), (None, None), (None, " "), (5, two), (6, f"{text(9)} {passage} {text(9)}"), (6, f"{text(9)} {passage}"), (7, text(40)), (7, text(40))]
    if not clash:
        top = before.agg(F.max("doc_id")).first()[0]
        extra = [(top + 1 + k, t) for k, (_, t) in enumerate(extra)]
    added = spark.createDataFrame([(i, t, None, None, None) for i, t in extra], before.schema)
    docs = before.unionByName(added)
    if clash:
        docs = docs.withColumns({n: F.lit(n) for n in ("row", "spans", "text_key", "component_id", "class", "key")})
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents")
    docs, columns, model = spark.read.parquet(f"{tmp_path}/documents"), docs.columns, None
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, source).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        old, new = ([tuple(r[c] for c in columns) for r in df.collect()] for df in (docs, out))
        at = columns.index("text")
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{source}/labels.parquet"))
            assert listed(new) == listed(r for r in old if toxicity.scores(pa.array([r[at]], pa.large_string()), model)[0] < 0.5)
        elif name == "near_duplicates":
            groups = {}
            for r, g in zip(old, similar_groups([r[at] for r in old]), strict=True):
                groups.setdefault(g, []).append(r)
            alone, left = groups.pop(None), list(new)
            assert len(new) == len(alone) + len(groups)
            for rows in groups.values():
                own = [r for r in rows if r in left] if clash else [min(rows, key=lambda r: r[0])]
                assert own and (clash or own[0] in left)
                left.remove(own[0])
            assert listed(left) == listed(alone)
        elif name == "repeated_passages":
            kept = [(r, t) for r, t in zip(old, without_repeats([r[at] for r in old]), strict=True) if t or not r[at]]
            want = [tuple(r[c] if n not in ("text", "n_chars") or not r[at] else t if n == "text" else len(t) for c, n in enumerate(columns)) for r, t in kept]
            assert listed(new) == listed(want) and any(r[at] != t for r, t in kept if r[at])
        elif name == "decontamination":
            assert listed(new) == listed(r for r in old if not benchmark_hit(r[at], windows)) and len(new) < len(old)
        else:
            assert listed(new) == listed(old) and out.where("rate is null or rate < 0").isEmpty()
        assert out.columns[: len(columns)] == columns and (out.columns == columns or name == "mixing")
        docs = out


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, source).isEmpty()
