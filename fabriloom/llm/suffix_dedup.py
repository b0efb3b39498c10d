"""Removal of long repeated passages by prefix-free parsing.

Rolling-hash triggers cut every text into phrases that overlap by length - 1 bytes, so every string of `length`
bytes (a window) lies whole in exactly one phrase. The trigger of a window is its 50-byte gram of least hash (long enough
that unrelated texts hardly share one): a choice by content alone, so equal windows have equal triggers at equal places
wherever they stand. The distinct phrases are the dictionary, each text's phrases the parse.

The corpus order of all windows comes from two suffix arrays, both cut at the depth of a window. That of the parse needs one
phrase: as a phrase is no shorter than a window, parse suffixes that begin with the same phrase already agree in all of its
windows, so the parse is grouped by its phrases, and a phrase parsed twice repeats every window at the cost of one row.
That of the dictionary orders the phrases' suffixes: its phrases are dealt to tasks by trigger (suffixes that begin with
the same window have the same trigger), each task builds the suffix array of its part by prefix doubling over the real
bytes, and suffixes next to one another that agree to the depth of a window are places where different phrases repeat.
Phrases whose trigger nothing shares are alone at their places in that order and are left out of it.

A trigger of more than MANY phrases would fill a task, so its phrases are parsed once more, by the gram that is least
after the trigger (equal windows agree on that one too): the shorter phrases are counted like the first ones, and
those of one second trigger are a part of the dictionary with a suffix array of its own. Should more than HOT different ones
share even that, Spark groups their suffixes by 128-bit identities, combined before the shuffle.

Texts go by content: copies have the same phrases, so the spans of a text are worked out once. Phrases and texts are
identified by 128 bits. Texts of many megabytes are parsed in overlapping pieces.

Defined results: a null text is empty; texts shorter than `length` keep everything; copies of long enough
texts lose everything, as do repeated rows; a null doc_id is kept as null; extra columns, whatever their names, are ignored
by the query and kept by remove_repeats(). A span may cut a UTF-8 sequence; n_removed and kept_sha256 are about bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabriloom.llm import textops as T
from fabriloom.llm.common import BitMap, Seen, bit_map, discard, fresh, small_batches, stage

#: Bytes of a string whose repetition is removed; bytes of a trigger; phrases of a trigger beyond which they are parsed by a
#: second one; phrases of both beyond which Spark groups their suffixes (up to there a task holds 7 MB of them at most); bytes
#: of a text that are parsed at once.
LENGTH, GRAM, MANY, HOT, PIECE = 200, 50, 1_000, 20_000, 1 << 22
#: What identifies a phrase, and a text.
PHRASE, TEXT = ["phrase", "check"], ["text_key", "text_check"]
_PLACE = np.uint64((1 << 28) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from those of two shorter runs."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = np.minimum(x[:-step], x[step:]), have + step
    return x


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict:
    """The phrases of the rows of a block: trigger hash, both halves of the phrase's identity, row, first and last window
    start in the block."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return {n: none.view(np.uint64) for n in ("trigger", *PHRASE)} | {n: none for n in ("row", "first", "last")}
    grams = T.grams(data, gram)
    # equal hashes count as equal grams, of which the leftmost is taken: that is the same in equal windows
    lowest = _sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    new = np.r_[True, lowest[1:] != lowest[:-1]]
    new[offsets[offsets < len(new)]] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(offsets, first, "right") - 1
    end = offsets[row + 1] - length  # windows from here on would cross into the next row
    last = np.minimum(np.r_[first[1:], len(new)] - 1, end)
    whole = first <= end
    first, last, row = first[whole], last[whole], row[whole]
    phrase = T.digests(data, first, last + length)
    return {"trigger": grams[(lowest[first] & _PLACE).astype(np.int64)], "phrase": phrase[:, 0], "check": phrase[:, 1], "row": row, "first": first, "last": last}


def parsed(text: pa.Array, length: int, piece: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, dict]]:
    """(first row, its block's bytes and offsets, the byte of the block where the phrases' positions begin, phrases). A text
    longer than a piece is cut between windows; where that splits a phrase, its parts still share its trigger."""
    for lo, _, data, offsets in T.blocks(text, min(1 << 18, piece)):
        if len(data) <= piece:
            yield lo, data, offsets, 0, phrases(data, offsets, length)
        else:
            for base in range(0, len(data) - length + 1, piece):
                part = data[base : base + piece + length - 1]
                yield lo, data, offsets, base, phrases(part, np.array([0, len(part)]), length)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def dictionary(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(trigger, phrase, check, n): the distinct phrases and how often they are parsed. One task sends each phrase of a block
    once."""

    def run(batches):
        for batch in batches:
            for *_, p in parsed(T.column(batch, "text"), length, piece):
                if len(p["phrase"]):
                    _, at, n = np.unique(p["phrase"], return_index=True, return_counts=True)
                    yield _batch(**{c: _longs(p[c][at]) for c in ("trigger", *PHRASE)}, n=pa.array(n))

    return docs.select("text").mapInArrow(run, "trigger long, phrase long, check long, n long").groupBy("trigger", *PHRASE).agg(F.sum("n").alias("n"))


def shared_phrases(docs: DataFrame, shared: BitMap, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(trigger, phrase, check, body): the bytes of each phrase whose trigger passes, once."""

    def run(batches):
        seen = Seen()
        for batch in batches:
            for _, data, _, base, p in parsed(T.column(batch, "text"), length, piece):
                hit = np.flatnonzero(shared.hit(p["trigger"]))
                _, own = np.unique(p["phrase"][hit], return_index=True)
                hit = hit[own]
                hit = hit[seen.new(p["phrase"][hit])]
                if len(hit):
                    body = [data[a:z].tobytes() for a, z in zip(base + p["first"][hit], base + p["last"][hit] + length)]
                    yield _batch(**{c: _longs(p[c][hit]) for c in ("trigger", *PHRASE)}, body=pa.array(body, pa.binary()))

    return docs.select("text").mapInArrow(run, "trigger long, phrase long, check long, body binary").groupBy("trigger", *PHRASE).agg(F.first("body").alias("body"))


def _suffixes(body: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, index of the phrase, place in it, place in the bytes) of every suffix of some phrases that holds a window."""
    size = np.array([len(x) for x in body], np.int64)
    many = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(body)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.frombuffer(b"".join(body), np.uint8), owner, place, (np.cumsum(size) - size)[owner] + place


def suffix_array(data: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data at start, each of depth bytes (8 or more) at least, in the order of their first depth bytes: their
    indexes in that order, and whether each agrees with the one before it to that depth. Ranks by 8 bytes are
    doubled: the order to 2 d bytes is that of the ranks to d bytes at a place and d further on."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at, d = np.ndarray((len(data) - 7,), ">u8", padded, strides=(1,)).astype(np.uint64), 8
    at = np.unique(at, return_inverse=True)[1]
    while d < depth:
        step = min(d, depth - d)
        pair = at[: len(at) - step] * (int(at.max()) + 1) + at[step:]
        at = np.unique(pair, return_inverse=True)[1]
        d += step
    rank = at[start]
    order = np.argsort(rank, kind="stable")
    return order, np.r_[False, rank[order][1:] == rank[order][:-1]]


def _runs(table: pa.Table, owner: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """(phrase, check, first place, last place) of runs of neighbouring windows; owner and place are in order."""
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]) if len(owner) else np.zeros(0, np.int64)
    end = np.r_[new[1:], len(owner)] - 1 if len(new) else new
    return _batch(**{c: pa.array(table.column(c).to_numpy()[owner[new]]) for c in PHRASE}, a=pa.array(place[new]), z=pa.array(place[end]))


def compare(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(phrase, check, a, z): places of windows that another phrase also has, by the suffix arrays of the parts of the dictionary. All
    phrases of a trigger come one after another, so memory holds a batch and one trigger's phrases."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            trigger = T.column(batch, "trigger").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(trigger, trigger[-1]))
            if cut or held and T.column(held[-1], "trigger")[-1].as_py() != trigger[0]:
                yield found(held + [batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield found(held)

    def found(parts):
        table = pa.Table.from_batches(parts)
        data, owner, place, start = _suffixes(table.column("body").to_pylist(), length)
        again = np.zeros(len(start), bool)
        if len(start):
            order, same = suffix_array(data, start, length)
            again[order[same]] = again[order[:-1][same[1:]]] = True
        return _runs(table, owner[again], place[again])

    return rows.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(run, "phrase long, check long, a long, z long")


def compare_hot(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """compare() for triggers of very many phrases: Spark groups the suffixes, combining them before the shuffle."""

    def run(batches):
        for batch in batches:
            own = [T.column(batch, c).to_numpy(zero_copy_only=False) for c in PHRASE]
            for at in range(0, batch.num_rows, 200):
                data, owner, place, start = _suffixes(T.column(batch, "body").slice(at, 200).to_pylist(), length)
                yield _batch(suffix=_longs(T.grams(data, length)[start]), suffix_check=_longs(T.grams(data, length, 1)[start]), **{c: pa.array(x[at : at + 200][owner]) for c, x in zip(PHRASE, own)}, place=pa.array(place))

    each, suffix = rows.mapInArrow(run, "suffix long, suffix_check long, phrase long, check long, place long"), ["suffix", "suffix_check"]
    ends = [f(c).alias(f"{n}_{c}") for c in PHRASE for n, f in (("low", F.min), ("top", F.max))]
    common = each.groupBy(*suffix).agg(*ends).where("low_phrase < top_phrase or low_check < top_check").select(*suffix)
    # neighbouring places of a phrase, of which there are at most as many as a phrase has bytes, become runs
    places = each.join(common, suffix, "left_semi").groupBy(*PHRASE).agg(F.collect_set("place").alias("p"))
    first, last = (F.array_sort(F.filter("p", lone)) for lone in (lambda x: ~F.array_contains("p", x - 1), lambda x: ~F.array_contains("p", x + 1)))
    return places.select(*PHRASE, first.alias("a"), last.alias("z")).select(*PHRASE, F.explode(F.arrays_zip("a", "z")).alias("r")).select(*PHRASE, "r.a", "r.z")


def second_cuts(body: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A phrase cut where the least gram besides its trigger changes: that gram's hash, first and last window of each run. All
    windows of a phrase hold its trigger, so minima from there to either side decide; of equal ones the leftmost."""
    grams = T.grams(np.frombuffer(body, np.uint8), gram)
    ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    trigger = int(ranked.argmin())
    ranked[trigger] = np.iinfo(np.uint64).max
    before = np.minimum.accumulate(ranked[trigger::-1])[::-1]
    after = np.minimum.accumulate(ranked[trigger:])
    window = np.arange(len(body) - length + 1)
    second = np.minimum(before[window], after[window + length - gram - trigger])
    cut = np.flatnonzero(np.r_[True, second[1:] != second[:-1]])
    return grams[(second[cut] & _PLACE).astype(np.int64)], cut, np.r_[cut[1:], len(window)] - 1


def compare_large(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """compare() for triggers of many phrases, which are parsed once more by a second trigger; and the staged tables that
    its result reads."""

    def run(batches):
        for batch in batches:
            out, owner = {n: [] for n in ("trigger", "piece", "first", "many", "body")}, []
            body = T.column(batch, "body").to_pylist()
            for i, (trigger, own) in enumerate(zip(T.column(batch, "trigger").to_pylist(), body)):
                second, first, last = second_cuts(own, length, gram)
                out["trigger"].append(T.mix64(T.mix64(second) + np.uint64(trigger % 2**64)))
                out["piece"].append(T.digests(np.frombuffer(own, np.uint8), first, last + length))
                out["first"].append(first)
                out["many"].append(last - first + 1)
                out["body"] += [own[a : z + length] for a, z in zip(first.tolist(), last.tolist())]
                owner += [i] * len(first)
            if owner:
                whole = {n: np.concatenate(out[n]) for n in ("trigger", "piece", "first", "many")}
                outer = {f"outer_{c}": T.column(batch, c).take(pa.array(owner)) for c in PHRASE}
                yield _batch(trigger=_longs(whole["trigger"]), phrase=_longs(whole["piece"][:, 0]), check=_longs(whole["piece"][:, 1]), **outer, first=pa.array(whole["first"]), many=pa.array(whole["many"]), body=pa.array(out["body"], pa.binary()))

    cuts = stage(rows.mapInArrow(run, "trigger long, phrase long, check long, outer_phrase long, outer_check long, first long, many long, body binary"), "cuts")
    # a window stands at one place of a phrase, so a piece that is cut twice is of two phrases
    pieces = stage(cuts.groupBy("trigger", *PHRASE).agg(F.count(F.lit(1)).alias("n"), F.first("body").alias("body")), "pieces")
    repeated = pieces.where("n > 1").select(*PHRASE)
    by_trigger = pieces.groupBy("trigger").agg(F.count(F.lit(1)).alias("phrases")).where("phrases > 1")
    few, many = (pieces.join(by_trigger.where(x), "trigger", "left_semi") for x in (F.col("phrases") <= HOT, F.col("phrases") > HOT))
    parts = compare(few, length).union(compare_hot(many, length)).join(repeated, PHRASE, "left_anti")
    known = repeated.select(*PHRASE, F.lit(0).cast("long").alias("a"), F.lit(None).cast("long").alias("z")).union(parts)
    places = F.col("first") + F.col("a"), F.col("first") + F.coalesce("z", F.col("many") - 1)
    return cuts.drop("body").join(known, PHRASE).select(*(F.col(f"outer_{c}").alias(c) for c in PHRASE), places[0].alias("a"), places[1].alias("z")), (cuts, pieces)


def parse(docs: DataFrame, wanted: BitMap, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """The parse, as far as the filter lets pass: (text_key, text_check, phrase, check, start, windows), starts in bytes of
    the text."""

    def run(batches):
        for batch in batches:
            for _, data, offsets, base, p in parsed(T.column(batch, "text"), length, piece):
                hit = wanted.hit(p["phrase"])
                row = p["row"][hit]
                if len(row):
                    some, own = np.unique(row, return_inverse=True)
                    key = T.digests(data, offsets[some], offsets[some + 1])[own]
                    yield _batch(text_key=_longs(key[:, 0]), text_check=_longs(key[:, 1]), **{c: _longs(p[c][hit]) for c in PHRASE}, start=pa.array(base + p["first"][hit] - offsets[row]), windows=pa.array(p["last"][hit] - p["first"][hit] + 1))

    return docs.select("text").mapInArrow(run, "text_key long, text_check long, phrase long, check long, start long, windows long")


def spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(text_key, text_check, spans): the maximal removed byte runs [start, end) of each different text that loses any. Staged."""
    words = stage(dictionary(docs, length, piece), "dictionary")
    repeated = words.where("n > 1").select(*PHRASE)
    by_trigger = words.groupBy("trigger").agg(F.count(F.lit(1)).alias("phrases")).where("phrases > 1")
    shared = stage(by_trigger, "triggers")
    bodies = stage(shared_phrases(docs, bit_map(shared.select("trigger")), length, piece), "phrases")
    few, many = (bodies.join(shared.where(x), "trigger", "left_semi") for x in (F.col("phrases") <= MANY, F.col("phrases") > MANY))
    # a phrase parsed twice repeats all its windows; of one parsed once, those count that other phrases have too
    large, work = compare_large(many, length)
    parts = stage(compare(few, length).union(large).join(repeated, PHRASE, "left_anti"), "parts")
    known = repeated.select(*PHRASE, F.lit(0).cast("long").alias("a"), F.lit(None).cast("long").alias("z")).union(parts)
    rows = parse(docs, bit_map(known.select("phrase")), length, piece).distinct()
    sure = rows.join(known, PHRASE).select(*TEXT, (F.col("start") + F.col("a")).alias("start"), (F.coalesce("z", F.col("windows") - 1) - F.col("a") + length).alias("size"))
    # adjoining and overlapping pieces of a text become one run
    order = Window.partitionBy(*TEXT).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("start") + F.col("size")).over(order)
    run = F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(Window.partitionBy(*TEXT).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, 0))
    marked = sure.withColumn("reach", reach).withColumn("run", run)
    runs = marked.groupBy(*TEXT, "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
    found = stage(runs.groupBy(*TEXT).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")
    discard(words, shared, bodies, parts, *work)
    return found


def cut(docs: DataFrame, change, schema, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """change(batch, spans) for all rows of docs, spans being a list of runs for each row. Only texts that may lose bytes meet
    their spans in a join; all others pass without a shuffle. Columns of docs may have any names."""
    found = spans(docs, length, piece)
    key, check, runs = (fresh(n, docs) for n in (*TEXT, "spans"))
    some, names = bit_map(found.select("text_key")), docs.columns

    def keys(batch):
        return np.concatenate([np.zeros((0, 2), np.uint64), *(T.digests(data, offsets[:-1], offsets[1:]) for _, _, data, offsets in T.blocks(T.column(batch, "text")))])

    def rest(batches):
        for batch in batches:
            own = batch.filter(pa.array(~some.hit(keys(batch)[:, 0])))
            yield change(own, [None] * own.num_rows)

    def hit(batches):
        for batch in batches:
            key_of = keys(batch)
            yes = some.hit(key_of[:, 0])
            own = batch.filter(pa.array(yes))
            yield pa.RecordBatch.from_arrays([*own.columns, *(_longs(key_of[yes, i]) for i in (0, 1))], names=[*names, key, check])

    def joined(batches):
        for batch in batches:
            yield change(batch.select(names), T.column(batch, runs).to_pylist())

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    met = docs.mapInArrow(hit, f"{fields}, {key} long, {check} long").join(found.select(F.col("text_key").alias(key), F.col("text_check").alias(check), F.col("spans").alias(runs)), [key, check], "left").select(*(F.col(f"`{n}`") for n in names), runs)
    return docs.mapInArrow(rest, schema).union(met.mapInArrow(joined, schema))


def kept_bytes(text: bytes, spans) -> bytes:
    out, at = [], 0
    for s in spans or ():
        out.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


def removed(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs."""

    def change(batch, spans):
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, cut_ in zip(T.column(batch, "text"), spans):
            raw, own = (text.as_py() or "").encode(), cut_ or []
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(s["end"] - s["start"] for s in own))
            out["n_spans"].append(len(own))
            out["kept_sha256"].append(hashlib.sha256(kept_bytes(raw, own)).hexdigest())
        return pa.RecordBatch.from_arrays([T.column(batch, "doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())], names=["doc_id", *out])

    return cut(docs.select("doc_id", "text"), change, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, piece)


def remove_repeats(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """The rows of docs with repeated passages cut out of text, n_chars made to fit where there is such a column.
    Bytes of a cut UTF-8 sequence go too; a text that loses all its bytes becomes empty."""

    def change(batch, spans):
        text = T.column(batch, "text")
        new = [kept_bytes(t.as_py().encode(), s).decode("utf-8", "ignore") if s else t.as_py() for t, s in zip(text, spans)]
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, text.type))

    out = cut(docs, change, docs.schema, length, piece)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
