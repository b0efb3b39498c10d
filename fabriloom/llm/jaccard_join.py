"""Jaccard self-join of shingle sets through a token-group matrix.

Texts with equal sets are one class from the start. Similar classes are partitioned into groups: a class meets the
leaders drawn from those that share a min-hash band with it, and what hangs together by a looser similarity is a group; large
groups are cut into units of bounded size, and a class that is like no other is a unit of its own. The token-group matrix
holds for each unit the union of its members' tokens, packed in one row. A query (a class) is held against a unit's
row: their overlap bounds what the query can reach with any member. If the unit has one member, the row is that member and
the overlap settles the link; else only units whose bound is high enough are opened, that is sent together with the
queries that qualify, and the members are compared one by one.

Holding every query against every row would be a cross join. Which rows a query meets comes from an index: a
class cannot be similar to another without sharing some of the tokens of its prefix (rare tokens first, long enough that
similar sets share several), so only units that share enough of them, by size ranges and counts, meet. Queries of
one unit go together.

The result is exact: min-hash bands only choose the groups. Classes that leaders' links already hold together (a
comp) need no comparison, so only links between comps are sought. Tokens of a single comp are thinned out by a Bloom filter
before the exact join.

Defined results: null, empty and blank texts have the empty set and link with nothing; texts with fewer words
than a shingle have one shingle of all words; repeated rows share a component; component ids are the least
non-null doc_id of a component; extra columns are ignored. A class is named by 64 bits of a hash of 128 of its set; if
different sets share such a name (one pair is expected in 6 x 10^9 sets), they are named by the other half. Tokens are
64-bit hashes, compared only between the two sets of a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.llm import textops as T
from fabriloom.llm.common import BitMap, Seen, bit_map, discard, mix64, small_batches, stage
from fabriloom.llm.components import connected_components

#: Words in a shingle; least similarity in percent; min-hash bands, hashes in each and
#: leaders of each; similarity in percent by which classes share a group; about so many classes and tokens in a unit.
SHINGLE, PERCENT, BANDS, DEPTH, LEADERS, LOOSE, CHUNK, CHUNK_TOKENS = 5, 75, 8, 3, 3, 50, 64, 1 << 14
#: A set's prefix is longer by its size / EXTRA, and so many of its tokens must be found in common.
EXTRA = 10
#: A token in so many of the sets that a task holds at once (about TOKENS tokens) is reported; so many of the most frequent
#: tokens are put last in the prefix order.
REPORT, TOKENS, FREQUENT = 4, 1 << 20, 1 << 17
_SEEDS = np.random.default_rng(55).integers(1, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Names:
    """The names of classes: so many bits of one half of a hash, or the other half where the name is in shared."""

    def __init__(self, bits: int = 64, shared: frozenset[int] = frozenset()):
        self.bits, self.shared = bits, shared

    def of(self, own: np.ndarray) -> tuple[int, int]:
        """Name and other half of a set."""
        raw = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
        name, check = (int.from_bytes(x, "little", signed=True) for x in (raw[:8], raw[8:]))
        name >>= 64 - self.bits
        return (check if name in self.shared else name), check


def sets(text: pa.Array, names: Names, shingle: int = SHINGLE):
    """Yields (row, sorted distinct token array, class, check) for each row whose set isn't empty."""
    for lo, _, data, offsets in T.blocks(text):
        words, row, *_ = T.word_hashes(data, offsets, T.NOT_SPACE)
        token, of, _ = T.shingle_hashes(words, row, shingle, short=True)
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        for a, z in zip(cut, np.r_[cut[1:], len(of)]):
            own = np.unique(token[a:z])
            yield lo + int(of[a]), own, *names.of(own)


def bands(own: np.ndarray) -> list[int]:
    low = mix64(own[None, :] * _SEEDS[:, None]).min(1).reshape(BANDS, DEPTH)
    keys = (low * _SEEDS[:DEPTH]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return mix64(keys).view(np.int64).tolist()


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def survey(docs: DataFrame, names: Names) -> DataFrame:
    """One pass over the texts. Rows of documents: (doc_id, class, check, n, bands), class null for the empty set and bands
    only where the class first shows in the task; and rows (token, count) of tokens that a task meets often."""

    def run(batches):
        seen, tokens = Seen(), []

        def frequent():
            token, count = np.unique(np.concatenate(tokens), return_counts=True)
            token, count = token[count >= REPORT], count[count >= REPORT]
            tokens.clear()
            k = len(token)
            return _rows(doc_id=pa.nulls(k, pa.int64()), **{c: pa.nulls(k, pa.int64()) for c in ("class", "check")}, n=pa.array(count.astype(np.int64)), bands=pa.nulls(k, pa.list_(pa.int64())), token=_longs(token))

        held = 0
        for batch in batches:
            size = batch.num_rows
            klass, other, n, keys = [None] * size, [None] * size, [0] * size, [None] * size
            for r, own, c, check in sets(T.column(batch, "text"), names):
                klass[r], other[r], n[r] = c, check, len(own)
                if seen.first(c):
                    keys[r] = bands(own)
                    tokens.append(own)
                    held += len(own)
                    if held > TOKENS:
                        yield frequent()
                        held = 0
            yield _rows(doc_id=T.column(batch, "doc_id").cast(pa.int64()), **{"class": pa.array(klass, pa.int64())}, check=pa.array(other, pa.int64()), n=pa.array(n, pa.int64()), bands=pa.array(keys, pa.list_(pa.int64())), token=pa.nulls(size, pa.int64()))
        if tokens:
            yield frequent()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, class long, check long, n long, bands array<long>, token long")


def surveyed(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, Names]:
    """The staged survey, and names that no two classes share. Shared ones are as few as collisions of the hash."""
    names = Names(bits)
    rows = stage(survey(docs, names), "survey")
    found = rows.where("class is not null").groupBy("class").agg(F.min("check").alias("a"), F.max("check").alias("z")).where("a < z").select("class").toArrow()
    if found.num_rows:
        discard(rows)
        names = Names(bits, frozenset(found.column("class").to_pylist()))
        rows = stage(survey(docs, names), "survey")
    return rows, names


def members(docs: DataFrame, wanted: BitMap, names: Names) -> DataFrame:
    """(class, n, tokens): the packed sets of the classes that the filter lets pass, at least once each."""

    def run(batches):
        seen = Seen()
        for batch in batches:
            out = [[], [], []]
            for _, own, c, _ in sets(T.column(batch, "text"), names):
                if wanted.hit(np.array([c], np.int64).view(np.uint64))[0] and seen.first(c):
                    for kept, value in zip(out, (c, len(own), own.tobytes())):
                        kept.append(value)
            yield _rows(**{"class": pa.array(out[0], pa.int64())}, n=pa.array(out[1], pa.int64()), tokens=pa.array(out[2], pa.binary()))

    return docs.select("text").mapInArrow(run, "class long, n long, tokens binary").groupBy("class").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set in the order rare before frequent, then by hash. With an overlap of percent of the
    larger set, the prefixes of similar sets share max(1, n / EXTRA) tokens, n being the smaller size."""
    n = len(own)
    size = min(n, n - -(-percent * n // 100) + max(1, n // EXTRA))
    place = np.searchsorted(frequent, own)
    often = (place < len(frequent)) & (frequent[np.minimum(place, len(frequent) - 1)] == own) if len(frequent) else np.zeros(n, bool)
    rare = own[~often]
    if len(rare) >= size:
        return rare[:size]
    common = own[often]
    order = np.lexsort((common, counts[place[often]]))
    return np.r_[rare, common[order[: size - len(rare)]]]


def prefixes(docs: DataFrame, names: Names, store: DataFrame, starred: BitMap, frequent: np.ndarray, counts: np.ndarray, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables (class, n, tokens): the packed prefix of each class. The first has the classes that starred lets pass, which
    are those of store; the second all others, read from the texts."""

    def packed(found):
        out = [[], [], []]
        for n, own, c in found:
            for kept, value in zip(out, (c, n, prefix(own, frequent, counts, percent).tobytes())):
                kept.append(value)
        return _rows(**{"class": pa.array(out[0], pa.int64())}, n=pa.array(out[1], pa.int64()), tokens=pa.array(out[2], pa.binary()))

    def stored(batches):
        for batch in batches:
            own = (np.frombuffer(x.as_py(), np.uint64) for x in T.column(batch, "tokens"))
            yield packed(zip(T.column(batch, "n").to_pylist(), own, T.column(batch, "class").to_pylist()))

    def others(batches):
        seen = Seen()
        for batch in batches:
            yield packed((len(own), own, c) for _, own, c, _ in sets(T.column(batch, "text"), names) if not starred.hit(np.array([c], np.int64).view(np.uint64))[0] and seen.first(c))

    schema = "class long, n long, tokens binary"
    return store.select("class", "n", "tokens").mapInArrow(stored, schema), docs.select("text").mapInArrow(others, schema)


def unpacked(index: DataFrame, names: list[str], wanted: BitMap | None = None) -> DataFrame:
    """A row for each token of the packed prefixes, or for those that the filter lets pass."""

    def run(batches):
        for batch in batches:
            packed = T.column(batch, "tokens").to_pylist()
            at = np.repeat(np.arange(len(packed)), np.array([len(x) // 8 for x in packed], np.int64))
            token = np.frombuffer(b"".join(packed), np.uint64)
            if wanted is not None:
                hit = wanted.hit(token)
                at, token = at[hit], token[hit]
            yield pa.RecordBatch.from_arrays([*(T.column(batch, n).take(pa.array(at)) for n in names), _longs(token)], names=[*names, "token"])

    return index.select(*names, "tokens").mapInArrow(run, ", ".join(f"{n} long" for n in (*names, "token")))


def _shared(left: pa.Array, right: pa.Array) -> list[int]:
    return [len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True)) for x, y in zip(left, right)]


def close_pairs(pairs: DataFrame, store: DataFrame, percent: int, loose: int) -> DataFrame:
    """(a, b, linked): the pairs of classes whose sets are similar by loose percent, and whether they are by percent."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(T.column(batch, n) for n in ("a", "b", "n")), pa.array(_shared(T.column(batch, "tokens_a"), T.column(batch, "tokens_b")), pa.int64())], names=["a", "b", "n", "shared"])

    sides = [store.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "tokens_a", "tokens_b")
    found = both.mapInArrow(run, "a long, b long, n long, shared long")
    by = lambda least: F.col("shared") * 100 >= (F.col("n") - F.col("shared")) * least
    return found.where(by(min(loose, percent))).select("a", "b", by(percent).alias("linked"))


def groups_of(close: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, comp) of linked classes, comp being what hangs together by links so far; and (class, comp, unit, key) of all
    classes of close. A unit is a group, or a part of a large one, of bounded size; a large comp has units of its own,
    and its key for all of them; other units are their own key."""
    comps = stage(connected_components(close.where("linked")).select(F.col("node").alias("class"), F.col("component").alias("comp")), "comps")
    member = close.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    member = stage(member.join(store.select("class", "n"), "class"), "grouped")
    loose = close.where("not linked").select("a", "b")
    for x in "ab":
        loose = loose.join(member.select(F.col("class").alias(x), F.col("comp").alias(f"comp_{x}")), x)
    groups = connected_components(loose.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))).select(F.col("node").alias("comp"), F.col("component").alias("grp"))
    own = member.groupBy("comp").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("size")).join(groups, "comp", "left")
    own = own.withColumn("large", (F.col("many") >= CHUNK) | (F.col("size") >= CHUNK_TOKENS)).withColumn("key", F.when(F.col("large"), F.col("comp")).otherwise(F.coalesce("grp", "comp")))
    total = own.groupBy("key", "large").agg(F.ceil(F.greatest(F.sum("many") / CHUNK, F.sum("size") / CHUNK_TOKENS)).alias("chunks"))
    own = own.select("comp", "key", "large").join(total, ["key", "large"])
    chunk = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("class")).otherwise(F.col("comp"))), F.col("chunks"))
    return comps, member.join(own, "comp").select("class", "comp", F.xxhash64("key", "large", chunk).alias("unit"), "large").withColumn("key", F.when(F.col("large"), F.col("comp")).otherwise(F.col("unit"))).drop("large")


def unions(packs: DataFrame) -> DataFrame:
    """The token-group matrix (unit, many, low, comp, tokens): for each unit the union of its members' tokens, packed, with the
    number and the least size of the members; comp is that of a single member."""

    def run(batches):
        for batch in batches:
            out = {"many": [], "low": [], "comp": [], "tokens": []}
            for pack in T.column(batch, "pack"):
                members_ = [(m["comp"].as_py(), np.frombuffer(m["tokens"].as_py(), np.uint64)) for m in pack.values]
                out["many"].append(len(members_))
                out["low"].append(min(len(x) for _, x in members_))
                out["comp"].append(members_[0][0])
                out["tokens"].append(np.unique(np.concatenate([x for _, x in members_])).tobytes())
            yield _rows(unit=T.column(batch, "unit"), **{n: pa.array(v, pa.binary() if n == "tokens" else pa.int64()) for n, v in out.items()})

    return packs.select("unit", "pack").mapInArrow(run, "unit long, many long, low long, comp long, tokens binary")


def bounded(batches, percent: int):
    """From rows (unit_a, pack of its members as queries, unit_b with its row of the matrix): links (a, b) of comps where unit_b has one
    member, and else (unit_a, unit_b, query) of the queries whose overlap with the union lets them be similar to a member."""
    for batch in batches:
        out = {n: [] for n in ("a", "b", "query")}
        columns = [T.column(batch, n) for n in ("unit_a", "unit_b", "many", "low", "comp", "tokens", "pack")]
        for unit_a, unit_b, many, low, comp, tokens, pack in zip(*(c.to_pylist() for c in columns[:5]), *columns[5:]):
            union = np.frombuffer(tokens.as_py(), np.uint64)
            links = set()
            for m in pack.values:
                own = np.frombuffer(m["tokens"].as_py(), np.uint64)
                place = np.searchsorted(union, own)
                shared = int((union[np.minimum(place, len(union) - 1)] == own).sum())
                if many == 1:
                    if shared * 100 >= (len(own) + len(union) - shared) * percent and m["comp"].as_py() != comp:
                        links.add((m["comp"].as_py(), comp, None))
                elif shared * 100 >= max(len(own), low) * percent:
                    links.add((unit_a, unit_b, m["class"].as_py()))
            for a, b, q in links:
                for kept, value in zip(out.values(), (a, b, q)):
                    kept.append(value)
        yield _rows(**{n: pa.array(v, pa.int64()) for n, v in out.items()})


def open_units(batches, percent: int):
    """Links (a, b) of comps between the members of opened units: the queries (null: all) of the left one against each member
    of the right one."""
    for batch in batches:
        links: set[tuple[int, int]] = set()
        for same, queries, left, right in zip(T.column(batch, "same").to_pylist(), T.column(batch, "queries").to_pylist(), T.column(batch, "left"), T.column(batch, "right")):
            left, right = left.as_py(), right.as_py()
            queries = None if queries is None else set(queries)
            sets_b = [np.frombuffer(m["tokens"], np.uint64) for m in right]
            n_b = np.array([len(x) for x in sets_b])
            tokens, owner = np.concatenate(sets_b), np.repeat(np.arange(len(right)), n_b)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            comp_b, class_b = np.array([m["comp"] for m in right]), np.array([m["class"] for m in right])
            for m in left:
                if queries is not None and m["class"] not in queries:
                    continue
                own = np.frombuffer(m["tokens"], np.uint64)
                lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
                many = hi - lo
                at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
                shared = np.bincount(owner[at], minlength=len(right))
                linked = (shared * 100 >= (len(own) + n_b - shared) * percent) & (comp_b != m["comp"]) & ((class_b > m["class"]) | (not same))
                links.update((m["comp"], int(b)) for b in comp_b[linked])
        yield _rows(a=pa.array([x[0] for x in links], pa.int64()), b=pa.array([x[1] for x in links], pa.int64()))


def meetings(postings: DataFrame, percent: int) -> DataFrame:
    """(unit_a, unit_b) of units of different keys that share enough prefix tokens, by counts and size ranges. The units of one
    large comp share most tokens but need no comparison, so tokens first bring together keys, and only keys that meet
    are resolved into units, token by token, from the key that has one unit if there is such."""
    sides = {x: postings.select("token", *(F.col(n).alias(f"{n}_{x}") for n in ("key", "unit", "low", "high"))) for x in "ab"}
    keys = {x: df.groupBy("token", f"key_{x}").agg(F.min(f"low_{x}").alias(f"low_{x}"), F.max(f"high_{x}").alias(f"high_{x}")) for x, df in sides.items()}
    fits = (F.col("high_b") * 100 >= F.col("low_a") * percent) & (F.col("high_a") * 100 >= F.col("low_b") * percent)
    low = F.least("low_a", "low_b")
    # prefixes are max(1, n / EXTRA) longer than an overlap of one token would need; the smallest set counts
    enough = F.col("common") >= F.greatest(F.lit(1), F.floor(F.col("low") / EXTRA))
    common = keys["a"].join(keys["b"], "token").where(fits & (F.col("key_a") > F.col("key_b"))).groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("common"), F.min(low).alias("low"))
    met = common.where(enough).select("key_a", "key_b")
    own = postings.groupBy("key").agg(F.min("unit").alias("unit"), F.max("unit").alias("top"))
    own = stage(own.select("key", F.when(F.col("unit") == F.col("top"), F.col("unit")).alias("unit")), "key-units")
    for x in "ab":
        met = met.join(own.select(F.col("key").alias(f"key_{x}"), F.col("unit").alias(f"unit_{x}")), f"key_{x}")
    met = stage(met, "met")
    settled = met.where("unit_a is not null and unit_b is not null").select("unit_a", "unit_b")
    turn = F.col("unit_a").isNull()
    rest = met.where("unit_a is null or unit_b is null").select(F.when(turn, F.col("key_b")).otherwise(F.col("key_a")).alias("key_a"), F.when(turn, F.col("key_a")).otherwise(F.col("key_b")).alias("key_b"))
    pairs = rest.join(sides["a"], "key_a").join(sides["b"], ["token", "key_b"]).where(fits)
    common = pairs.groupBy("unit_a", "unit_b").agg(F.count(F.lit(1)).alias("common"), F.min(low).alias("low"))
    return settled.union(common.where(enough).select("unit_a", "unit_b"))


def class_components(docs: DataFrame, rows: DataFrame, names: Names, percent: int = PERCENT) -> DataFrame:
    """(class, component): which classes hang together by links; classes without a link to another are left out.
    rows, names: of surveyed(docs)."""
    # groups: each band has several leaders, drawn by hash, so that a class that is unlike one may be like another
    keys = rows.where("bands is not null").select("class", "n", F.explode("bands").alias("band"))
    drawn = [F.min(F.struct(F.xxhash64("class", F.lit(salt)).alias("draw"), F.col("class").alias("b"), F.col("n").alias("n_b"))).alias(f"leader_{salt}") for salt in range(LEADERS)]
    leaders = keys.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("top"), *drawn).where("low < top")
    leaders = leaders.select("band", F.explode(F.array_distinct(F.array(*(f"leader_{salt}" for salt in range(LEADERS))))).alias("l")).select("band", "l.b", "l.n_b")
    near = (F.col("n") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n") * percent) & (F.col("class") != F.col("b"))
    stars = stage(keys.join(leaders, "band").where(near).select(F.greatest("class", "b").alias("a"), F.least("class", "b").alias("b")).distinct(), "stars")
    starred = bit_map(stars.select(F.explode(F.array("a", "b"))))
    store = stage(members(docs, starred, names), "star-sets")
    close = stage(close_pairs(stars, store, percent, LOOSE), "close")
    comps, units = groups_of(close, store)
    units = stage(units, "units")

    # the order of tokens: those that many sets have come last. Any order gives the same result
    often = rows.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= 8 * REPORT).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    token, count = often.column("token").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(token)

    def in_unit(df: DataFrame) -> DataFrame:
        return df.join(units, "class", "left").withColumns({n: F.coalesce(n, "class") for n in ("comp", "unit", "key")})

    # only classes of store can be in units; all others are units of their own and need no look-up
    known, others = prefixes(docs, names, store, starred, token[order], count[order], percent)
    index = in_unit(known).select("unit", "comp", "key", "n", "tokens").union(others.select(*(F.col("class").alias(n) for n in ("unit", "comp", "key")), "n", "tokens"))
    index = stage(index, "prefixes")
    discard(stars, close, store)
    contested = stage(unpacked(index, ["comp"]).groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token"), "contested")
    asked = unpacked(index, ["unit", "key", "n"], bit_map(contested))
    postings = asked.groupBy("token", "unit", "key").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    postings = stage(postings.join(contested, "token", "left_semi"), "postings")
    discard(index, contested)
    mixed = units.groupBy("unit").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first < last").select(F.col("unit").alias("unit_a"), F.col("unit").alias("unit_b"))
    hit = stage(meetings(postings, percent).union(mixed), "hit")

    # the members of the units that meet, a row for each unit, and their unions
    opened = stage(hit.select(F.explode(F.array("unit_a", "unit_b")).alias("unit")).distinct(), "opened")
    wanted = bit_map(units.join(opened, "unit", "left_semi").select("class").union(opened.select(F.col("unit").alias("class"))))
    packs = in_unit(members(docs, wanted, names)).join(opened, "unit", "left_semi").groupBy("unit").agg(F.collect_list(F.struct("class", "comp", "tokens")).alias("pack"))
    packs = stage(packs, "packs")
    matrix = stage(unions(packs), "matrix")
    # the unit with fewer members is the group, that with more the queries
    sizes = matrix.select("unit", "many")
    for x in "ab":
        hit = hit.join(sizes.select(F.col("unit").alias(f"unit_{x}"), F.col("many").alias(f"many_{x}")), f"unit_{x}")
    turn = F.col("many_a") < F.col("many_b")
    hit = hit.select(F.when(turn, F.col("unit_b")).otherwise(F.col("unit_a")).alias("unit_a"), F.when(turn, F.col("unit_a")).otherwise(F.col("unit_b")).alias("unit_b"))
    held = hit.where("unit_a <> unit_b").join(packs.select(F.col("unit").alias("unit_a"), "pack"), "unit_a").join(matrix.withColumnRenamed("unit", "unit_b"), "unit_b")
    held = stage(held.select("unit_a", "unit_b", "many", "low", "comp", "tokens", "pack").mapInArrow(lambda batches: bounded(batches, percent), "a long, b long, query long"), "held")
    qualified = held.where("query is not null").groupBy(F.col("a").alias("unit_a"), F.col("b").alias("unit_b")).agg(F.collect_set("query").alias("queries"))
    qualified = qualified.union(hit.where("unit_a = unit_b").select("unit_a", "unit_b", F.lit(None).cast("array<long>")))
    pairs = qualified.join(packs.select(F.col("unit").alias("unit_a"), F.col("pack").alias("left")), "unit_a").join(packs.select(F.col("unit").alias("unit_b"), F.col("pack").alias("right")), "unit_b")
    between = pairs.select((F.col("unit_a") == F.col("unit_b")).alias("same"), "queries", "left", "right").mapInArrow(lambda batches: open_units(batches, percent), "a long, b long")
    joined = connected_components(between.union(held.where("query is null").select("a", "b"))).select(F.col("node").alias("comp"), "component")
    linked = comps.join(joined, "comp", "left").select("class", F.coalesce("component", "comp").alias("component"))
    return linked.union(joined.join(comps.select(F.col("class").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("class"), "component"))


def components(docs: DataFrame, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id, class) of each row of docs; class is null for the empty set. bits: of the names of
    classes, fewer in tests."""
    rows, names = surveyed(docs, bits)
    found = class_components(docs, rows, names, percent)
    own = rows.where("token is null").select("doc_id", F.col("n").alias("n_shingles"), "class")
    # empty sets get keys of their own, so that they neither meet nor fill one task
    named = own.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # written, so that the join is of two tables and Spark can split a component with very many rows
    least = stage(named.where("class is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    key = F.coalesce("component", F.xxhash64("doc_id"))
    joined = named.withColumn("key", key).join(least.withColumnRenamed("component", "key"), "key", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return components(docs).select("doc_id", "n_shingles", "component_id")
