"""Document fingerprints by I-Match, in DataFrame functions only.

Terms whose document frequency lies in a band (inverse document frequencies between ln 4 and ln 500) are the
lexicon. A text keeps its distinct lexicon terms, sorts them, and hashes those of each of 88 random parts of the lexicon: a bit
of a term's identity halves the lexicon, both halves are parts, and one of them is halved again by the next bit, eleven times
over and in four ways; so there are eight parts each of 1/2, 1/4 and so on to 1/2048, and texts of any length have parts that
hold one or two of their terms, which a change mostly leaves alone. The fingerprint is the number of terms and the 88
hashes of 24 bits; likeness is the share of equal ones among the parts that hold about MANY terms or fewer of the shorter
text, parts that are empty in both left out: larger parts nearly always differ.

Near copies differ in some terms, and a text with few terms in the band may have none there but these: a group that
holds much of the corpus puts its terms above the band, and those of a small language lie below. So a text is thin if fewer
than a share THIN of its distinct terms is in the band. Thin texts are fingerprinted by all of their terms, and if one of
two texts is thin, both are compared by all terms.

The lexicon is bounded by the band: terms in at least a share s of all documents are at most (mean terms of a
document) / s, whatever the number of documents. It is broadcast only after its size has been checked.

The next document is found without a global window: ids are cut into ranges at approximate quantiles, and the
first document of each range is also dealt to the range before it (that of the first range to the last).

Defined results: a null text is empty; a text without words is fingerprinted as a whole, so it equals
only equal texts; the order is by doc_id, nulls first, then by text; a single document is its own next; repeated
rows are answered each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabriloom.llm.common import stage
from fabriloom.llm.native_text import plain, words_of

#: Least and largest share of documents with a lexicon term; times that the lexicon is halved, and in how many ways.
LEAST, MOST, HALVINGS, WAYS = 1 / 500, 1 / 4, 11, 4
#: Terms in a part beyond which it isn't compared.
MANY = 4
#: Share of a text's distinct terms in the band below which all of its terms count.
THIN = 1 / 4
#: Lexicon terms up to which the lexicon is broadcast (16 bytes each); documents in a range of ids.
BROADCAST_TERMS, RANGE = 4_000_000, 600


def term_ids(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(words_of(plain(text)))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(term): the 64-bit identities of the terms in the band, counted over all docs (text)."""
    total = docs.count()
    each = docs.select(F.explode(term_ids(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= max(2.0, least * total)) & (F.col("n") <= most * total)).select("term")


def ranges(docs: DataFrame, size: int = RANGE) -> tuple[list[int], list[tuple[int, int]]]:
    """Cuts of the ids, and for each range its number and first id. Both have an entry for each range only."""
    total = docs.count()
    many = max(1, -(-total // size)) if total < 2000 * size else 2000
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / many for i in range(1, many)], 0.2 / many)}) if many > 1 else []
    firsts = docs.where("doc_id is not null").groupBy(range_of(F.col("doc_id"), cuts).alias("r")).agg(F.min("doc_id").alias("first")).orderBy("r").collect()
    return cuts, [(r["r"], r["first"]) for r in firsts]


def range_of(doc_id: Column, cuts: list[int]) -> Column:
    """The number of cuts not above the id, by halving: a tree of comparisons no deeper than log2(cuts)."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(doc_id < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(doc_id.isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with range r, place rn in it, next_text, and extra rows (copy) that stand in for the next
    range's first document at the end of each range."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts, firsts = ranges(docs)
    nulls = docs.where("doc_id is null").limit(1).count() > 0
    rows = docs.withColumn("r", range_of(F.col("doc_id"), cuts))
    numbers = [r for r, _ in firsts] or [0]
    before = {first: numbers[k - 1] for k, (_, first) in enumerate(firsts)}
    if nulls:
        # null ids come first of all: they open range 0 and follow the last document
        before.pop(firsts[0][1], None) if firsts else None
        if firsts and firsts[0][0] != 0:
            before[firsts[0][1]] = 0
    copies = F.lit(None).cast("int")
    if before:
        keys = list(before)
        chosen = docs.sparkSession.createDataFrame([(int(k), int(v)) for k, v in before.items()], "first_id long, home int")
        # one row for each range: bounded by the 2,000 ranges
        rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("first_id"), "left")
        copies = F.col("home")
    if nulls:
        copies = F.when(F.col("doc_id").isNull(), F.lit(numbers[-1])).otherwise(copies)
    rows = rows.withColumn("homes", F.when(copies.isNotNull(), F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("copy")), F.struct(copies.alias("r"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("copy")))))
    # as many tasks as ranges: what a task sorts, here and term by term later on, is a few ranges, however many documents there are
    rows = rows.select("doc_id", "text", F.explode("homes").alias("h")).select("doc_id", "text", "h.r", "h.copy").repartition(len(numbers), "r")
    order = Window.partitionBy("r").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumn("rn", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))


def part_hashes(terms: Column) -> Column:
    """(n, v): the number of terms, and for each lexicon part the hash of those of the sorted terms that it has, null if none."""

    def hashed(own: Column) -> Column:
        return F.when(F.size(own) > 0, F.xxhash64(own).bitwiseAND(F.lit(0xFFFFFF)))

    def halved(state: Column, bit: Column) -> Column:
        halves = [F.filter(state["left"], lambda t: F.getbit(t, bit) == k) for k in (0, 1)]
        return F.struct(halves[0].alias("left"), F.concat(state["v"], F.array(*map(hashed, halves))).alias("v"))

    def way(k: int) -> Column:
        start = F.struct(terms.alias("left"), F.slice(F.array(F.lit(None).cast("long")), 1, 0).alias("v"))
        return F.aggregate(F.sequence(F.lit(16 * k), F.lit(16 * k + HALVINGS - 1)), start, halved, lambda state: state["v"])

    return F.struct(F.size(terms).alias("n"), F.concat(*map(way, range(WAYS))).alias("v"))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Share of equal part hashes of two part_hashes(); texts without any term are alike if equal."""
    n = F.least(a["n"], b["n"])
    skip = sum((F.when(n > MANY << (k + 1), 2).otherwise(0) for k in range(HALVINGS - 1)), F.lit(0))
    pairs = F.filter(F.zip_with(a["v"], b["v"], lambda x, y: F.struct((x.isNotNull() | y.isNotNull()).alias("used"), F.coalesce(x == y, F.lit(False)).alias("same"))), lambda x, i: x["used"] & (i % (2 * HALVINGS) >= skip))
    used, same = F.size(pairs), F.size(F.filter(pairs, lambda x: x["same"]))
    return F.when(F.greatest(a["n"], b["n"]) == 0, (whole_a == whole_b).cast("double")).when(used == 0, F.lit(0.0)).otherwise(same / used)


def printed(parts: Column, whole: Column) -> Column:
    hexed = F.transform(parts["v"], lambda x: F.coalesce(F.lpad(F.hex(x), 6, "0"), F.lit("-")))
    return F.when(parts["n"] == 0, F.concat(F.lit("t"), F.lpad(F.hex(whole), 16, "0"))).otherwise(F.concat(parts["n"].cast("string"), F.lit(":"), F.array_join(hexed, "")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document, with its own, its edited text's and its next document's fingerprint compared."""
    docs = docs.select("doc_id", "text")
    words = stage(lexicon(docs), "lexicon")
    small = words.count() <= BROADCAST_TERMS
    df = with_next(docs)
    n = F.length("text")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("m", F.floor(n / 4).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("m")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), F.col("m")))
    df = df.select("r", "rn", "copy", "doc_id", "n_chars", "text", edited.alias("edited"))
    df = df.withColumn("a", term_ids(F.col("text"))).withColumn("b", F.when(F.col("copy"), F.array().cast("array<string>")).otherwise(term_ids(F.col("edited"))))
    meta = F.struct("copy", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.xxhash64("text").alias("whole_a"), F.xxhash64("edited").alias("whole_b"))
    df = df.withColumn("meta", meta)
    kind = df.schema["meta"].dataType

    def marked(words_: Column, flag: int) -> Column:
        return F.transform(words_, lambda x: F.struct(x.alias("w"), F.lit(flag).alias("f"), F.lit(None).cast(kind).alias("meta")))

    rows = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("f"), F.col("meta").alias("meta"))), marked(F.array_intersect("a", "b"), 3), marked(F.array_except("a", "b"), 1), marked(F.array_except("b", "a"), 2))
    each = df.select("r", "rn", F.explode(rows).alias("x")).select("r", "rn", F.when(F.col("x.w").isNotNull(), F.xxhash64("x.w")).alias("t"), "x.f", "x.meta")
    known = words.withColumnRenamed("term", "known")
    each = each.join(F.broadcast(known) if small else known, F.col("t") == F.col("known"), "left")
    other = F.when(F.col("known").isNull(), F.col("t"))
    own = each.groupBy("r", "rn").agg(F.max("meta").alias("meta"), *(F.collect_list(F.when(F.col("f").bitwiseAND(flag) > 0, of)).alias(name) for name, flag, of in (("a", 1, F.col("known")), ("b", 2, F.col("known")), ("more_a", 1, other), ("more_b", 2, other))))
    thin = [(F.size(x) < THIN * (F.size(x) + F.size(f"more_{x}"))).alias(f"thin_{x}") for x in "ab"]
    order = Window.partitionBy("r").orderBy("rn")
    own = own.select("r", "rn", "meta.*", "a", "b", "more_a", "more_b", *thin)
    own = own.withColumn("thin_next", F.lead("thin_a", 1, False).over(order)).withColumn("thin_before", F.lag("thin_a", 1, False).over(order))
    # the hashes of all terms are needed only where a text or one that it is compared with is thin
    beside = F.col("thin_a") | F.col("thin_b")
    needed = {"a": beside | F.col("thin_next") | F.col("thin_before"), "b": beside}
    every = [F.when(needed[x], part_hashes(F.sort_array(F.concat(x, f"more_{x}")))).alias(f"all_{x}") for x in "ab"]
    own = own.select("r", "rn", "copy", "doc_id", "n_chars", "sha", "whole_a", "whole_b", "thin_a", "thin_b", "thin_next", part_hashes(F.sort_array("a")).alias("a"), part_hashes(F.sort_array("b")).alias("b"), *every)
    own = own.withColumns({f"next_{x}": F.lead(x).over(order) for x in ("a", "all_a", "whole_a")}).where(~F.col("copy"))

    def print_of(x: str) -> Column:
        return F.when(F.col(f"thin_{x}"), F.concat(F.lit("a"), printed(F.col(f"all_{x}"), F.col(f"whole_{x}")))).otherwise(printed(F.col(x), F.col(f"whole_{x}")))

    def near(thin_: Column, a: str, b: Column, all_b: Column, whole: Column) -> Column:
        return F.when(thin_, likeness(F.col(f"all_{a}"), all_b, F.col(f"whole_{a}"), whole)).otherwise(likeness(F.col(a), b, F.col(f"whole_{a}"), whole))

    return own.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), print_of("a").alias("fingerprint"), print_of("b").alias("edited_fingerprint"),
        near(beside, "a", F.col("b"), F.col("all_b"), F.col("whole_b")).alias("near_edited"),
        near(F.col("thin_a") | F.col("thin_next"), "a", F.coalesce("next_a", "a"), F.coalesce("next_all_a", "all_a"), F.coalesce("next_whole_a", "whole_a")).alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
