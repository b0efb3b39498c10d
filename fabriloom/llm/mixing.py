"""Mixing to target weights with soft membership, in DataFrame functions only.

A naive Bayes classifier, learned from the labelled table, gives every document posteriors over the domains that
the labels name (toxic; low quality; good). Each document then gets a nonnegative rate (expected
copies) such that the expected tokens of each domain, sum of rate * tokens * posterior, match the target weights. Of
the rates that solve this least-squares fit, those nearest to 1 are sought: they are max(0, 1 + m . posteriors) with one
multiplier m for each domain. Newton's method finds the multipliers, and runs until it has converged. A step needs a few numbers
for each pair of domains, found by one aggregate over all documents; rates are not stored. Distances from 1 are measured with
each document weighted by its tokens, so documents of equal posteriors get equal rates whatever their length.

Defined results: null and wordless texts have 0 tokens and prior posteriors; a document without tokens
keeps the rate that its posteriors give; without any labelled row all posteriors are equal; a domain that no document
may belong to gets no tokens, and the fit is then the nearest one; repeated rows each count; rows with a null
doc_id are kept; extra columns are kept by mix(), which goes by text and so serves null and repeated ids alike.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.llm.common import fresh, label_sample, stage
from fabriloom.llm.native_text import plain, words_of

#: The domains, and the share of tokens that each shall have.
TARGETS = {"good": 0.9, "low": 0.08, "toxic": 0.02}
#: log2 of the word buckets of the classifier, labelled rows of each domain to learn from.
BITS, PER_DOMAIN = 14, 2000
#: Weight of the distance from rate 1 beside the misfit, and the gradient (share of all tokens) at which the fit has converged.
NEAR, ENOUGH = 1e-8, 1e-6


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "good")


def buckets(text: Column, bits: int = BITS) -> Column:
    return F.transform(words_of(plain(text)), lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, domains: list[str], bits: int = BITS, per_domain: int = PER_DOMAIN) -> tuple[dict[str, float], DataFrame]:
    """Log priors over all labelled rows, and (bucket, one column of log likelihoods for each domain): a table of at
    most 2^bits rows, from a sample of about per_domain labelled rows of each domain."""
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where(F.col("domain").isin(domains))
    n = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(n.values())
    priors = {d: math.log((n.get(d, 0) + 1) / (total + len(domains))) for d in domains}
    chosen = label_sample(known, "domain", per_domain)
    # the sample is bounded by its parameter, so it may be broadcast
    words = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", F.explode(buckets(F.col("text"), bits)).alias("bucket"))
    counts = words.groupBy("bucket").agg(*(F.sum((F.col("domain") == d).cast("long")).alias(d) for d in domains))
    counts = stage(counts, "word-counts")
    size = counts.agg(*(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in domains)).first()
    table = counts.select("bucket", *(F.log((F.col(d) + 0.5) / (float(size[d]) + 0.5 * (1 << bits))).alias(d) for d in domains))
    return priors, table


def softmax(scores: list[Column]) -> Column:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return F.array(*(x / total for x in parts))


def score(docs: DataFrame, priors: dict[str, float], table: DataFrame, domains: list[str], bits: int = BITS) -> DataFrame:
    """(doc_id, n_tokens, p) of each row of docs (doc_id, text): its number of words and its posteriors."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), buckets(F.col("text"), bits).alias("words"))
    each = rows.select("row", "doc_id", F.explode_outer("words").alias("bucket"))
    # the table has 2^bits rows at most, and so may be broadcast
    scored = each.join(F.broadcast(table), "bucket", "left")
    unseen = {d: F.lit(float(-math.log(2.0**bits))) for d in domains}
    total = scored.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_tokens"), *(F.sum(F.when(F.col("bucket").isNotNull(), F.coalesce(d, unseen[d]))).alias(d) for d in domains))
    evidence = [F.coalesce(F.col(d), F.lit(0.0)) / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")) + F.lit(priors[d]) for d in domains]
    return total.select("doc_id", "n_tokens", softmax(evidence).alias("p"))


def rate_of(p: Column, steps: list[list[float]]) -> Column:
    """The rate that steps lead to: max(0, rate - step . p) for each step, from 1."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*(F.array(*map(F.lit, s)) for s in steps))

    def move(rate: Column, step: Column) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((F.get(step, d) * F.get(p, d) for d in range(1, len(steps[0]))), F.get(step, 0) * F.get(p, 0)))

    return F.aggregate(table, F.lit(1.0), move)


def solve(scored: DataFrame, targets: dict[str, float], enough: float = ENOUGH) -> tuple[list[list[float]], np.ndarray]:
    """The one step from rate 1 to the fitted rates over scored (n_tokens, p), and what each domain's share of all tokens
    then differs from its target by. Each aggregate returns one number for each domain and pair of domains."""
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    share = np.array(list(targets.values())) / sum(targets.values())
    n = scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    if not n:
        return [], -share

    def at(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The dual function, its gradient and Hessian, and the residual. The function is convex, of quadratic pieces."""
        rows = scored.select("n_tokens", "p", rate_of(F.col("p"), [[-float(x) for x in m]]).alias("rate"))
        mass, rate = F.col("n_tokens") / float(n), F.col("rate")
        sums = [(mass * rate * rate).alias("v"), *((mass * rate * F.get("p", i)).alias(f"d{i}") for i in range(k)), *(F.when(rate > 0, mass * F.get("p", i) * F.get("p", j)).otherwise(0.0).alias(f"h{i}_{j}") for i, j in pairs)]
        got = rows.select(*sums).agg(*(F.sum(c).alias(c) for c in ("v", *(f"d{i}" for i in range(k)), *(f"h{i}_{j}" for i, j in pairs)))).first()
        hessian = NEAR * np.eye(k)
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = got[f"h{i}_{j}"] + (NEAR if i == j else 0)
        residual = np.array([got[f"d{i}"] for i in range(k)]) - share
        return got["v"] / 2 + NEAR * (m @ m) / 2 - share @ m, residual + NEAR * m, hessian, residual

    m = np.zeros(k)
    value, gradient, hessian, residual = at(m)
    least = np.abs(gradient).max()
    while np.abs(gradient).max() > enough:
        way, length = -np.linalg.solve(hessian, gradient), 1.0
        while length > 1e-12:
            new = at(m + length * way)
            # rounding may hide a fall of the function, so a gradient of half the least so far will do as well
            if new[0] <= value + 1e-4 * length * (gradient @ way) or np.abs(new[1]).max() <= least / 2:
                break
            length /= 2
        else:
            logging.getLogger(__name__).warning("the fit stopped at a gradient of %g; residual %s", np.abs(gradient).max(), residual)
            break
        m = m + length * way
        value, gradient, hessian, residual = new
        least = min(least, np.abs(gradient).max())
    return [[-float(x) for x in m]], residual


def fit(scored: DataFrame, targets: dict[str, float], enough: float = ENOUGH) -> list[list[float]]:
    """The steps from rate 1 to the fitted rates."""
    return solve(scored, targets, enough)[0]


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, p, rate) of each row of docs, and the order of the domains in p."""
    targets = TARGETS if targets is None else targets
    domains = list(targets)
    priors, table = learn(docs, labels, domains)
    scored = stage(score(docs, priors, table, domains), "posteriors")
    return scored.withColumn("rate", rate_of(F.col("p"), fit(scored, targets))), domains


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with n_tokens, one posterior column p_<domain> for each domain, and rate. No row is dropped: equal texts have equal
    posteriors, so each row takes those of its text, whatever its id. Columns of docs with the new names are replaced; all
    others stay, whatever their names."""
    targets = TARGETS if targets is None else targets
    domains = list(targets)
    new = ["n_tokens", *(f"p_{d}" for d in domains), "rate"]
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    key, of = fresh("text_key", docs), F.coalesce(F.md5("text"), F.lit(""))
    priors, table = learn(docs, labels, domains)
    scored = stage(score(docs.select(of.alias("doc_id"), "text"), priors, table, domains), "posteriors")
    found = scored.dropDuplicates(["doc_id"]).withColumn("rate", rate_of(F.col("p"), fit(scored, targets)))
    found = found.select(F.col("doc_id").alias(key), "n_tokens", *(F.get("p", i).alias(f"p_{d}") for i, d in enumerate(domains)), "rate")
    return kept.withColumn(key, of).join(found, key, "left").drop(key)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, domains = rates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_tokens", *(F.get("p", i).alias(f"p_{d}") for i, d in enumerate(domains)), "rate")
