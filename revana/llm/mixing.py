"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a and normalised:
w = p^a / sum p^a. a = 1 keeps the corpus as it is, a = 0 makes all sources
equal. The exponent is bisected: the smallest flattening that meets the target
entropy, unless a source would then be repeated more often than the limit; in
that case the flattest one within the limit. The weights are realised as
budgeted block permutations: every source gets budget * w tokens, spent on whole
seeded permutations of its documents (blocks) and then on the first documents of
one more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from revana.llm.common import running_sum
from revana.workspace import materialise

TARGET_ENTROPY = 0.98       # of the highest possible, log(number of sources)
MAX_REPEATS = 4.0
SEED = 11
MAX_SOURCES = 1_000_000     # source names with their sums pass the driver; more is an error
PER_BUCKET = 20_000


def word_count(text: str = "text") -> Column:
    """White-space separated words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mixture:
    exponent: float
    weights: dict[str, float]
    budgets: dict[str, int]


def _weights(tokens: dict[str, int], a: float) -> dict[str, float]:
    total = sum(tokens.values())
    raised = {s: (n / total) ** a for s, n in tokens.items()}
    whole = math.fsum(raised.values())
    return {s: r / whole for s, r in raised.items()}


def _entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def choose_mixture(tokens: dict[str, int], budget: int | None = None, target: float = TARGET_ENTROPY,
                   max_repeats: float = MAX_REPEATS) -> Mixture:
    """The mixture for sources of so many tokens; sources without tokens get weight 0.

    ``budget`` tokens are to be drawn, as many as there are by default.
    """
    live = {s: tokens[s] for s in sorted(tokens) if tokens[s] > 0}
    total = sum(live.values())
    budget = total if budget is None else budget
    if not live:
        return Mixture(1.0, {s: 0.0 for s in tokens}, {s: 0 for s in tokens})
    goal = target * math.log(len(live)) if len(live) > 1 else 0.0

    def bisect(holds) -> float:
        """The largest exponent in [0, 1] that holds, where smaller ones hold too."""
        if holds(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low

    exponent = bisect(lambda a: _entropy(_weights(live, a)) >= goal)

    def repeats(a: float) -> float:
        w = _weights(live, a)
        return max(budget * w[s] / live[s] for s in live)

    if repeats(exponent) > max_repeats:     # flatter repeats small sources more
        exponent = 1 - bisect(lambda b: repeats(1 - b) <= max_repeats) if repeats(1.0) <= max_repeats else 1.0
    weights = {s: 0.0 for s in tokens} | _weights(live, exponent)
    return Mixture(exponent, weights, {s: round(budget * w) for s, w in weights.items()})


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
        budget: int | None = None, target: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
        seed: int = SEED) -> tuple[DataFrame, Mixture]:
    """Every row of ``docs`` with n_tokens, weight (of its source), copies and place.

    ``copies`` is how often the mixture uses the row, 0 included; ``place`` the
    tokens of its source before it in the permutation. A document in the last,
    partial block is used if the budget reaches past its start, so a source
    overshoots by less than one document. Null sources are a source of their
    own, documents without words are used as often as the permutation passes
    them; repeated rows are ranked each, in the order of a hash of id and text, and rows that are
    equal in both are interchangeable.
    """
    kept = [F.col(c) for c in docs.columns if c not in ("n_tokens", "weight", "copies", "place")]
    rows = docs.select(*kept, word_count(text).alias("n_tokens")).select(
        "*", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("_source"),
        F.xxhash64(F.lit(seed), id_col, text).alias("_h"))
    slim = materialise(rows.select(F.col(id_col).alias("_id"), "_source", "_h", "n_tokens"), "mixing")
    sums = slim.groupBy("_source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    found = sums.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    mixture = choose_mixture({r._source: r.t for r in found}, budget, target, max_repeats)
    buckets = max(1, -(-sum(r["n"] for r in found) // PER_BUCKET))
    plan = docs.sparkSession.createDataFrame(
        [(r._source, r.t, mixture.weights[r._source], mixture.budgets[r._source]) for r in found] or [],
        "_source string, _t long, weight double, _budget long")
    # The hash is uniform, so equal ranges of it are even buckets in hash order.
    bucket = F.floor((F.col("_h") / F.lit(2.0 ** 64) + 0.5) * buckets).cast("long")
    ranked = running_sum(rows.withColumn("_bucket", bucket), ["_source"], "_bucket",
                         ["_h", F.col(id_col)], F.col("n_tokens"), "place")
    blocks = F.when(F.col("_t") > 0, F.floor(F.col("_budget") / F.col("_t"))).otherwise(F.lit(0))
    rest = F.col("_budget") - blocks * F.col("_t")
    used = ranked.join(F.broadcast(plan), "_source")     # at most MAX_SOURCES rows
    copies = (blocks + (F.col("place") < rest).cast("long")).cast("long")
    return (used.withColumn("copies", copies).withColumn("place", F.col("place").cast("long"))
            .drop("_source", "_h", "_bucket", "_t", "_budget"), mixture)


def realise(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: each row as often as ``copies`` says, with its block number."""
    return (mixed.filter("copies > 0")
            .withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .drop("copies"))
