"""Document fingerprints by winnowing, in SQL functions only.

A text's lower-cased words (letters and digits; characters of scripts without
blanks, and of runs over ``LONG`` characters, are words each) give hashes of every
``k`` words in a row. In every window of such hashes the smallest is chosen, the
rightmost of equal ones, and its position is kept. Two texts that share
``k + window - 1`` words in a row therefore always share a fingerprint, with
positions that point into that run. For documents ``FINE_K`` and ``FINE_WINDOW``
hold; a text of up to ``SHORT`` hashes keeps them all, so that half of it is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

K, WINDOW = 5, 16
MATCH_WORDS = K + WINDOW - 1
FINE_K, FINE_WINDOW, SHORT = 2, 4, 16
LONG = 32
PER_BUCKET, MAX_BUCKETS = 1_000, 100_000

_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
_JOINED = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_SINGLE}]]"
_WORD = rf"[{_SINGLE}]|(?<!{_JOINED}){_JOINED}{{1,{LONG}}}(?!{_JOINED})|{_JOINED}"
_LOW = 0xFFFFFFFF


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def winnow(text: Column, k: int = K, window: int = WINDOW, short: int = 0) -> Column:
    """array<struct<position, hash>>: the chosen hashes by position (in words).

    Fewer words than ``k`` are hashed as one, fewer hashes than ``window`` are one
    window, up to ``short`` hashes are all chosen; a null text or one without words has no fingerprint (empty array).
    """
    def select(grams: Column) -> Column:
        # Hash in the upper half, inverted position below: the minimum is the
        # smallest hash and, among equal ones, the rightmost.
        keys = F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 33), 32).bitwiseOR(
            F.lit(_LOW) - i.cast("long")))
        chosen = let(keys, lambda v: F.when(F.size(v) <= short, v).when(F.size(v) <= window, F.array(F.array_min(v))).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - F.lit(window - 1)),
                                         lambda i: F.array_min(F.slice(v, i, window))))))
        place = lambda m: F.lit(_LOW) - m.bitwiseAND(F.lit(_LOW))
        return F.transform(chosen, lambda m: F.struct(
            place(m).alias("position"), F.get(grams, place(m).cast("int")).alias("hash")))

    def grams(words: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(words) - F.lit(k)), lambda i: F.xxhash64(
            *(F.get(words, i + j) for j in range(k))))
        return F.when(F.size(words) >= k, every).otherwise(F.array(F.xxhash64(words)))

    def fingerprint(words: Column) -> Column:
        found = let(grams(words), select)
        return F.when(F.size(words) > 0, found).otherwise(F.slice(found, 1, 0))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))
    return let(F.transform(words, lambda w: F.xxhash64(w)), fingerprint)


def hashes(text: Column) -> Column:
    """array<long>: the hashes of a document's fingerprint by position."""
    return F.transform(winnow(text, FINE_K, FINE_WINDOW, SHORT), lambda f: f["hash"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of hashes; 1 if both are empty."""
    def index(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        union = F.size(F.array_union(x, y))
        return F.when(union == 0, F.lit(1.0)).otherwise(both / union)
    return let(a, lambda x: let(b, lambda y: index(x, y)))


def as_text(fingerprint: Column) -> Column:
    """The hashes in order of position, 8 hexadecimal digits (upper half) each."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(
        F.lower(F.hex(F.shiftrightunsigned(h, 32))), 8, "0")), "")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "winnowed") -> DataFrame:
    return docs.withColumn(out, hashes(F.col(text)))


def with_next(docs: DataFrame, id_col: str, columns: list[str], tie: str = "text") -> DataFrame:
    """``id_col``, ``columns`` and their values ``next_*`` in the next row by
    descending id; the row after the last is the first.

    A null id comes after all others, rows of one id in order of ``tie`` (null
    first). No global order: ids fall into ranges, each range is one window, and
    the first row of a range also goes, as a guest, to the range before it. The
    number of ranges, and so the broadcast table of guests, is bounded.
    """
    lowest = F.lit(-(1 << 63))
    base = docs.select(id_col, *columns).withColumn("_k", F.coalesce(F.col(id_col).cast("long"), lowest))
    stats = docs.agg(F.min(id_col), F.max(id_col), F.count(F.lit(1))).first()
    low, high, n = stats[0] or 0, stats[1] or 0, stats[2]
    buckets = min(MAX_BUCKETS, max(1, -(-n // PER_BUCKET)))
    width = max(1.0, (float(high) - float(low) + 1) / buckets)

    def bucket(id_: Column) -> Column:
        return F.when(id_.isNull(), F.lit(-1)).otherwise(
            F.floor((id_.cast("double") - F.lit(float(low))) / F.lit(width))).cast("long")

    first = (docs.groupBy(bucket(F.col(id_col)).alias("_b"))
             .agg(F.max(F.coalesce(F.col(id_col).cast("long"), lowest)).alias("_k")))
    up = W.orderBy("_b")                          # at most MAX_BUCKETS + 1 rows
    least = F.min("_b").over(W.partitionBy())
    guests = first.select("_k", F.coalesce(F.lead("_b").over(up), least).alias("_to"))
    placed = (base.withColumn("_b", bucket(F.col(id_col)))
              .join(F.broadcast(guests), "_k", "left")
              .withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g"))))
                                           .otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g")),
                                                              F.struct(F.col("_to").alias("b"), F.lit(1).alias("g")))))))
    order = W.partitionBy("_at.b").orderBy(F.col("_at.g"), F.desc("_k"), F.col(tie).asc_nulls_first())
    return (placed.select(id_col, *columns, "_at", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
            .filter(F.col("_at.g") == 0).drop("_at"))


def half_edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 2) characters replaced by the first as many of ``following``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))
