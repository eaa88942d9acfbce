"""Greedy longest match against a lexicon, for scripts without blanks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from revana.functions.text import windows
from revana.operators.lookup import union_all, word_lookup
from revana.workspace import materialise

# Size up to which a lexicon is sent to all tasks: twice the words of a large dictionary.
BROADCAST_WORDS, BROADCAST_CHARS = 1_000_000, 8_000_000
SLICE = 1 << 20         # bytes of text that a task cuts before it hands on the tokens
PAIRS = 1 << 20         # codes of two neighbouring characters


class Index:
    """Words by their first two characters: which lengths to try, longest first."""

    def __init__(self, words: list[str]):
        lengths: dict[str, set[int]] = {}
        for w in words:
            lengths.setdefault(w[:2], set()).add(len(w))
        self.words = frozenset(words)
        self.lengths = {head: tuple(sorted(n, reverse=True)) for head, n in lengths.items()}

    def cut(self, text: str) -> list[str]:
        lengths, words = self.lengths, self.words
        out, at, n = [], 0, len(text)
        while at < n:
            for size in lengths.get(text[at:at + 2], ()):
                piece = text[at:at + size]
                if piece in words:
                    out.append(piece)
                    at += size
                    break
            else:
                out.append(text[at])
                at += 1
        return out


def lexicon_tokens(df: DataFrame, lexicon: DataFrame, col: str = "content",
                   id_col: str = "doc_id", out: str = "tokens",
                   broadcast_words: int = BROADCAST_WORDS, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Cut each text from left to right, at every place into the longest lexicon
    word that starts there, or else into a single character. A null text has no tokens.

    A lexicon of up to ``broadcast_words`` words and ``broadcast_chars`` characters,
    which is measured, goes to all tasks as an index by the first two characters:
    most places need one look-up, whatever the number of words, and nothing is
    shuffled. With a larger one, texts are first cut wherever two characters meet that
    no word holds side by side, as no match crosses such a place. Of these pieces only the
    distinct ones meet the lexicon, and only those that are no word themselves are cut
    further, by a join on their substrings.
    """
    words = lexicon.select(F.col("word").alias("_w")).filter(F.length("_w") > 1).distinct()
    words = materialise(words, "lexicon")
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_w")).alias("chars"), F.max(F.length("_w")).alias("longest")).first()
    if size.n <= broadcast_words and (size.chars or 0) <= broadcast_chars:
        return _tokenized(df, Index([r[0] for r in words.collect()]), col, out)
    pieces = Pieces(words)
    found = materialise(_distinct_pieces(df, pieces, col), "pieces")
    cut = materialise(_cut_pieces(found.join(words.withColumnRenamed("_w", "word"), "word", "left_anti"), words, size.longest), "cut-pieces")
    rest = cut.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars")).first()
    if rest.n <= broadcast_words and (rest.chars or 0) <= broadcast_chars:
        pieces.sizes = {r.word: tuple(r.sizes) for r in cut.select("word", "sizes").collect()}
        return _tokenized(df, pieces, col, out)
    return _joined(df, cut, pieces, col, out)


def _slices(batch: pa.RecordBatch, col: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch of about ``SLICE`` bytes of text, a longer text alone."""
    column = batch.schema.get_field_index(col)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        part = batch.slice(at, end - at)
        yield part, part.column(column).to_pylist()
        at = end


def _tokenized(df: DataFrame, cutter: Index | Pieces, col: str, out: str, more: str | None = None) -> DataFrame:
    """``df`` with the tokens that ``cutter`` finds in the text and, if given, column ``more``."""
    shared = df.sparkSession.sparkContext.broadcast(cutter)     # measured above
    kept = [c for c in df.columns if c not in (out, more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value.cut
        for batch in batches:
            for part, texts in _slices(batch, "_text"):
                beside = [part.column(part.schema.get_field_index(more)).to_pylist()] if more else []
                tokens = pa.array([cut(t, *b) if t else [] for t, *b in zip(texts, *beside)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), tokens], [*kept, out])

    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    return df.select(*kept, *([more] if more else []), F.col(col).alias("_text")).mapInArrow(run, schema)


class Pieces:
    """Texts cut where two characters meet that no word holds side by side.

    Pairs of characters are kept as ``PAIRS`` bits by a hash of the two; pairs that share a
    bit only make pieces longer. ``sizes``: the tokens' lengths of pieces that are not one token.
    """

    def __init__(self, words: DataFrame):
        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, part in _slices(batch, "_w"):
                    # A line feed between words; pairs with it are left out.
                    chars = _points("\n".join(w.replace("\n", "\n\n") for w in part))
                    inside = (chars[:-1] != 10) & (chars[1:] != 10)
                    found = [_codes(chars)[inside], *(_codes(_points(w)) for w in part if "\n" in w)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["code"])

        self.held = np.zeros(PAIRS, bool)
        self.held[[r.code for r in words.mapInArrow(codes, "code long").distinct().collect()]] = True    # PAIRS at most
        self.sizes: dict[str, tuple[int, ...]] = {}

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        ends = np.flatnonzero(~self.held[_codes(_points(text))]) + 1
        at = 0
        for end in [*ends.tolist(), len(text)]:
            yield at, end
            at = end

    def cut(self, text: str, hits: list | None = None) -> list[str]:
        """Tokens of a text; ``hits``: (start, lengths of the tokens) of pieces that are not one token."""
        out, known = [], {h["at"]: h["sizes"] for h in hits or ()}
        for at, end in self.spans(text):
            piece = text[at:end]
            sizes = known.get(at) or self.sizes.get(piece)
            if sizes is None:
                out.append(piece)
                continue
            for size in sizes:
                out.append(text[at:at + size])
                at += size
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _codes(chars: np.ndarray) -> np.ndarray:
    return (chars[:-1] * 1_000_003 + chars[1:] * 8_191) % PAIRS


def _distinct_pieces(df: DataFrame, pieces: Pieces, col: str) -> DataFrame:
    """(word, n): the pieces of two and more characters, and how often they occur."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = shared.value.spans
        for batch in batches:
            for _, texts in _slices(batch, "_text"):
                found = Counter(t[a:b] for t in texts if t for a, b in spans(t) if b - a > 1)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return (df.select(F.col(col).alias("_text")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _cut_pieces(found: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """(word, n, sizes) of distinct pieces: the lengths of their tokens."""
    coded = (found.join(_match(found, words, longest, "word", "word"), "word", "left")
             .withColumn("_chars", F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)))
             .withColumn("_coded", _code_matches(longest)))
    return coded.select("word", "n", F.transform(_cut(F.col("_coded"), longest), lambda t: F.length(t)).alias("sizes"))


def _joined(df: DataFrame, cut: DataFrame, pieces: Pieces, col: str, out: str) -> DataFrame:
    """As ``_tokenized``, for more cut pieces than a task holds: they meet their places in
    the texts in a join. Rows are numbered and written, as ids may repeat."""
    texts = materialise(df.drop(out).withColumn("_row", F.monotonically_increasing_id()) if out != col
                        else df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = shared.value.spans
        for batch in batches:
            for part, found in _slices(batch, "_text"):
                rows = [(r, a, t[a:b]) for r, t in zip(part.column(0).to_pylist(), found) if t for a, b in spans(t) if b - a > 1]
                row, at, word = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(at, pa.int32()), pa.array(word, pa.string())],
                                                 ["_row", "at", "word"])

    facts = texts.select("_row", F.col(col).alias("_text")).mapInArrow(places, "_row long, at int, word string")
    hits = (union_all([p.select("_row", F.struct("at", "sizes").alias("_hit")) for p in word_lookup(facts, cut)])
            .groupBy("_row").agg(F.collect_list("_hit").alias("_hits")))
    return _tokenized(texts.join(hits, "_row", "left"), pieces, col, out, "_hits").drop("_row")


def _cut(coded: Column, max_len: int) -> Column:
    """Coded text: a character with the code n is the first of n that belong together."""
    one_of = "|".join(f"\\x{{{0x100 + n:x}}}.(?:..){{{n - 1}}}" for n in range(1, max_len + 1))
    pieces = F.regexp_extract_all(coded, F.lit(f"(?s){one_of}"), F.lit(0))
    return F.transform(pieces, lambda p: F.when(F.length(p) == 2, F.substring(p, 2, 1)).otherwise(
        F.regexp_replace(p, "(?s).(.)", "$1")))


def _code(n: int) -> str:
    return chr(0x100 + n)


def _match(df: DataFrame, words: DataFrame, max_len: int, col: str, id_col: str) -> DataFrame:
    """Matches (position, length) of each document, the longest per position."""
    return (df.select(id_col, F.posexplode_outer(windows(F.col(col), max_len)).alias("_pos", "_win"))
            .filter(F.length("_win") > 1)
            .select(id_col, "_pos", "_win",
                    F.explode(F.sequence(F.lit(2), F.length("_win"))).alias("_len"))
            .select(id_col, "_pos", "_len", F.expr("substr(_win, 1, _len)").alias("_w"))
            .join(words, "_w", "left_semi")
            .repartition(id_col)
            .groupBy(id_col, "_pos").agg(F.max("_len").alias("_len"))
            .groupBy(id_col)
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "_len"))).alias("_hits")))


def _code_matches(max_len: int) -> Column:
    """Coded text: from each match to the next, the first character has the
    length of the match and the others stand alone."""
    chars = F.col("_chars")
    codes = F.lit("".join(map(_code, range(1, max_len + 1))))
    hits = F.concat(F.array(F.struct(F.lit(0).alias("_pos"), F.lit(1).alias("_len"))), F.coalesce(
        F.col("_hits"), F.array().cast("array<struct<_pos:int,_len:int>>")))
    nexts = F.concat(F.transform(F.slice(hits, 2, F.size(hits)), lambda h: h["_pos"]),
                     F.array(F.size(chars)))

    def segment(h):
        part = F.slice(chars, h["h"]["_pos"] + 1, h["n"] - h["h"]["_pos"])
        code = codes.substr(h["h"]["_len"], F.lit(1))
        return F.when(F.size(part) > 0, F.concat(code, F.array_join(part, _code(1)))).otherwise("")

    return F.array_join(F.transform(F.arrays_zip(hits.alias("h"), nexts.alias("n")), segment), "")
