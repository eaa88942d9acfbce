"""Removal of repeated byte passages with suffix arrays.

A byte goes if some 200-byte string that covers it also starts elsewhere in the
corpus. One suffix array over everything would be one task; instead every
200-byte string is sent to the place named by its anchor: the smallest hash of
the ``GRAM``-byte strings inside it (rightmost of equals). Equal strings have
equal anchors, so repeats meet, and anchors seen once need no more work.

An anchor's context is all that its 200-byte strings can cover. Contexts seen
twice are repeated throughout. The others are put, group by group, into suffix
arrays built in two stages: only suffixes smaller than their successor are sorted
directly, the rest is induced by scanning the buckets in order. Neighbours with a
common prefix of 200 bytes are repeats.

A group with very many different contexts is split. Each share sends on every
string once, with a flag whether it is repeated there; a string that is single in
its share goes if any other place sends it too. So no group, however large, meets
in one task, and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revana.llm.common import Rolling, field, mix, slices, utf8
from revana.workspace import materialise, tidy

LENGTH = 200
GRAM = 100
WINDOW = LENGTH - GRAM + 1      # grams in one string
BEFORE = LENGTH - GRAM          # bytes a string can reach before its anchor
PIECE = 2 << 20                 # bytes of a long text handled in one step
CHUNK = 1 << 18                 # bytes of contexts in one suffix array, and then to the end of the group
SHARE = 2_000                   # contexts of one group that meet in one array


# ---- anchors ----------------------------------------------------------------------

def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[:len(keys) - (width - done)], keys[width - done:]) if width > done else keys


def anchors(data: np.ndarray, offsets: np.ndarray, low: int = 0, high: int | None = None):
    """(text index, position in ``data``, anchor, context) of the anchors of all
    strings that start in [low, high) and do not cross a text."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    rolling = Rolling(data)
    grams = rolling.grams(GRAM)
    keys = (grams & np.uint64(0xFFFFFFFF80000000)) | (np.uint64(0x7FFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    least = _smallest(keys, WINDOW)
    at = (np.uint64(0x7FFFFFFF) - (least & np.uint64(0x7FFFFFFF))).astype(np.int64)
    inside = np.zeros(len(at), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        inside[a:max(a, b - LENGTH + 1)] = True
    inside[:low] = False
    if high is not None:
        inside[high:] = False
    at = at[inside]
    if len(at):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    text = np.searchsorted(offsets, at, "right") - 1
    begin = np.maximum(at - BEFORE, offsets[text])
    end = np.minimum(at + LENGTH, offsets[text + 1])
    shape = ((at - begin) * 1024 + (end - at)).astype(np.uint64)
    context = mix(rolling.spans(begin, end) + shape * np.uint64(0x9E3779B97F4A7C15))
    return text, at, grams[at], context


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=PIECE):
        data, offsets = utf8(field(batch, "text"))
        if len(data) <= PIECE:
            found = [(*anchors(data, offsets), offsets)]
        else:                       # one long text, in overlapping pieces
            found, last = [], -1
            for start in range(0, len(data), PIECE):
                a, b = max(0, start - LENGTH), min(len(data), start + PIECE + 2 * LENGTH)
                text, at, anchor, context = anchors(data[a:b], np.array([0, b - a]), start - a, start - a + PIECE)
                new = at + a > last
                found.append((text[new], at[new] + a, anchor[new], context[new], offsets))
                last = int(at[-1]) + a if len(at) else last
        for text, at, anchor, context, starts in found:
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [field(batch, "doc").take(rows), field(batch, "h").take(rows), pa.array(at - starts[text]),
                 pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))],
                ["doc", "h", "pos", "anchor", "context"])


# ---- suffix arrays ------------------------------------------------------------------

def suffix_array(data: bytes, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``data`` in order of their first ``depth`` bytes, by two-stage sorting.

    With ``wanted`` (a mask of starts) only those and the ones they are induced
    from: a falling suffix needs its successors up to the next rising one.
    """
    n = len(data)
    t = np.frombuffer(data, np.uint8)
    # A suffix is smaller than its successor if its first differing byte is:
    # the last one never is, equal neighbours are as their right neighbour.
    rises = np.zeros(n, bool)
    differs = np.flatnonzero(t[:-1] != t[1:])
    nearest = np.searchsorted(differs, np.arange(n))
    known = nearest < len(differs)
    rises[known] = (t[:-1] < t[1:])[differs[nearest[known]]]
    needed = np.ones(n, bool)
    if wanted is not None and n:
        risers = np.append(np.flatnonzero(rises), n - 1)
        asked = np.flatnonzero(wanted)
        ends = risers[np.searchsorted(risers[:-1], asked)] + 1
        needed = np.cumsum(np.bincount(asked, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0
    direct = sorted(np.flatnonzero(rises & needed).tolist(), key=lambda i: data[i:i + depth])
    direct = np.array(direct, np.int64)
    direct_at = np.searchsorted(t[direct], np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~rises[before] & needed[before]]
        heads = t[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(heads) else []
        for a, b in zip(cuts, [*cuts[1:], len(heads)]):
            waiting[heads[a]].append(before[a:b])

    out: list[np.ndarray] = []
    if n and needed[-1]:
        waiting[t[-1]].append(np.array([n - 1]))        # the last suffix is first in its bucket
    for c in range(256):
        # Falling suffixes come before rising ones in a bucket; scanning them adds
        # more to the same bucket while the byte repeats.
        while waiting[c]:
            falling = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(falling)
            induce(falling)
        rising = direct[direct_at[c]:direct_at[c + 1]]
        if len(rising):
            out.append(rising)
            induce(rising)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether ``t`` has the same ``length`` (at least 8) bytes from each of ``a`` and ``b``; all must fit."""
    same = np.arange(len(a))
    words = np.ndarray(max(len(t) - 7, 0), "<u8", t, strides=(1,))      # eight bytes from every position
    for k in [*range(0, length - 8, 8), length - 8]:
        same = same[words[a[same] + k] == words[b[same] + k]]
    out = np.zeros(len(a), bool)
    out[same] = True
    return out


def repeated_strings(contexts: list[bytes], places: np.ndarray, copies: np.ndarray):
    """Which 200-byte strings of the contexts are repeated.

    ``places``: a number per context so that place + offset names the spot in the
    corpus, ``copies``: how often the context occurs. Returns the concatenated
    contexts, their offsets, and for every start in them: the number of its string
    (equal strings have one number; -1 where none fits) / whether that is repeated.
    """
    sizes = np.array([len(c) for c in contexts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = b"".join(contexts)
    t = np.frombuffer(data, np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    fits = np.arange(len(t)) + LENGTH <= offsets[owner + 1]
    order = suffix_array(data, wanted=fits)
    order = order[fits[order]]
    repeated, string = np.zeros(len(t), bool), np.full(len(t), -1)
    if len(order):
        run = np.concatenate([[0], np.cumsum(~common_prefix(t, order[:-1], order[1:]))])
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        spot = places[owner[order]] + order - offsets[owner[order]]
        many = np.maximum.reduceat(copies[owner[order]], first) > 1
        apart = np.minimum.reduceat(spot, first) != np.maximum.reduceat(spot, first)
        repeated[order] = (many | apart)[run]
        string[order] = run
    return data, offsets, string, repeated


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_NAMES = ["doc", "h", "start", "end", "anchor", "string", "many"]
_KINDS = [pa.int64()] * 6 + [pa.bool_()]


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, share) to covered stretches, and, for shares of a
    split group, one place of each string (with ``string``, and ``many`` if it is
    repeated in the share)."""
    held: list[tuple] = []
    size, key = 0, None
    for batch in batches:
        for row in zip(*(field(batch, c).to_pylist() for c in ("anchor", "share", "split", "doc", "h", "begin", "n", "bytes"))):
            if row[:2] != key and size >= CHUNK:
                yield _covered(held)
                held, size = [], 0
            key = row[:2]
            held.append(row)
            size += len(row[7])
    if held:
        yield _covered(held)


def _covered(rows: list[tuple]) -> pa.RecordBatch:
    anchor, _, split, doc, h, begin, n, contexts = zip(*rows)
    # Two contexts of one text can overlap: the same spot is not a repeat.
    texts = {k: i for i, k in enumerate(dict.fromkeys(zip(doc, h)))}
    places = np.array([(texts[k] << 40) + b for k, b in zip(zip(doc, h), begin)], np.int64)
    data, offsets, string, repeated = repeated_strings(list(contexts), places, np.array(n))
    out: list[tuple] = []
    for i in range(len(rows)):
        if n[i] > 1:            # covered throughout, by its copies
            continue
        for s, e in zip(*_runs(repeated[offsets[i]:offsets[i + 1]])):
            out.append((doc[i], h[i], begin[i] + int(s), begin[i] + int(e) - 1 + LENGTH, None, None, None))
    if any(split):
        owner = np.repeat(np.arange(len(rows)), np.diff(offsets))
        at = np.flatnonzero((string >= 0) & np.array(split)[owner])
        # A string can lie in contexts of several anchors: once for each of them.
        group = np.unique(np.array(anchor), return_inverse=True)[1]
        at = at[np.unique(string[at] * len(rows) + group[owner[at]], return_index=True)[1]]
        hashes = Rolling(np.frombuffer(data, np.uint8)).spans(at, at + LENGTH).view(np.int64)
        for i, p, x, many in zip(owner[at].tolist(), (at - offsets[owner[at]]).tolist(), hashes.tolist(), repeated[at].tolist()):
            out.append((doc[i], h[i], begin[i] + p, begin[i] + p + LENGTH, anchor[i], x, many))
    columns = zip(*out) if out else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS)], _NAMES)


# ---- the operator -------------------------------------------------------------------

@tidy
def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, spans): sorted, possibly overlapping [start, end) of the repeated bytes of each text.

    Texts are named by id and xxhash64, so rows that repeat, or share an id, are
    each counted as places of their own.
    """
    named = _named(docs, id_col, text)
    seen = named.mapInArrow(_anchor_rows, "doc long, h long, pos long, anchor long, context long")
    # A written table, so that adaptive execution can split a hot anchor in the join.
    twice = materialise(seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                        .select("anchor"), "twice")
    spots = materialise(seen.join(twice, "anchor", "left_semi"), "anchors")
    classes = materialise(spots.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("doc", "h", "pos"))), "contexts")
    whole = (spots.join(classes.filter("n > 1").select("anchor", "context"), ["anchor", "context"])
             .select("doc", "h", F.greatest(F.col("pos") - BEFORE, F.lit(0)).alias("start"),
                     (F.col("pos") + LENGTH).alias("end")))
    groups = (classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("fewest"))
              .filter("kinds > 1 AND fewest = 1")
              .select("anchor", F.ceil(F.col("kinds") / SHARE).alias("shares")))
    asked = (classes.join(groups, "anchor")
             .groupBy("doc", "h").agg(F.collect_list(F.struct("pos", "anchor", "n", "shares", "context")).alias("asked")))
    raw = F.col("text").cast("binary")
    contexts = named.join(asked, ["doc", "h"]).select(
        "doc", "h", F.inline(F.transform("asked", lambda a: F.struct(
            a["anchor"].alias("anchor"), F.pmod(a["context"], a["shares"]).alias("share"),
            (a["shares"] > 1).alias("split"), a["n"].alias("n"),
            F.greatest(a["pos"] - BEFORE, F.lit(0)).alias("begin"),
            F.substring(raw, (F.greatest(a["pos"] - BEFORE, F.lit(0)) + 1).cast("int"),
                        (F.least(a["pos"], F.lit(BEFORE)) + LENGTH).cast("int")).alias("bytes")))))
    compared = materialise(
        contexts.repartition("anchor", "share").sortWithinPartitions("anchor", "share")
        .mapInArrow(_suffix_rows, "doc long, h long, start long, end long, anchor long, string long, many boolean"),
        "compared")
    sent = compared.filter("string IS NOT NULL")
    met = (sent.groupBy("anchor", "string")
           .agg(F.count_distinct("doc", "h", "start").alias("n"), F.max("many").alias("_many"))
           .filter("n > 1 OR _many").select("anchor", "string"))
    across = sent.filter(~F.col("many")).join(met, ["anchor", "string"]).select("doc", "h", "start", "end")
    found = compared.filter("string IS NULL").select("doc", "h", "start", "end")
    return (whole.unionByName(found).unionByName(across)
            .groupBy("doc", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")))


def _named(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"),
                       F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept`` (binary, the remaining bytes).

    Null and empty texts have 0 bytes; texts under 200 bytes keep all. Own columns
    of those names are replaced. All judgement is on the input texts.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    own = [c for c in docs.columns if c not in added]
    spans = repeated_passages(docs, id_col, text)
    rows = docs.select(*own, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_doc"),
                       F.xxhash64(text).alias("_h"))
    rows = rows.join(spans.select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), F.col("spans").alias("_spans")),
                     ["_doc", "_h"], "left").select(*own, "_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, offsets = utf8(field(batch, text))
            removed, count, kept = [], [], []
            for i, spans in enumerate(field(batch, "_spans").to_pylist()):
                part = data[offsets[i]:offsets[i + 1]]
                gone = np.zeros(len(part), bool)
                for s in spans or ():
                    gone[s["start"]:s["end"]] = True
                removed.append(int(gone.sum()))
                count.append(len(_runs(gone)[0]))
                kept.append(part[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(field(batch, c) for c in own), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                 pa.array(count, pa.int64()), pa.array(kept, pa.binary())], [*own, *added])

    fields = docs.select(*own).schema
    for name, kind in zip(added, ("long", "long", "long", "binary")):
        fields = fields.add(name, kind)
    return rows.mapInArrow(cut, fields)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``. A character of which
    a part was cut goes as a whole, and a document of which no more than blanks is left;
    one that was not cut stays as it is, null and empty texts included."""
    left = remove_repeats(docs, id_col, text)
    uncut = F.col("n_removed") == 0
    whole = F.when(uncut, F.col(text)).otherwise(_decoded(F.col("kept")))
    return (left.withColumn(text, whole).filter(uncut | (F.length(F.trim(text)) > 0))
            .select(*docs.columns))


def _decoded(raw):
    # A cut can leave the start of a character without its end, or the reverse.
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\uFFFD", "")
