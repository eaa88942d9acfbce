"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of hashes of its word shingles. A sketch has ``COORDINATES``
bins. In each of the first ``COORDINATES`` rounds every shingle is hashed to one
bin; in as many further rounds all shingles go to one fixed bin each. A bin keeps
the smallest (round, hash). So every bin fills, whatever the size of the set, and
the share of equal bins of two sketches is concentrated around the Jaccard index
of the sets. The first ``BANDS * ROWS`` bins make the bands.

Equal sets are one class; only one document per class goes on. Documents with an
equal band of ``ROWS`` bins are candidates. A pair at the threshold of 0.8 shares
no band with probability (1 - 0.8^4)^32 < 5e-8. Candidates are confirmed on their
full sets. A bucket of candidates is not expanded to pairs: each member is first
compared with the smallest member it shares a bucket with; those that stay apart
from a bucket's pivot, another member for every band, are then compared with these
pivots. Members that are now connected need no more comparing. Those of different
components are compared one by one, in tiles of bounded size: first by their bins,
which tells what members have a plausible partner in the tile, then these on their full
sets. A tile returns links that connect what all its links connect, fewer than it
has members, so rows grow with members, not pairs, and no connection is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revana.llm.common import WHITE, Rolling, components, field, groups, lower_ascii, mix, slices, utf8, word_spans
from revana.workspace import materialise, tidy

COORDINATES, ROWS, BANDS = 512, 4, 32
SHINGLE, PERCENT = 4, 80
# Bins that must agree before full sets are compared. At the threshold 410 of 512
# agree on average with a standard deviation of 9, so 364 is five of them away.
AGREE = 364
PER_GROUP = 500             # candidates that are compared with one copy of a set
TILE = 1_000                # members of a bucket, and as many of those apart, that one task compares,
TILE_SHINGLES = 1 << 20     # and about so many shingles of each


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and offsets.

    Fewer words than ``width`` make one shingle; no word, no shingle.
    """
    data, offsets = utf8(texts)
    n = len(texts)
    low = lower_ascii()[data]
    starts, ends, doc = word_spans(low, offsets, WHITE)
    words = Rolling(low).spans(starts, ends)
    per = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(per)])
    count = np.where(per >= width, per - width + 1, np.minimum(per, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(n), count)
    head = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    shingles = mix(np.minimum(per, width)[row].astype(np.uint64))
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        word = np.where(k < per[row], padded[head + k], np.uint64(0))
        shingles = mix(shingles * np.uint64(0xC2B2AE3D27D4EB4F) + word)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        shingles[a:b].sort()
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (row[1:] != row[:-1])
    sizes = np.bincount(row[fresh], minlength=n)
    return shingles[fresh], np.concatenate([[0], np.cumsum(sizes)])


def sketch(sets: np.ndarray, offsets: np.ndarray, bins: int = COORDINATES) -> np.ndarray:
    """(sets, bins) matrix of (round, hash) values. Empty sets keep the largest value."""
    n = len(offsets) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, bins), empty)
    flat = out.reshape(-1)
    row, x = np.repeat(np.arange(n), np.diff(offsets)), sets
    for r in range(2 * bins):
        if not len(x):
            break
        h = mix(x ^ mix(np.full(1, r + 1, np.uint64)))
        to = (h & np.uint64(bins - 1)).astype(np.int64) if r < bins else np.full(len(x), r - bins)
        np.minimum.at(flat, row * bins + to, np.uint64(r << 54) | (h >> np.uint64(10)))
        open_ = (out == empty).any(axis=1)
        if not open_[row[0]] or not open_.all():
            keep = open_[row]
            row, x = row[keep], x[keep]
    return out


def _band_keys(sketches: np.ndarray) -> np.ndarray:
    n = len(sketches)
    keys = mix(np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy())
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + sketches[:, :BANDS * ROWS].reshape(n, BANDS, ROWS)[:, :, k])
    return keys


def sketch_documents(docs: DataFrame, id_col: str, width: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, s1, s2, bands, bins): s1 and s2 identify the set, ``bins``
    holds one byte per coordinate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, offsets = shingle_sets(field(batch, "text"), width)
            n = batch.num_rows
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(c)), dtype=np.uint64)])
                    for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
            sketches = sketch(sets, offsets)
            bands = _band_keys(sketches).view(np.int64).ravel()
            bins = mix(sketches).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [field(batch, id_col), pa.array(np.diff(offsets)),
                 *(pa.array((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64)) for s in sums),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands)),
                 pa.array([b.tobytes() for b in bins], pa.binary())],
                [id_col, "n_shingles", "s1", "s2", "bands", "bins"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(
        run, f"{id_col} {kind}, n_shingles long, s1 long, s2 long, bands array<long>, bins binary")


def _plausible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and bins allow the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(field(batch, c).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                    for c in ("x", "y"))
            keep = pa.array((x == y).sum(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([field(batch, c).filter(keep) for c in ("a", "b")], ["a", "b"])

    left = info.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("bins").alias("x"))
    right = info.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("bins").alias("y"))
    sized = pairs.join(left, "a").join(right, "b").filter(
        100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return sized.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verify(texts: DataFrame, pairs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold.

    The set of ``a`` is sent once per ``PER_GROUP`` partners, those of the
    partners once per pair, to a task that streams over them.
    """
    grouped = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PER_GROUP)))
    roles = (grouped.select(F.col("b").alias("doc"), F.col("a").alias("grp"), "salt", F.lit(1).alias("role"))
             .unionByName(grouped.select(F.col("a").alias("doc"), F.col("a").alias("grp"), "salt",
                                         F.lit(0).alias("role")).distinct()))
    # Merged by shuffle at every size, so that the cost per row does not depend on it.
    rows = texts.join(roles.hint("merge"), "doc")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, at = shingle_sets(field(batch, "text"), width)
            raw = [found[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(field(batch, c) for c in ("doc", "grp", "salt", "role")), pa.array(raw, pa.binary())],
                ["doc", "grp", "salt", "role", "shingles"])

    shipped = (rows.mapInArrow(sets, "doc long, grp long, salt long, role int, shingles binary")
               .repartition("grp", "salt").sortWithinPartitions("grp", "salt", "role"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            out = []
            for doc, grp, salt, role, raw in zip(*(field(batch, c).to_pylist() for c in batch.schema.names)):
                mine = np.frombuffer(raw, np.uint64)
                if role == 0:
                    key, own = (grp, salt), mine
                elif key == (grp, salt):
                    both = np.concatenate([own, mine])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    if 100 * same >= PERCENT * (len(both) - same):
                        out.append((grp, doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return shipped.mapInArrow(compare, "a long, b long")


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``, by shingles of ``width`` words.

    Texts without words, null texts included, have an empty set and are linked
    with nothing. Rows that repeat are one class; each gets a result row. A row
    with a null id takes part through its class and is kept only if it is in no
    component with an id. Other columns are ignored.
    """
    sketches = materialise(sketch_documents(docs, id_col, width), "sketches")
    key = ["n_shingles", "s1", "s2"]
    classes = materialise(sketches.filter("n_shingles > 0").groupBy(*key)
                          .agg(F.min(F.col(id_col).cast("long")).alias("rep")), "classes")
    chosen = classes.filter("rep IS NOT NULL")
    info = materialise(
        sketches.join(chosen.withColumnRenamed("rep", id_col), [*key, id_col])
        .select(F.col(id_col).cast("long").alias("rep"), "n_shingles", "bands", "bins"), "info")
    banded = info.select("rep", "n_shingles", F.explode("bands").alias("band"))
    # A pivot per band by a hash that differs from band to band.
    ends = (banded.groupBy("band").agg(
        F.min("rep").alias("low"), F.max("rep").alias("high"),
        F.min_by("rep", F.xxhash64("rep", "band")).alias("pivot"))
        .filter("low < high").drop("high"))
    members = materialise(banded.join(ends, "band").distinct(), "members")
    slim = info.select("rep", "n_shingles", "bins")
    binned = info.select("rep", "n_shingles", "bands", "bins")
    wanted = members.select(F.col("rep").alias("doc")).distinct().hint("merge")
    texts = materialise(docs.select(F.col(id_col).cast("long").alias("doc"), "text")
                        .join(wanted, "doc", "left_semi"), "candidates")

    def confirmed(plausible: DataFrame) -> DataFrame:
        plausible = materialise(plausible, "plausible")
        sizes = plausible.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        return materialise(verify(texts, materialise(plausible.join(sizes, "a"), "pairs"), width), "links")

    def roots(links: list[DataFrame]) -> DataFrame:
        return components(reduce(DataFrame.union, links))

    found: list[DataFrame] = []
    tried: list[DataFrame] = []
    first = members.groupBy(F.col("rep").alias("b")).agg(F.min("low").alias("a")).filter("a <> b").select("a", "b")
    tried.append(materialise(first, "tried"))
    found.append(confirmed(_plausible(tried[-1], slim)))
    state = roots(found)
    second = _labelled(members, state).filter("root <> pivot_root").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    tried.append(materialise(_ordered(second.distinct()).join(_ordered(tried[0]), ["a", "b"], "left_anti"), "tried"))
    found.append(confirmed(_plausible(tried[-1], slim)))
    state = roots(found)
    # What a bucket still holds apart: members outside its pivot's component,
    # against all members of other components.
    labelled = _labelled(members, state)
    buckets = labelled.filter("root <> pivot_root").select("band").distinct()
    labelled = materialise(labelled.join(buckets, "band", "left_semi").select(
        "band", "rep", "root", (F.col("root") != F.col("pivot_root")).alias("apart"), "n_shingles"), "apart")
    if not labelled.isEmpty():
        found.append(materialise(_apart_links(labelled, binned, texts, width), "links"))
        state = roots(found)
    labels = (classes.join(state.withColumnRenamed("node", "rep"), "rep", "left")
              .select(*key, F.coalesce("root", "rep").alias("_component")))
    result = sketches.drop("bands", "bins").join(labels, key, "left")
    component = F.coalesce("_component", F.col(id_col).cast("long"))
    return result.select(id_col, "n_shingles", component.alias("component_id"),
                         F.col(id_col).cast("long").eqNullSafe(component).alias("kept"))


_PLACE = ["band", "block", "tile"]
_MEMBER = "band long, block long, tile long, role int, rep long, root long, apart boolean, n_shingles long, bands array<long>, bins binary"


def _tiled(labelled: DataFrame) -> DataFrame:
    """(band, block, tile, rep, root, apart, role): the members of each bucket with
    members ``apart`` in tiles (role 1), and those apart in blocks (role 0); each
    block meets each tile. Both are cut by number and by shingles."""
    parts = lambda n, size: F.greatest(F.ceil(n / TILE), F.ceil(size / TILE_SHINGLES))
    own_size = F.when(F.col("apart"), F.col("n_shingles")).otherwise(0)
    sizes = labelled.groupBy("band").agg(
        parts(F.count(F.lit(1)), F.sum("n_shingles")).alias("tiles"),
        parts(F.count_if("apart"), F.sum(own_size)).alias("blocks"))
    sized = labelled.drop("n_shingles").join(sizes, "band")
    own = lambda count: F.pmod(F.xxhash64("rep", "band"), F.col(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    every = sized.filter("blocks > 0").select(
        "band", each("blocks").alias("block"), own("tiles").alias("tile"), "rep", "root", "apart", F.lit(1).alias("role"))
    alone = sized.filter("apart").select(
        "band", own("blocks").alias("block"), each("tiles").alias("tile"), "rep", "root", "apart", F.lit(0).alias("role"))
    return every.unionByName(alone)


def _plausible_partners(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Of one tile: (row of a member apart, rows of members of other components whose
    sizes and bins allow the threshold).

    One of two members with different components is apart in every bucket they
    share, so a pair is compared in the first of these only, and if both are apart
    there the smaller one asks.
    """
    role, rep, root, apart, size = (np.asarray(group[c]) for c in ("role", "rep", "root", "apart", "n_shingles"))
    bins = np.frombuffer(b"".join(group["bins"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
    bands = np.asarray(group["bands"].combine_chunks().flatten()).reshape(-1, BANDS)
    place = int((bands[0] == group["band"][0].as_py()).argmax())
    there = np.flatnonzero(role == 1)
    for i in np.flatnonzero(role == 0).tolist():
        fit = there[(root[there] != root[i]) & (~apart[there] | (rep[i] < rep[there]))
                    & (100 * np.minimum(size[there], size[i]) >= PERCENT * np.maximum(size[there], size[i]))]
        fit = fit[~(bands[fit, :place] == bands[i, :place]).any(axis=1)]
        near = fit[(bins[fit] == bins[i]).sum(axis=1) >= AGREE]
        if len(near):
            yield i, near


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that have a plausible partner there."""
    for group in groups(batches, _PLACE):
        chosen = np.zeros(group.num_rows, bool)
        for i, near in _plausible_partners(group):
            chosen[i] = chosen[near] = True
        if chosen.any():
            yield from group.filter(pa.array(chosen)).to_batches()


def _linked_in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each tile that meet the threshold on full sets, none between
    members that are connected already."""
    for group in groups(batches, _PLACE):
        rep, root = np.asarray(group["rep"]), np.asarray(group["root"])
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        label = np.unique(root, return_inverse=True)[1]         # of the component, so far
        out = []
        for i, near in _plausible_partners(group):
            near = near[label[near] != label[i]]
            if not len(near):
                continue
            their = np.concatenate([sets[j] for j in near])
            at = np.minimum(np.searchsorted(sets[i], their), len(sets[i]) - 1)
            same = np.add.reduceat((sets[i][at] == their).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            for j in near[100 * same >= PERCENT * (sizes[i] + sizes[near] - same)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((rep[i], rep[j]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])


def _apart_links(labelled: DataFrame, info: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Links (a, b) that connect what the links between members of one bucket but
    two components connect."""
    rows = _tiled(labelled).join(info, "rep").select(*_PLACE, "role", "rep", "root", "apart", "n_shingles", "bands", "bins")
    tiled = rows.repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    asked = materialise(tiled.mapInArrow(_with_partner, _MEMBER), "partners")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, at = shingle_sets(field(batch, "text"), width)
            raw = [found[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            full = pa.array(np.diff(at) > 0)        # a repeated id can also name a text without words
            yield pa.RecordBatch.from_arrays([field(batch, "rep").filter(full), pa.array(raw, pa.binary()).filter(full)],
                                             ["rep", "shingles"])

    # Candidates are one row per class, so each set is made once.
    wanted = texts.withColumnRenamed("doc", "rep").join(asked.select("rep").distinct().hint("merge"), "rep", "left_semi")
    shipped = asked.join(wanted.mapInArrow(sets, "rep long, shingles binary").hint("merge"), "rep")
    return shipped.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(_linked_in_tiles, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _labelled(members: DataFrame, state: DataFrame) -> DataFrame:
    """``members`` with the component of the member and of the bucket's pivot."""
    out = members
    for column, name in (("rep", "root"), ("pivot", "pivot_root")):
        out = (out.join(state.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left")
               .withColumn(name, F.coalesce(name, column)))
    return out
