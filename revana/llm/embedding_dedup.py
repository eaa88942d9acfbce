"""Near-duplicate vectors by NN-descent.

Every vector keeps a list of its nearest neighbours so far. Starting from random
projections, each round introduces a vector's neighbours, and those that list it,
to each other, and keeps what is closer. Vectors whose whole list meets the
threshold are saturated: it may hide more links, so they are compared, in tiles,
with all vectors of their label that lie in other components. A sample of vectors
is compared with all others to audit the recall, per vector and for components of
every size; below ``RECALL`` the lists are doubled and refined again, and if the
last doubling is not enough, all vectors of a label are compared in tiles. The
links of a vector are then counted inside its component.

Only vectors of one label (and one dimension) are compared. Equal vectors are one
class with a count, so a vector that is copied a million times costs as much as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from revana.llm.common import components, field, groups
from revana.workspace import materialise, tidy

THRESHOLD = 0.93
NEIGHBOURS, ROUNDS, SETTLED = 10, 4, 0.002
TREES, LEAF, CELL = 6, 32, 256
TILE = 512
AUDITED, RECALL, DOUBLINGS = 1_000, 0.97, 2
SEED = 5


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten()).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str = "embedding", label: str = "label") -> Column:
    """A label, and a vector with only finite components that are not all zero."""
    v = F.col(vector)
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & ~broken & F.exists(v, lambda x: x != 0), F.lit(False))


def _nearest(sims: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int):
    """(p, q, sim) of up to ``k`` entries per row that exceed the row's floor, itself excluded."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sims, best, 1)
    row, col = np.nonzero(value > floor[:, None])
    return ids[row], ids[best[row, col]], value[row, col]


def _pairs(parts) -> pa.RecordBatch:
    parts = parts or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["p", "q", "sim"])


_PAIRS = "p long, q long, sim double"


def _batched(source, size: int = 500) -> Iterator[pa.RecordBatch]:
    parts = []
    for part in source:
        parts.append(part)
        if len(parts) == size:
            yield _pairs(parts)
            parts = []
    yield _pairs(parts)


def _projected(nodes: DataFrame, k: int) -> DataFrame:
    """First neighbours: vectors that fall on the same sides of random hyperplanes."""
    sizes = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    sized = nodes.join(sizes, "block").withColumn(
        "bits", F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / LEAF)))).cast("int"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, bits = field(batch, "vec"), np.asarray(field(batch, "bits"))
            sizes = np.asarray(vectors.value_lengths())
            out = np.zeros((batch.num_rows, TREES), np.int64)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = _matrix(vectors.take(pa.array(rows)))
                for tree in range(TREES):
                    planes = np.random.default_rng([SEED, tree, dim]).normal(size=(dim, 40))
                    sides = (x @ planes > 0) & (np.arange(40) < bits[rows][:, None])
                    out[rows, tree] = sides @ (1 << np.arange(40))
            yield pa.RecordBatch.from_arrays(
                [field(batch, "rep"), field(batch, "block"),
                 pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * TREES, pa.int32()),
                                          pa.array(out.ravel()))], ["rep", "block", "codes"])

    coded = materialise(sized.select("rep", "block", "vec", "bits")
                        .mapInArrow(codes, "rep long, block string, codes array<long>")
                        .select("rep", "block", F.posexplode("codes").alias("tree", "code")), "codes")
    cell = ["block", "tree", "code"]
    salts = coded.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / CELL).alias("salts"))
    cells = (coded.join(salts, cell)
             .withColumn("salt", F.pmod(F.xxhash64("rep", "tree"), F.col("salts")))
             .join(nodes.select("rep", "vec"), "rep").select(*cell, "salt", "rep", "vec"))
    keys = [*cell, "salt"]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for group in groups(batches, keys):
                x, ids = _matrix(group["vec"]), np.asarray(group["rep"])
                yield _nearest(x @ x.T, ids, np.full(len(ids), -1.5), k)
        yield from _batched(each())

    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(inside, _PAIRS)


def _shortened(pairs: DataFrame, k: int) -> DataFrame:
    best = pairs.groupBy("p", "q").agg(F.max("sim").alias("sim"))
    order = W.partitionBy("p").orderBy(F.desc("sim"), "q")
    return best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def _round(lists: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Neighbours of neighbours that are closer than what the lists hold."""
    order = W.partitionBy("q").orderBy(F.desc("sim"), "p")
    back = lists.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    around = (lists.select(F.col("p").alias("u"), F.col("q").alias("rep"))
              .union(back.select(F.col("q").alias("u"), F.col("p").alias("rep"))).distinct())
    floors = lists.groupBy(F.col("p").alias("rep")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-1.5)).alias("floor"))
    members = nodes.select("rep", "vec").join(floors, "rep").join(around, "rep")

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for group in groups(batches, ["u"]):
                x, ids = _matrix(group["vec"]), np.asarray(group["rep"])
                yield _nearest(x @ x.T, ids, np.asarray(group["floor"]), k)
        yield from _batched(each())

    closer = members.repartition("u").sortWithinPartitions("u").mapInArrow(introduce, _PAIRS)
    return _shortened(lists.union(closer), k)


def descend(nodes: DataFrame, lists: DataFrame | None, k: int, rounds: int = ROUNDS) -> DataFrame:
    """(p, q, sim): lists of at most ``k`` neighbours, refined until they settle."""
    lists = materialise(_shortened(_projected(nodes, k) if lists is None else lists, k), "lists")
    total = lists.agg(F.sum(F.col("sim") + 1)).first()[0] or 0.0
    for _ in range(rounds):
        lists = materialise(_round(lists, nodes, k), "lists")
        now = lists.agg(F.sum(F.col("sim") + 1)).first()[0] or 0.0
        if now - total <= SETTLED * now:
            break
        total = now
    return lists


def audit(nodes: DataFrame, roots: DataFrame, threshold: float, size: int = AUDITED) -> float:
    """Share of the links of up to ``size`` vectors, found by comparing them with
    all others, that lie inside one component: the mean over vectors, in the worst
    of the classes of vectors by their component's size (a power of two)."""
    chosen = nodes.orderBy(F.xxhash64("rep"), "rep").limit(size).select("rep", "block", "vec").toArrow()
    if not chosen.num_rows:
        return 1.0
    blocks = np.array(chosen["block"].to_pylist())
    asked = {b: (np.asarray(chosen["rep"])[blocks == b], _matrix(chosen["vec"].filter(pa.array(blocks == b))))
             for b in np.unique(blocks)}
    shared = nodes.sparkSession.sparkContext.broadcast(asked)      # ``size`` vectors

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(field(batch, "block").to_pylist())
            for b in np.unique(own):
                if b not in shared.value:
                    continue
                ids, x = shared.value[b]
                mask = pa.array(own == b)
                reps = np.asarray(field(batch, "rep").filter(mask))
                sims = x @ _matrix(field(batch, "vec").filter(mask)).T
                i, j = np.nonzero(sims >= threshold)
                other = ids[i] != reps[j]
                yield _pairs([(ids[i][other], reps[j][other], sims[i, j][other])])

    true = nodes.select("rep", "block", "vec").mapInArrow(links, _PAIRS)
    sizes = roots.groupBy("root").agg(F.floor(F.log2(F.count(F.lit(1)))).alias("class"))
    met = (true.join(roots.select(F.col("node").alias("p"), F.col("root").alias("a")), "p", "left")
           .join(roots.select(F.col("node").alias("q"), F.col("root").alias("b")), "q", "left"))
    each = met.groupBy("p", "a").agg(F.avg(F.coalesce((F.col("a") == F.col("b")).cast("int"), F.lit(0))).alias("found"))
    classes = (each.join(sizes.withColumnRenamed("root", "a"), "a", "left")
               .groupBy("class").agg(F.avg("found").alias("found")))
    worst = classes.agg(F.min("found")).first()[0]
    return 1.0 if worst is None else worst


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of entries of a mask, fewer than rows and columns together,
    that connect the same rows and columns as all of them."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    new_rows, new_cols = linked.any(axis=1), linked.any(axis=0)
    while new_rows.any():
        front = np.array([new_rows.argmax()])
        new_rows[front] = False
        while len(front):
            reached = np.flatnonzero(linked[front].any(axis=0) & new_cols)
            new_cols[reached] = False
            rows.append(front[linked[np.ix_(front, reached)].argmax(axis=0)])
            cols.append(reached)
            front = np.flatnonzero(linked[:, reached].any(axis=1) & new_rows)
            new_rows[front] = False
            rows.append(front)
            cols.append(reached[linked[np.ix_(front, reached)].argmax(axis=1)] if len(front) else front)
    return np.concatenate(rows), np.concatenate(cols)


def _saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """(rep): vectors whose list is full of links."""
    return lists.groupBy(F.col("p").alias("rep")).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least")).filter(
        (F.col("n") >= k) & (F.col("least") >= threshold)).select("rep")


def _across(nodes: DataFrame, chosen: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that connect what the links of the ``chosen`` vectors (rep) to
    other components connect.

    The chosen and all vectors of a block are cut into tiles, and each two tiles
    are one task, which returns fewer links than it has vectors.
    """
    rooted = nodes.select("rep", "block", "vec").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "rep"))
    asked = rooted.join(chosen, "rep", "left_semi")
    tiles = lambda df, name: df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).alias(name))
    sizes = materialise(tiles(asked, "m").join(tiles(rooted, "n"), "block"), "tiles")
    tile = lambda count: F.pmod(F.xxhash64("rep"), F.col(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    keys = ["block", "i", "j"]
    sent = (asked.join(sizes, "block").select("block", tile("m").alias("i"), each("n").alias("j"), "rep", "root", "vec", F.lit(0).alias("role"))
            .unionByName(rooted.join(sizes, "block").select(
                "block", each("m").alias("i"), tile("n").alias("j"), "rep", "root", "vec", F.lit(1).alias("role"))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, keys):
            x, reps = _matrix(group["vec"]), np.asarray(group["rep"])
            root, role = np.asarray(group["root"]), np.asarray(group["role"])
            own, other = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            linked = (x[own] @ x[other].T >= threshold) & (root[own][:, None] != root[other])
            row, col = _forest(linked)
            yield pa.RecordBatch.from_arrays([pa.array(reps[own[row]]), pa.array(reps[other[col]])], ["a", "b"])

    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def _link_counts(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(rep, others): vectors of other classes linked to each class that is in a component.

    A component of c classes is cut into tiles; each class goes to one task per
    tile of its component, which returns counts, not pairs.
    """
    inside = roots.select(F.col("node").alias("rep"), "root")
    sizes = inside.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    placed = (inside.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))))
    sent = (placed.select("rep", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
            .join(nodes.select("rep", "vec", "copies"), "rep"))
    keys = ["root", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = [], []
        for group in groups(batches, keys):
            x, reps = _matrix(group["vec"]), np.asarray(group["rep"])
            own, copies = np.asarray(group["own"]), np.asarray(group["copies"])
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if group["i"][0].as_py() != group["j"][0].as_py():      # pairs inside a tile are counted elsewhere
                linked &= own[:, None] != own
            ids.append(reps)
            counts.append(linked @ copies)
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts), pa.int64())], ["rep", "others"])

    return (sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "rep long, others long")
            .groupBy("rep").agg(F.sum("others").alias("others")))


@tidy
def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                           label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) per row.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    and rows without a label, have no links and are kept. Equal vectors of one
    label are linked with each other; repeated rows count as vectors each. A
    null id is never the id of a component. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"),
                          F.transform(vector, lambda x: x.cast("double")).alias("vec"),
                          usable(vector, label).alias("ok"))
    rows = materialise(rows.select(
        "id", "ok", "vec", F.when(F.col("ok"), F.concat_ws(":", F.col("label").cast("string"), F.size("vec"))).alias("block"),
        F.xxhash64(F.lit(1), "vec").alias("h1"), F.xxhash64(F.lit(2), "vec").alias("h2")), "vectors")
    key = ["block", "h1", "h2"]
    classes = materialise(rows.filter("ok").groupBy(*key).agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    nodes = materialise(rows.filter("ok").join(classes.filter("rep IS NOT NULL").withColumnRenamed("rep", "id"), [*key, "id"])
                        .dropDuplicates(["id", *key]).select(F.col("id").alias("rep"), "block", "vec", "copies"), "nodes")
    k, lists = NEIGHBOURS, None
    for _ in range(1 + DOUBLINGS):
        lists = descend(nodes, lists, k)
        close = lists.filter(F.col("sim") >= threshold).select(F.col("p").alias("a"), F.col("q").alias("b"))
        roots = components(close)
        full = materialise(_saturated(lists, k, threshold), "saturated")
        if not full.isEmpty():
            close = close.union(materialise(_across(nodes, full, roots, threshold), "across"))
            roots = components(close)
        if audit(nodes, roots, threshold) >= RECALL:
            break
        k *= 2
    else:
        roots = components(close.union(materialise(_across(nodes, nodes.select("rep"), roots, threshold), "across")))
    counts = _link_counts(nodes, roots, threshold)
    known = (classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
             .select(*key, F.coalesce("root", "rep").alias("component"),
                     (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n")))
    component = F.coalesce("component", "id")
    return rows.drop("vec").join(known, key, "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
