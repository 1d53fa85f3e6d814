"""Near-duplicate vectors by a pivot-permutation index with inverted lists of shared pivots."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..session import cut_lineage
from .base import components, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pivots a vector is described by: the first of these with which made partners at the threshold are found at rate FOUND;
#: if the last one is not enough, the number of pivots is halved until it is.
NEAREST, FOUND = range(6, 17), 0.95
#: Pivots that two vectors must share to be compared: two, and one more for each time the vectors exceed another of these.
SHARED, LARGE = 2, (1 << 20, 1 << 26)
#: Pivots: about PER_ROOT times the square root of the vectors, from LEAST to MOST; no two of them closer than APART.
PER_ROOT, LEAST, MOST, APART = 4, 16, 4096, 0.7
#: Rows of the sample beyond the pivots that FOUND is measured on.
TRIED = 1000
#: Rows of one list that one task compares at once; a longer list is cut into blocks of this many and pairs of blocks.
BLOCK = 1024
PAIRS = 1 << 20


def usable(vector: str | Column, label: str | Column, vec_id: str | Column) -> Column:
    """Whether a row can link at all: it has an id and a label, and finite components that are not all zero."""
    v, y, i = (F.col(c) if isinstance(c, str) else c for c in (vector, label, vec_id))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(i.isNotNull() & y.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Index(NamedTuple):
    """What describes vectors of one length: the middle of the sample, pivots around it, and how many of them count."""

    middle: np.ndarray
    pivots: np.ndarray
    nearest: int
    #: The rate at which made partners shared enough of them.
    found: float


def _around(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Unit vectors seen from the middle; equal ones with the middle stay zero."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    y = x / np.where(size > 0, size, 1) - middle
    size = np.linalg.norm(y, axis=1, keepdims=True)
    return y / np.where(size > 0, size, 1)


def _closest(y: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The places of the nearest pivots of each row, sorted."""
    return np.sort(np.argsort(-(y @ pivots.T), axis=1, kind="stable")[:, :nearest], axis=1)


def _partners(x: np.ndarray, threshold: float) -> np.ndarray:
    """For each row a vector whose cosine with it is ``threshold``, in a random direction (seed fixed)."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    side = np.random.default_rng(0).standard_normal(x.shape)
    side -= np.sum(side * x, axis=1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    return threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * side


def _fitted(x: np.ndarray, wanted: int, shared: int, threshold: float) -> Index:
    """The index of a sample of vectors of one length.

    Pivots are chosen as seen from the middle, so vectors around a common direction get as many as others. There two vectors
    near the threshold share fewer of them, so as many of the nearest count as partners made at the threshold need.
    """
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    middle = unit.mean(axis=0) if len(unit) > shared else np.zeros(x.shape[1])
    y = _around(unit, middle)
    pivots, used, n = np.zeros((wanted, x.shape[1])), [], 0
    for i in range(len(y)):
        if n < wanted and y[i].any() and (not n or np.max(pivots[:n] @ y[i]) < APART):
            pivots[n] = y[i]
            used.append(i)
            n += 1
    pivots = pivots[:n]
    if n < shared:
        return Index(middle, pivots, shared, 1.0)
    rest = np.delete(unit, used, axis=0)[:TRIED]
    if not len(rest):
        rest = unit[:TRIED]
    other = _around(_partners(rest, threshold), middle)
    rest = _around(rest, middle)
    while True:
        for nearest in NEAREST:
            a, b = _closest(rest, pivots, nearest), _closest(other, pivots, nearest)
            found = float(np.mean((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)) >= shared))
            if found >= FOUND or nearest >= len(pivots):
                return Index(middle, pivots, min(nearest, len(pivots)), found)
        pivots = pivots[: len(pivots) // 2]


def shared_pivots(count: int) -> int:
    """How many pivots two of ``count`` vectors must share."""
    return SHARED + sum(count > c for c in LARGE)


def choose_pivots(classes: DataFrame, count: int, threshold: float = 0.93) -> dict[int, Index]:
    """The index for each length of vector, fitted on a sample by hash of at most 4 * MOST, thinned to pivots that lie apart.

    Without thinning a large group of near copies would hold most pivots, and its members would not share their nearest.
    """
    wanted = max(LEAST, min(MOST, math.ceil(PER_ROOT * math.sqrt(count))))
    # Arrow keeps the components as numbers on the driver, not as objects.
    v = classes.select("v").orderBy(F.xxhash64("v")).limit(4 * wanted).toArrow().column("v").combine_chunks()
    dims = v.value_lengths().to_numpy()
    sample = {int(d): v.take(pa.array(np.flatnonzero(dims == d))).flatten().to_numpy().reshape(-1, d).astype(np.float64) for d in np.unique(dims)}
    return {d: _fitted(x, wanted, shared_pivots(count), threshold) for d, x in sample.items()}


def list_key(shared: int) -> list[str]:
    """Columns that name an inverted list: label, length, and the places of the pivots its vectors share."""
    return ["label", "dim", *(f"p{i}" for i in range(shared))]


def postings(classes: DataFrame, index: dict[int, Index], shared: int = SHARED) -> DataFrame:
    """(label, dim, p0, p1, ..., node, copies, v, near) for each choice of ``shared`` pivots among a vector's nearest ones.

    Two vectors share at least ``shared`` pivots if and only if they meet in one of these lists. A vector of a length without
    pivots, or with too few, meets all of its length under places of -1.
    """
    held = classes.sparkSession.sparkContext.broadcast(index)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            dims = v.value_lengths().to_numpy()
            near = [[-1] * shared] * len(dims)
            for dim in np.unique(dims):
                own = held.value.get(int(dim))
                if own is None or len(own.pivots) < shared:
                    continue
                at = np.flatnonzero(dims == dim)
                x = v.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                # Slabs keep the products small: one column a pivot.
                for s in range(0, len(at), BLOCK):
                    for i, places in zip(at[s : s + BLOCK], _closest(_around(x[s : s + BLOCK], own.middle), own.pivots, own.nearest).tolist(), strict=True):
                        near[i] = places
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], schema=batch.schema.append(pa.field("near", pa.list_(pa.int32()))))

    # As a table: the lists are counted and then read, and both must see the same nearest pivots.
    described, _ = written(classes.mapInArrow(describe, StructType([*classes.schema, StructField("near", ArrayType(IntegerType()))])))
    # near is sorted; a list's key is a choice of places in it.
    most = max([i.nearest for i in index.values()], default=shared)
    choices = F.array(*[F.array(*[F.lit(i) for i in c]) for c in combinations(range(most), shared)])
    key = F.transform(F.filter(choices, lambda c: F.element_at(c, -1) < F.size("near")), lambda c: F.transform(c, lambda i: F.get("near", i)))
    lists = described.select("*", F.size("v").alias("dim"), F.explode(key).alias("key"))
    return lists.select("label", "dim", *(F.col("key")[i].alias(f"p{i}") for i in range(shared)), "node", "copies", "v", "near")


def blocked(lists: DataFrame, shared: int = SHARED) -> DataFrame:
    """``lists`` with (left, right): the pair of blocks in which a row is compared; lists of one row are gone.

    A list of up to BLOCK rows is the block pair (0, 0). A longer one has as many blocks as it needs, and each row goes to
    every pair that its block is part of, so no task holds more than two blocks of a list.
    """
    key = list_key(shared)
    sizes = lists.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = lists.join(sizes, key).withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.select("*", other.alias("other")).withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")}).drop("other", "n", "blocks")


def _compare(group: dict, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(node, other rows it links with, smallest node linked with it here) of the rows of one or more whole block pairs.

    Rows come sorted by block pair. A pair of rows belongs to the list of its smallest shared pivots, so no pair counts
    twice; a pair of one block belongs to the block pair (b, b).
    """
    bounds, n = group["bounds"], len(group["node"])
    x = group["v"] / np.linalg.norm(group["v"], axis=1, keepdims=True)
    near, listed, own, left, right = (group[k] for k in ("near", "listed", "own", "left", "right"))
    # A shared pivot below the list's last one that is not its own would mean that another list owns the pair.
    foreign = (near[:, :, None] != listed[:, None, :]).all(axis=2)
    earlier = np.where((near < listed[:, -1:]) & foreign & (near >= 0), near, -1)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    found_a, found_b = [], []
    last = np.repeat(bounds[1:], np.diff(bounds)) - 1  # the last row of each row's block pair
    for gap in range(1, int(np.max(np.diff(bounds), initial=1))):
        a = np.flatnonzero(np.arange(n) + gap <= last)
        for s in range(0, len(a), PAIRS // 16):
            i = a[s : s + PAIRS // 16]
            j = i + gap
            ok = (left[i] == right[i]) | (own[i] != own[j])
            i, j = i[ok], j[ok]
            shares = np.zeros(len(i), dtype=bool)
            for p in range(near.shape[1]):
                e = earlier[i, p]
                shares |= (e >= 0) & (earlier[j] == e[:, None]).any(axis=1)
            i, j = i[~shares], j[~shares]
            hit = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            found_a.append(i[hit])
            found_b.append(j[hit])
    a, b = (np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in (found_a, found_b))
    if not len(a):
        return
    np.add.at(links, a, group["copies"][b])
    np.add.at(links, b, group["copies"][a])
    order = np.argsort(group["node"], kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    root = rank.copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    for i in np.flatnonzero(links):
        yield int(group["node"][i]), int(links[i]), int(group["node"][order[root[i]]])


def verified(pairs: DataFrame, threshold: float, shared: int = SHARED) -> DataFrame:
    """(node, links, root) from the rows of all block pairs: links counted and connected locally, no pair is emitted."""
    key = [*list_key(shared), "left", "right"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        held: pa.Table | None = None

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for dim in set(t.column("dim").to_pylist()):
                part = t.filter(pa.compute.equal(t.column("dim"), dim)).combine_chunks()
                flat = lambda name: part.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                g = {k: part.column(k).to_numpy() for k in ("left", "right", "own", "node", "copies")}
                g["listed"] = np.stack([part.column(f"p{i}").to_numpy() for i in range(shared)], axis=1)
                g["v"] = flat("v").reshape(-1, dim).astype(np.float64)
                near = part.column("near").to_pylist()
                wide = max(map(len, near))
                g["near"] = np.array([r + [-1] * (wide - len(r)) for r in near], dtype=np.int32)
                g["bounds"] = _bounds(part)
                out = list(_compare(g, threshold))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

        def _bounds(t: pa.Table) -> np.ndarray:
            change = np.zeros(t.num_rows, dtype=bool)
            change[0] = True
            for k in key:
                c = np.asarray(t.column(k).to_numpy(zero_copy_only=False))
                change[1:] |= c[1:] != c[:-1]
            return np.append(np.flatnonzero(change), t.num_rows)

        # Only whole block pairs are compared; the last one of a batch waits for the next batch.
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            cut = int(_bounds(held)[-2])
            if cut:
                yield from emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from emit(held)

    dealt = pairs.repartition(*key).sortWithinPartitions(*key, "node")
    return dealt.select(*key, "own", "node", "copies", "v", "near").mapInArrow(compare, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and their cosine, in double precision, is ``threshold`` or more. Null and zero
    vectors, null or non-finite components and a null label or id link with nothing; nor do vectors of different lengths.
    n_links counts the other rows found linked, component_id is the smallest vec_id that links reach, kept is vec_id =
    component_id (false for a null id). An id stands for one vector: rows that repeat an id with another vector share its
    links. An empty table gives no rows; other columns are not read.

    Equal vectors with equal labels collapse to a class first; their links to each other need no comparison. Candidates share
    at least two of their nearest pivots (more in very large tables); every candidate pair is verified, so no link is wrong,
    and a link is missed only where two vectors share fewer. How many of the nearest count is set on a sample by hash of at
    most 4 * MOST vectors, from partners made at the threshold; all rows are indexed. Lists are compared in blocks, links are summed per block, never emitted as pairs.
    """
    ok = usable(vector, label, vec_id)
    # Single-precision vectors travel as they are, in half the bytes, and are widened where they are compared.
    single = vectors.select(vector).dtypes[0][1] == "array<float>"
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(ok, F.col(vector) if single else F.col(vector).cast("array<double>")).alias("v"), F.when(ok, F.col(label).cast("string")).alias("label"))
    classes = cut_lineage(rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").cast("long").alias("node"), F.count("*").alias("copies")).select("node", "label", "copies", "v"))
    count = classes.count()
    shared = shared_pivots(count)
    index = choose_pivots(classes, count, threshold)
    found = cut_lineage(verified(blocked(postings(classes, index, shared), shared), threshold, shared))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "of")
    known = classes.join(links, "node", "left").join(roots, F.col("node") == F.col("of"), "left")
    known = cut_lineage(known.select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")))
    linked = rows.join(known, ["label", "v"], "left")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
