"""Near-duplicates by the Jaccard similarity of five-word shingles.

Sets of a similarity of 4/5 or more share some of their smallest hashes, three tenths of each set: most pairs meet there. Under
a hash that many sets have, mostly from a passage they share, its sets are not compared; sets with many such hashes meet again,
under the hashes of the whole set that are rarest among them: sorted by that, two near sets share one of the first fifth. A text
that shares a passage only, or has changes of its own, has hashes of its own there, and the place of the shared one tells that it
can't be near. No pair is left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import components, drop, free_name, whole_text, written
from .simhash import fingerprint, leaders

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
#: Similarity from which two texts are near copies: 4 / 5.
PART, WHOLE = 4, 5
#: A hash of more than this many rows brings its sets to the second meeting, by rarity.
CROWD = 16
#: Keeps the keys of the second meeting apart from those of the first.
ASIDE = 0x2545F4914F6CDD1D
#: Crowds whose open pairs are more than this many a member are first compared with one member at a time.
SPARSE = 256
#: Rounds of that before all open pairs are compared.
ROUNDS = 4
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits to 64 bits, one to one, each bit of the result depending on all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hashes(text: str) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of ``text``; with fewer words the whole sequence is one shingle."""
    # Of bytes, lower() changes A-Z only and split() cuts at space, tab, and the four line and page marks: 0x20, 0x09-0x0D.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=U, count=len(words))
    width = min(WIDTH, len(w))
    if not width:
        return w
    n = len(w) - width + 1
    out = np.full(n, width, dtype=U)
    for k in range(width):
        out = mixed(out * U(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(out)


def identity(h: np.ndarray) -> int:
    """One signed long for a set of shingles; texts with the same set are copies."""
    total = mixed(h ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(h))
    return int(mixed(np.array([total], dtype=U)).view(np.int64)[0])


def _identities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([identity(hashes(t)) for t in texts], dtype="int64")


def meetings(n: int) -> list[tuple[int, int, int]]:
    """(class, parts, most parts that can differ) under which sets of size ``n`` meet others: their own size class and the one below.

    A class ends where the next size is over a quarter more than its first, so of two sets with a similarity of 4/5 the larger
    one is in the smaller one's class or the next. They differ in at most a quarter of the smaller one's size.
    """
    number, low = 0, 1
    sizes = [low]
    while n > low * WHOLE // PART:
        number, low = number + 1, low * WHOLE // PART + 1
        sizes.append(low)
    out = []
    for c in (number, number - 1):
        if c >= 0:
            differ = sizes[c] * WHOLE // PART // 4
            # Some parts are empty; with these more than ``differ`` are usually not.
            out.append((c, differ + differ // 8 + 3, differ))
    return out


def signatures(h: np.ndarray, known: dict[int, list[tuple[int, int, int]]]) -> np.ndarray:
    """Keys of a set by parts: one for each part that is not empty, in each of its :func:`meetings`. Near sets share one, but so do
    many that only have a passage in common, so :func:`one_of_each` goes by rarity (:func:`rarest`) instead.

    Empty parts agree with everybody's, so they have no key as long as more parts than can differ are not empty; a set with
    fewer has keys for its empty parts too, and meets under them the sets that have as few.
    """
    if len(h) not in known:
        known[len(h)] = meetings(len(h))
    out = []
    for c, count, differ in known[len(h)]:
        own, none = mixed(np.array([2 * c + 1, 2 * c + 2], dtype=U))
        # h is sorted: the parts are stretches of it, by the upper half of the hash.
        at = ((h >> U(32)) * U(count)) >> U(32)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        whole = np.add.reduceat(mixed(h ^ own), first)
        out.append(mixed(whole ^ mixed(at[first] ^ own)))
        if len(first) <= differ:
            empty = np.setdiff1d(np.arange(count, dtype=U), at[first], assume_unique=True)
            out.append(mixed(empty ^ none))
    return np.concatenate(out)


def _lists(of: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, of)]), pa.int32()), pa.array(np.concatenate([*of, np.zeros(0, dtype=U)]).view(np.int64)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches and the sets of their texts, fewer rows at once where texts are long."""
    for batch in batches:
        step = max(1, min(512, (1 << 24) * batch.num_rows // (batch.column("text").nbytes + 1)))
        for s in range(0, batch.num_rows, step):
            part = batch.slice(s, step)
            yield part, [hashes(t) for t in part.column("text").to_pylist()]


def prefix(n: int) -> int:
    """How many of the smallest hashes of a set of size ``n`` it is found by.

    Two sets of a similarity of 4/5 share one of their n - ceil(4n/5) + 1 smallest hashes, whatever the order. With ``spare``
    more they share that many more, all of them among the smallest of both.
    """
    return min(n, n + 1 - -(-n * PART // WHOLE) + spare(n))


def spare(n: int) -> int:
    return n // 10


def prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", simhash: bool = False) -> DataFrame:
    """(doc_id, fp, sid, n, low) of each row: its SimHash if asked for (else null), its set's identity (64 bits), its size and the
    smallest hashes by which it is found.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _slices(batches):
            fps = [fingerprint(t) for t in part.column("text").to_pylist()] if simhash else [None] * len(sets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64()), pa.array([identity(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32()), _lists([h[: prefix(len(h))] for h in sets])], names=["doc_id", "fp", "sid", "n", "low"])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, sid long, n int, low array<long>")


def _own(text: Column) -> Column:
    """Text -> identity of its set. Not pure to the planner, so that no join makes it run twice."""
    return F.pandas_udf(_identities, "long").asNondeterministic()(text)


class Sets:
    """The distinct sets of some rows of ``table``: (sid, n, low, first) with their smallest doc_id, and their whole hashes on demand.

    ``table`` has all rows of ``docs`` (doc_id, sid, n, low, row) and ``rows`` (doc_id, sid, row) those that count.
    """

    def __init__(self, docs: DataFrame, table: DataFrame, rows: DataFrame, doc_id: str, text: str) -> None:
        least = rows.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("at"))
        chosen, chosen_at = written(least.select(F.col("at.row").alias("row"), F.col("at.doc_id").alias("first")))
        self.rows, self.path = written(table.select("row", "sid", "n", "low").join(chosen, "row").drop("row"))
        drop(docs.sparkSession, chosen_at)
        self.texts = docs.select(F.col(doc_id).alias("own"), whole_text(text).alias("text"))
        self.repeats = table.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("same"))
        # A repeated id is told apart by its set; only then can a set come up twice.
        self.repeated = not self.repeats.limit(1).isEmpty()

    def whole(self, sids: DataFrame) -> tuple[DataFrame, str]:
        """(sid, n, h, keys) of ``sids`` (sid, listed) as a table: the whole set as bytes, or as a list of keys if asked for."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, sets in _slices(batches):
                asked = part.column("listed").to_pylist()
                own = pa.array([identity(h) for h in sets], pa.int64())
                keys = [h if listed else h[:0] for h, listed in zip(sets, asked, strict=True)]
                whole = pa.array([b"" if listed else h.tobytes() for h, listed in zip(sets, asked, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([own, pa.array([len(h) for h in sets], pa.int32()), whole, _lists(keys)], names=["sid", "n", "h", "keys"]).filter(pa.compute.equal(own, part.column("sid")))

        # Ids alone, and written, so that the planner knows their size before it moves any text.
        wanted, wanted_at = written(self.rows.select("sid", "first").join(sids, "sid"))
        if self.repeated:
            near = self.texts.join(wanted.select("first"), F.col("own").eqNullSafe(F.col("first")), "left_semi")
            texts = near.withColumn("sid", _own(F.col("text"))).join(wanted, "sid").select("sid", "text", "listed")
        else:
            texts = self.texts.join(wanted, F.col("own").eqNullSafe(F.col("first"))).select("sid", "text", "listed")
        out = texts.mapInArrow(scan, "sid long, n int, h binary, keys array<long>")
        out = written(out.dropDuplicates(["sid"]) if self.repeated else out)
        drop(self.rows.sparkSession, wanted_at)
        return out

    def verified(self, pairs: DataFrame) -> tuple[DataFrame, list[str]]:
        """The rows of ``pairs`` (a, b) with a Jaccard similarity of 4/5 or more, as a table, and the tables it is made of.

        Sizes and smallest hashes rule most out: of two sets, no more than the hashes shared up to the smaller of their last
        ones, and the rest of the one that has less left, can be common. What remains is checked on the whole sets.
        """
        for k in ("a", "b"):
            pairs = pairs.join(self.rows.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("low").alias(f"low_{k}")), k)
            if k == "b":
                pairs = pairs.where(F.least("n_a", "n_b") * WHOLE >= F.greatest("n_a", "n_b") * PART)

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b")), *(batch.column(c) for c in ("low_a", "low_b")), strict=True):
                    x, y = (v.values.to_numpy().view(U) for v in (x, y))
                    if not len(x) or not len(y):
                        keep.append(n == m)
                        continue
                    # The lists are sorted as unsigned numbers.
                    end = min(x[-1], y[-1])
                    i, j = int(np.searchsorted(x, end, side="right")), int(np.searchsorted(y, end, side="right"))
                    both = np.concatenate([x[:i], y[:j]])
                    both.sort()
                    most = int((both[1:] == both[:-1]).sum()) + min(n - i, m - j)
                    keep.append(most * WHOLE >= (n + m - most) * PART)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("h_a"), batch.column("h_b"), strict=True):
                    both = np.concatenate([np.frombuffer(v.as_buffer(), dtype=U) for v in (x, y)])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(shared * WHOLE >= (len(both) - shared) * PART)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        left, left_at = written(pairs.mapInArrow(possible, "a long, b long"))
        wanted = left.select(F.explode(F.array("a", "b")).alias("sid")).distinct().withColumn("listed", F.lit(False))
        whole, whole_at = self.whole(wanted)
        for k in ("a", "b"):
            left = left.join(whole.select(F.col("sid").alias(k), F.col("h").alias(f"h_{k}")), k)
        edges, path = written(left.select("a", "b", "h_a", "h_b").mapInArrow(check, "a long, b long"))
        for done in (left_at, whole_at):
            drop(self.rows.sparkSession, done)
        return edges, [path]


def may_link(n, left, m, left_m):
    """Whether two sets of sizes ``n`` and ``m`` can be near that have no more than ``left`` and ``left_m`` hashes to share: those
    from the key on where they meet, as no smaller one is shared.
    """
    return (F.least(n, m) * WHOLE >= F.greatest(n, m) * PART) & (F.least(left, left_m) * (PART + WHOLE) >= PART * (n + m))


def rarest(posts: DataFrame) -> DataFrame:
    """(key, sid, n, left) of the hashes by which sets meet, of all hashes (sid, n, key) of some sets.

    In the order of how many of these sets have them, two near sets share one of their n - ceil(4n/5) + 1 first hashes. Hashes of
    one set alone come first and bring nobody together, but count as not shared.
    """
    often = posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    own = Window.partitionBy("sid")
    # From the last place on, so that what is left to share needs no count of the hashes before.
    placed = posts.join(often, "key").withColumn("left", F.row_number().over(own.orderBy(F.desc("c"), F.desc("key"))))
    return placed.where(F.col("left") >= F.ceil(F.col("n") * PART / WHOLE)).select("key", "sid", "n", "left")


def _pair(x, y) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def linked(pairs: DataFrame, members: DataFrame, sets: Sets) -> DataFrame:
    """(node, root) of every sid that is linked to another; root is the smallest it can reach.

    Candidates are ``pairs`` (a, b) and all that share a key of ``members`` (key, sid, n, left, lo) and may link there. Members are
    compared with one of their key (lo). A key whose members are then not all in one component is open, but for those with too
    little left to share for the sizes there, and only members of different components still need comparing: a few rounds with
    one more member each where that leaves many pairs, then all of them. So no link between components goes unseen, and a crowd
    of near copies costs one comparison a member.
    """
    led = members.where((F.col("sid") != F.col("lo.sid")) & may_link(F.col("n"), F.col("left"), F.col("lo.n"), F.col("lo.left")))
    edges, paths = sets.verified(pairs.unionByName(led.select(*_pair(F.col("sid"), F.col("lo.sid")))).distinct())
    roots = cut_lineage(components(edges))
    # The largest set that one may link to.
    reach = F.floor(F.col("left") * (PART + WHOLE) / PART) - F.col("n")
    for k in range(ROUNDS + 1):
        now = members.select("key", "sid", "n", "left").join(roots, F.col("sid") == F.col("node"), "left").select("key", "sid", "n", "left", F.coalesce("root", "sid").alias("root"))
        sizes = now.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.min("n").alias("least"), F.max(reach).alias("most")).where("first < last")
        able, able_at = written(now.join(sizes, "key").where((reach >= F.col("least")) & (F.col("n") <= F.col("most"))).select("key", "sid", "n", "left", "root"))
        ends, ends_at = written(able.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.count("*").alias("c"), F.max(F.struct("root", "left", "sid", "n")).alias("lead")).where("first < last").select("key", "c", "lead"))
        paths += [able_at, ends_at]
        size = ends.agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).first()
        if not size.n:
            break
        open_ = able.join(ends, "key")
        last = k == ROUNDS or size.pairs <= SPARSE * size.n
        if last:
            other = open_.select("key", F.col("sid").alias("y"), F.col("root").alias("of"), F.col("n").alias("m"), F.col("left").alias("left_m"))
            met = open_.select("key", F.col("sid").alias("x"), "root", "n", "left").join(other, "key").where((F.col("root") < F.col("of")) & may_link(F.col("n"), F.col("left"), F.col("m"), F.col("left_m")))
        else:
            met = open_.where((F.col("root") < F.col("lead.root")) & may_link(F.col("n"), F.col("left"), F.col("lead.n"), F.col("lead.left"))).select(F.col("sid").alias("x"), F.col("lead.sid").alias("y"))
        more, path = sets.verified(met.select(*_pair("x", "y")).distinct())
        paths += path
        edges = edges.unionByName(more)
        roots = cut_lineage(components(edges))
        if last:
            break
    for path in paths:
        drop(sets.rows.sparkSession, path)
    return roots


def components_of(sets: Sets) -> DataFrame:
    """(node, root) as :func:`linked` has them.

    Two near sets share more than ``spare`` of their smallest hashes, each more than 2/25 of its own size. Either they share one
    that is not crowded after no more crowded ones than that, which ``spare`` bounds from either size, or both have more crowded
    ones than that: such sets meet by their rarest hashes.
    """
    spark = sets.rows.sparkSession
    posts = sets.rows.select("sid", "n", F.posexplode("low").alias("i", "key")).select("key", "sid", "n", (F.col("n") - F.col("i") + F.floor(F.col("n") / 10)).alias("left"))
    one = F.struct("sid", "n", "left")
    met, met_at = written(posts.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.count("*").alias("c")).where("c > 1"))
    two = met.where((F.col("c") == 2) & may_link(F.col("lo.n"), F.col("lo.left"), F.col("hi.n"), F.col("hi.left"))).select(F.col("hi.sid").alias("a"), F.col("lo.sid").alias("b"))
    back, back_at = written(posts.join(met.where("c > 2").select("key", "c", "lo"), "key").select("key", "sid", "n", "left", "c", "lo"))
    crowded = back.where(F.col("c") > CROWD).groupBy("sid", "n").agg(F.count("*").alias("q")).where(F.col("q") > F.floor(F.col("n") * PART / (10 * WHOLE))).select("sid", F.lit(True).alias("listed"))
    whole, whole_at = sets.whole(crowded)
    rare, rare_at = written(rarest(whole.select("sid", "n", F.explode("keys").alias("key"))))
    # The one with most left to share has the fewest changes of its own: most of a crowd of near copies link to it.
    lead = rare.groupBy("key").agg(F.max(F.struct("left", "sid", "n")).alias("lo"), F.count("*").alias("c")).where("c > 1")
    by_rarity, by_at = written(rare.join(lead, "key").select(F.col("key").bitwiseXOR(F.lit(ASIDE)).alias("key"), "sid", "n", F.col("left").cast("long").alias("left"), F.struct("lo.sid", "lo.n", F.col("lo.left").cast("long").alias("left")).alias("lo")))
    for done in (whole_at, rare_at):
        drop(spark, done)
    roots = linked(two.distinct(), back.where(F.col("c") <= CROWD).select("key", "sid", "n", "left", "lo").unionByName(by_rarity), sets)
    for path in (met_at, back_at, by_at):
        drop(spark, path)
    return roots


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, one row each; all columns as they were.

    Words are lower-cased (A-Z); texts link at a Jaccard similarity of 0.8 or more of their sets of five-word shingles, null,
    empty and blank texts are copies of each other. Very long texts are read whole. Equal sets are told by 64 bits, links are
    checked on the whole sets. A component without any doc_id keeps one of its rows, and of repeated rows one stays; an empty
    table gives no rows.

    With a ``radius``, one row of each SimHash component (:func:`simhash.leaders`) first, then one of each component by shingles
    of what is left. Texts are read once for both, and ids alone tell what is left.
    """
    spark = docs.sparkSession
    table, path = written(prints(docs, doc_id, text, radius is not None).withColumn("row", F.monotonically_increasing_id()))
    rows, left_at = table.select("doc_id", "sid", "row"), None
    if radius is not None:
        left, left_at = written(leaders(table.select("doc_id", "fp", "row"), radius=radius))
        rows = rows.join(left, "row", "left_semi")
    sets = Sets(docs, table, rows, doc_id, text)
    roots = components_of(sets)
    ends = sets.rows.select("sid", "first").join(roots, F.col("sid") == F.col("node"), "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min(F.struct(F.col("first").isNull(), "first", "sid")).alias("at"))
    stay = ends.select("root", F.col("at.first").alias("first"), F.col("at.sid").alias("sid"))
    if sets.repeated:
        stay = stay.join(sets.repeats, F.col("first").eqNullSafe(F.col("same")), "left_semi").withColumn("more", F.lit(True)).unionByName(stay.join(sets.repeats, F.col("first").eqNullSafe(F.col("same")), "left_anti").withColumn("more", F.lit(False)))
    else:
        stay = stay.withColumn("more", F.lit(False))
    names = {c: free_name(docs, f"_{c}") for c in ("root", "first", "sid", "more")}
    # The result reads only this table of ids.
    stay, _ = written(stay.select(*(F.col(c).alias(n) for c, n in names.items())))
    for done in filter(None, (sets.path, path, left_at)):
        drop(spark, done)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(names["first"]))
    once = docs.join(stay.where(~F.col(names["more"])), same, "left_semi").select(*columns)
    if not sets.repeated:
        return once
    # Several rows have this id: the set tells which of them it was.
    own, many = free_name(docs, "_own"), stay.where(names["more"])
    near = docs.join(many, same, "left_semi").withColumn(own, _own(whole_text(text)))
    more = near.join(many, same & (F.col(own) == F.col(names["sid"]))).dropDuplicates([names["root"]]).select(*columns)
    return reduce(DataFrame.unionByName, [once, more])
