"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import components, free_name, whole_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
SEED = 42
BLOCK = 1 << 16


def fingerprint(text: str) -> int:
    """64 bits of the word shingles of ``text``: a bit is set if it is set in over half of their XXH64, as a signed long."""
    # Of bytes, lower() changes A-Z only and split() cuts at space, tab, and the four line and page marks: 0x20, 0x09-0x0D.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, n, BLOCK):
        part = words[s : min(s + BLOCK, n) + SHINGLE - 1]
        many = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in many), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def simhash(text: Column) -> Column:
    """Text -> fingerprint. Not pure to the planner, so that no filter or join makes it run twice."""
    return F.pandas_udf(_fingerprints, "long").asNondeterministic()(text)


def near_pairs(prints: DataFrame, fp: str = "fp", radius: int = 2) -> DataFrame:
    """Edges (a, b), a > b, between distinct fingerprints at most ``radius`` bits apart (1 to 4), enough to connect all of them.

    Every distinct fingerprint emits all variants within half the radius (65 for a radius of 2 or 3 less the odd step, see
    below) and variants meet in one shuffle. Two fingerprints within the radius share a variant. Under one variant only
    neighbours in order are paired: all that meet there are within twice the half radius of each other, so for an even
    radius each such pair is a link and the chain connects what the full set of pairs would connect. An odd radius is served
    by the next even ball, whose colliding pairs are then all compared; there a variant holds at most a ball of fingerprints.
    The pairs are deduplicated and verified by their differing bits.
    """
    half = (radius + 1) // 2
    flips = [0] + [1 << i for i in range(64)] + ([1 << i | 1 << j for i in range(64) for j in range(i)] if half > 1 else [])
    masks = F.array(*(F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in flips)) if half == 1 else F.array_distinct(F.flatten(F.transform(one := F.array(*(F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in flips[:65])), lambda x: F.transform(one, lambda y: x.bitwiseXOR(y)))))
    balls = prints.select(F.col(fp).alias("a")).distinct().select("a", F.explode(masks).alias("m")).select("a", F.col("a").bitwiseXOR(F.col("m")).alias("variant"))
    w = Window.partitionBy("variant").orderBy("a")
    if radius % 2 == 0:
        met = balls.withColumn("b", F.lag("a").over(w)).where("b IS NOT NULL").select("a", "b")
    else:
        many = balls.groupBy("variant").agg(F.sort_array(F.collect_list("a")).alias("all")).where("size(all) > 1")
        met = many.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a > b")
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def linked(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``prints`` (doc_id, fp): the smallest doc_id it can reach."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_pairs(least, radius=radius))
    tied = cut_lineage(least.join(roots, least["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    return tied.join(ids, "root").select("fp", "root", "component_id")


def leaders(prints: DataFrame, row: str = "row", radius: int = 2) -> DataFrame:
    """``row`` of one row of each component of ``prints`` (doc_id, fp, row): the smallest doc_id, then the smallest row; rows
    without a doc_id only where the component has no other. Copies collapse to their fingerprint before any join.
    """
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("at"))
    ends = least.join(linked(prints, radius).select("fp", "root"), "fp").groupBy("root").agg(F.min("at").alias("at"))
    return ends.select(F.col(f"at.{row}").alias(row))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text", radius: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Words are lower-cased (A-Z), shingles are three words, repeats included; with fewer words the whole sequence is one
    shingle. Null, empty and blank texts have fingerprint zero and link like any other. Fingerprints link at ``radius`` or
    fewer differing bits; component_id is the smallest doc_id that links reach, null if all of them are null. Copies
    collapse to their fingerprint before any pairing. Repeated rows are kept; an empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    prints = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), simhash(whole_text(text)).alias("fp")))
    return prints.join(linked(prints, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, one row each; all columns as they were.

    A component without any doc_id keeps one of its rows. Of repeated rows with the smallest doc_id one stays.
    """
    fp, root = free_name(docs, "_fp"), free_name(docs, "_root")
    marked = docs.withColumn(fp, simhash(whole_text(text)))
    prints = cut_lineage(marked.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp")))
    groups = linked(prints, radius)
    # The rows that may stay: those with the component's doc_id. More than one of them means a repeated doc_id.
    stay = prints.join(groups, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "fp", "root").agg(F.count("*").alias("n"))
    stay = stay.withColumn("of", F.count("*").over(Window.partitionBy("root"))).withColumn("n", F.greatest("n", "of"))
    stay = cut_lineage(stay.select(F.col("doc_id").alias(free_name(docs, "_id")), F.col("fp").alias(free_name(docs, "_print")), F.col("root").alias(root), F.col("n").alias(free_name(docs, "_n"))))
    their_id, their_fp, _, n = stay.columns
    kept = marked.join(stay, F.col(doc_id).eqNullSafe(F.col(their_id)) & (F.col(fp) == F.col(their_fp)))
    once, more = kept.where(F.col(n) == 1), kept.where(F.col(n) > 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if stay.where(F.col(n) > 1).isEmpty():
        return once.select(*columns)
    return reduce(DataFrame.unionByName, [once.select(*columns), more.dropDuplicates([root]).select(*columns)])
