"""Sharding by longest-processing-time scheduling: groups that stay together go, by size, to the least-loaded shard."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import positions, whole_text

#: Group sizes are scheduled by their leading bits: exact below 4096 bytes, within 1/4096 above. So the size histogram, the
#: only thing the driver sees, has at most 4096 entries for each doubling of the size, whatever the corpus.
PRECISION = 12


def size_class(size: str, bits: int = PRECISION) -> Column:
    """``size`` with all but its ``bits`` + 1 leading bits cleared."""
    shift = f"greatest(0, length(bin({size})) - {bits + 1})"
    return F.expr(f"shiftleft(shiftright({size}, {shift}), {shift})")


def schedule(histogram: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, list[tuple[int, list[int]]]]]:
    """The schedule of (size class, groups, bytes), for every class: (class, position of its first group, runs).

    Groups go by falling size to the top of a heap of (load, shard). Groups of one class are equal, so the shards within one
    size of the least-loaded one take turns, until the next shard's load is reached: one step of the heap stands for a whole
    run (from, turns), whose k-th group goes to turns[k mod their number]. A class takes at most two runs a shard.
    """
    heap = [(0.0, k) for k in range(shards)]
    out, first = [], 0
    for size, groups, total in sorted(histogram, reverse=True):
        each, left, runs = total / groups, groups, []
        while left:
            turns = [heapq.heappop(heap)]
            while heap and heap[0][0] < turns[0][0] + each:
                turns.append(heapq.heappop(heap))
            rounds = left // len(turns)
            if heap:
                rounds = min(rounds, max(1, math.ceil((heap[0][0] - turns[-1][0]) / each)))
            if not rounds:
                for spare in turns[left:]:
                    heapq.heappush(heap, spare)
                turns, rounds = turns[:left], 1
            runs.append((groups - left, [k for _, k in turns]))
            for load, k in turns:
                heapq.heappush(heap, (load + rounds * each, k))
            left -= rounds * len(turns)
        out.append((size, first, runs))
        first += groups
    return out


def sharded(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1, text_crc32 its checksum; law is "bytes": shard sizes come out as near equal as
    whole groups of equal texts allow. slot counts from 0 without gaps within a shard, by doc_id. grown_shard is null.
    Null and empty texts are one group; repeated rows stay with their group; an empty table gives no rows; other columns of
    ``docs`` are not read.

    Texts are replaced by digests before any shuffle, copies are counted map-side, groups and rows get their positions by
    ranges, and the driver schedules a histogram of bounded size. A group, however large, is spread over tasks.
    """
    rows = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(whole_text(text)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(whole_text(text).cast("binary")).alias("text_crc32"), F.unhex(F.sha2(whole_text(text).cast("binary"), 256)).alias("digest")))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("class", size_class("bytes"))
    placed = positions(groups, [F.col("class").desc(), F.col("digest")], "at")
    found = placed.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()
    spark = docs.sparkSession
    runs = spark.createDataFrame(schedule([(r["class"], r.n, r.b) for r in found], shards), "class long, first long, runs array<struct<start: long, turns: array<int>>>")
    dealt = placed.join(runs, "class").withColumn("k", F.col("at") - F.col("first")).withColumn("run", F.expr("element_at(filter(runs, r -> r.start <= k), -1)"))
    shard_of = dealt.select("digest", F.expr("run.turns[cast((k - run.start) % size(run.turns) AS int)]").alias("shard"))
    ordered = positions(rows.join(shard_of, "digest"), [F.col("shard"), F.col("doc_id"), F.col("digest")], "at")
    counts = dict(ordered.groupBy("shard").count().collect())
    before, start = F.lit(0).cast("long"), 0
    for k in sorted(counts):
        before = F.when(F.col("shard") == k, F.lit(start).cast("long")).otherwise(before)
        start += counts[k]
    return ordered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - before).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
