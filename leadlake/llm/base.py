"""What several operators share: reading, row positions by ranges, connected components."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop, written

# Executors may lack this package: functions that run in tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its position from 0 in the given total order, as column ``name``.

    Rows are dealt by ranges, sorted inside their range and written down; only one count per range goes through the
    window, so no task ever holds more than its range.
    """
    at = free_name(df, "_at")
    dealt = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), 33)
    size, before = free_name(df, "_size"), free_name(df, "_before")
    key = free_name(df, "_part")
    counts = dealt.groupBy(part.alias(key)).agg(F.count("*").alias(size)).selectExpr(key, f"sum({size}) OVER (ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {size} AS {before}")
    # One row for each range: as many as there are shuffle partitions.
    return dealt.withColumn(key, part).join(F.broadcast(counts), key).withColumn(name, (F.col(before) + (F.col(at) % F.lit(1 << 33))).cast("long")).drop(at, key, before)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that an edge (a, b) touches; the root is the smallest node it can reach.

    Large and small stars in turn: each node's neighbours are hung on its smallest neighbour, so paths halve and a hub
    costs one row per neighbour. Nodes are longs. A null or an edge from a node to itself is ignored. Each round is
    written to the shared checkpoint folder; the driver sees one count and one checksum a round.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, between = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then, next_path = written(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        drop(spark, between)
        drop(spark, path)
        now, path = then, next_path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
