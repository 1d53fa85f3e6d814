"""Incremental jobs on Structured Streaming (STR-*).

Sinks write one folder per micro-batch with overwrite, so a replayed batch replaces itself instead of appending twice.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.quality import assess
from ..functions.priority import with_priority
from ..functions.score import with_lead_score
from ..operators.ranking import number_rows
from ..operators.resolve import duplicate_groups, duplicate_records
from ..sources.sinks import insight_rows, prediction_rows, quality_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATE = "1 day"


def read_table(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def analyze_changes(changes: DataFrame, out: str, as_of: str, checkpoint: str) -> StreamingQuery:
    """STR-1/STR-2: score, prioritise and assess each micro-batch of lead rows (with nested company)."""
    def handle(batch: DataFrame, n: int) -> None:
        batch.persist()
        scored = with_priority(with_lead_score(batch, as_of), as_of).persist()
        for name, rows in (("scores", scored.select("id", "lead_score", "priority_score")), ("predictions", prediction_rows(scored, as_of)), ("insights", insight_rows(scored, as_of)), ("quality", quality_rows(assess(batch, as_of), as_of))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")
        scored.unpersist()
        batch.unpersist()

    return run_batches(changes, handle, checkpoint)


def duplicates_of_new(changes: DataFrame, existing: DataFrame, out: str, as_of: str, checkpoint: str, threshold: float = 0.85, tenant: str | None = None) -> StreamingQuery:
    """STR-3: groups over stored leads, leads of earlier batches and new ones; pairs with a new lead that are not stored yet
    are written to ``out``/pairs. Leads of every batch are kept in ``out``/leads, so later batches meet them.
    """
    def handle(batch: DataFrame, n: int) -> None:
        spark, pair = batch.sparkSession, ["primary_lead_id", "duplicate_lead_id"]
        batch.write.mode("overwrite").parquet(f"{out}/leads/batch={n}")
        seen = spark.read.parquet(f"{out}/leads").where(F.col("batch") <= n)
        ids = seen.where(F.col("batch") == n).select("id")
        found = duplicate_records(duplicate_groups(existing.unionByName(seen.drop("batch")), threshold, tenant), as_of)
        fresh = found.join(ids.withColumnRenamed("id", pair[1]), pair[1], "left_semi").unionByName(
            found.join(ids.withColumnRenamed("id", pair[0]), pair[0], "left_semi")).dropDuplicates(pair)
        if n:
            fresh = fresh.join(spark.read.parquet(f"{out}/pairs").where(F.col("batch") < n).select(*pair), pair, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/pairs/batch={n}")

    return run_batches(changes, handle, checkpoint)


def rolling_metrics(events: DataFrame, ts: str, keys, width: str = "1 day", slide: str | None = None, *aggs: Column) -> DataFrame:
    """STR-4: tumbling or sliding windows under the watermark; also valid on a batch frame."""
    frame = events.withWatermark(ts, LATE) if events.isStreaming else events
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return frame.groupBy(win, *keys).agg(*aggs)


def upsert_changes(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Groups of an aggregated stream that changed in a micro-batch, one folder each; :func:`latest` reads the table."""
    def handle(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return changes.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, keys) -> DataFrame:
    """Rows of the last batch that wrote each key."""
    last = F.max("batch").over(Window.partitionBy(*keys))
    return spark.read.parquet(out).withColumn("_last", last).where("batch = _last").drop("batch", "_last")


def starts(events: DataFrame, keys, ts: str, seconds: int) -> DataFrame:
    """Rows (keys, ts) that compute a result: the first of a key, then each first one ``seconds`` or more after the last result.

    Rows of a key are sorted in their partition and read once; a task holds one batch and one time. Equal rows collapse
    before the shuffle; null times are left out.
    """
    width = seconds * 1_000_000
    rows = events.where(F.col(ts).isNotNull()).select(*keys, ts).distinct()
    schema = rows.schema
    marked = rows.withColumns({"_key": F.to_json(F.struct(*keys)), "_us": F.unix_micros(F.col(ts).cast("timestamp"))})

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for pdf in batches:
            k, t, keep = pdf["_key"].to_numpy(), pdf["_us"].to_numpy(), []
            edges = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else []
            for s, e in zip(edges, [*edges[1:], len(k)], strict=True):
                i = s + np.searchsorted(t[s:e], last + width) if k[s] == key else s
                key = k[s]
                while i < e:
                    keep.append(i)
                    last = t[i]
                    i = s + np.searchsorted(t[s:e], last + width)
            yield pdf.iloc[keep].drop(columns=["_key", "_us"])

    return marked.repartition("_key").sortWithinPartitions("_key", "_us").mapInPandas(step, schema)


def first_within(events: DataFrame, keys, ts: str, seconds: int, out: str, checkpoint: str) -> StreamingQuery:
    """STR-5: a result is reused for ``seconds``; later rows of its key then compute the next one.

    The times of each batch are kept in ``out``/events and the keys of the batch settled again over all of theirs, so late
    rows and the cut into files do not change the outcome. ``latest(spark, out + "/results", keys)`` reads it.
    """
    keys = list(keys)

    def handle(batch: DataFrame, n: int) -> None:
        batch.select(*keys, ts).distinct().write.mode("overwrite").parquet(f"{out}/events/batch={n}")
        seen = batch.sparkSession.read.parquet(f"{out}/events").where(F.col("batch") <= n)
        now = seen.where(F.col("batch") == n).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        starts(seen.drop("batch").join(now, same, "left_semi"), keys, ts, seconds).write.mode("overwrite").parquet(f"{out}/results/batch={n}")

    return run_batches(events, handle, checkpoint)


def request_rate(events: DataFrame, key: str, ts: str, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Requests made in the trailing window, accepted or not, per second of a key, flagged above the limit.

    Equal seconds collapse first. Each second then goes to its own window-long bucket and to the next one, so the ordered
    groups are (key, bucket) with at most twice ``seconds`` rows, however busy the key.
    """
    sec = F.unix_timestamp(F.col(ts).cast("timestamp"))
    per = events.groupBy(key, sec.alias("s")).agg(F.count("*").alias("n"))
    home = F.floor(F.col("s") / seconds)
    spread = per.select(key, "s", "n", home.alias("home"), F.explode(F.array(home, home + 1)).alias("bucket"))
    w = Window.partitionBy(key, "bucket").orderBy("s").rangeBetween(-(seconds - 1), 0)
    total = spread.withColumn("trailing", F.sum("n").over(w)).where("home = bucket")
    return total.select(key, "s", "n", "trailing", (F.col("trailing") > limit).alias("limited"))


def admit(times: np.ndarray, last: list[int], limit: int, width: int) -> tuple[np.ndarray, list[int]]:
    """Which of the sorted ``times`` are accepted, and the last ``limit`` accepted ones: a request is refused while ``limit``
    accepted ones are less than ``width`` old. Refused requests do not count. One step for each accepted request.
    """
    keep, last, i = np.zeros(len(times), dtype=bool), list(last), 0
    while i < len(times):
        if len(last) >= limit:
            i = max(i, int(np.searchsorted(times, last[-limit] + width)))
            if i == len(times):
                break
        keep[i] = True
        last = [*last, int(times[i])][-limit:]
        i += 1
    return keep, last


def admitted(events: DataFrame, key: str, ts: str, order: str, limit: int = 30, seconds: int = 60) -> DataFrame:
    """STR-6 on a table: ``events`` (key, ts, order) with ``accepted``, at most ``limit`` accepted in any ``seconds`` of a key.

    ``order`` settles equal times. Rows of a key are sorted in their partition and read once with the last accepted times as
    all there is to remember; rows without a time are left out, a null key is a key.
    """
    width = seconds * 1_000_000
    rows = events.where(F.col(ts).isNotNull()).select(key, ts, order)
    marked = rows.withColumns({"_key": F.to_json(F.struct(key)), "_us": F.unix_micros(F.col(ts).cast("timestamp"))})

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, []
        for pdf in batches:
            k, t, keep = pdf["_key"].to_numpy(), pdf["_us"].to_numpy(), np.zeros(len(pdf), dtype=bool)
            edges = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else []
            for s, e in zip(edges, [*edges[1:], len(k)], strict=True):
                if k[s] != now:
                    now, last = k[s], []
                keep[s:e], last = admit(t[s:e], last, limit, width)
            yield pdf.drop(columns=["_key", "_us"]).assign(accepted=keep)

    schema = StructType([*rows.schema, StructField("accepted", BooleanType())])
    return marked.repartition("_key").sortWithinPartitions("_key", "_us", order).mapInPandas(step, schema)


ADMIT_STATE = "ids array<bigint>, times array<bigint>, last array<bigint>"


def admitted_stream(events: DataFrame, key: str, ts: str, order: str, limit: int = 30, seconds: int = 60, late: str = LATE) -> DataFrame:
    """STR-6 on a stream: the rows of :func:`admitted`, each once the watermark has passed its time.

    State of a key is what still waits for the watermark, and the last accepted times; a timer at the first waiting time lets
    them go without new rows. Rows later than ``late`` are dropped by the engine, so the cut into files does not matter.
    """
    width = seconds * 1_000_000
    rows = events.select(F.col(key), F.col(ts), F.col(order).cast("long").alias(order)).withWatermark(ts, late)

    def step(k, batches, state):
        ids, times, last = (list(x) for x in state.get) if state.exists else ([], [], [])
        for pdf in batches:
            # Microseconds, as pandas may hold any unit.
            times += pd.to_datetime(pdf[ts]).to_numpy().astype("datetime64[us]").astype("int64").tolist()
            ids += pdf[order].tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        by = np.lexsort((ids, times))
        t, i = np.array(times, dtype=np.int64)[by], np.array(ids, dtype=np.int64)[by]
        due = int(np.searchsorted(t, mark, side="right"))
        keep, last = admit(t[:due], last, limit, width)
        state.update((i[due:].tolist(), t[due:].tolist(), last))
        if due < len(t):
            state.setTimeoutTimestamp(max(int(t[due]) // 1000, mark // 1000) + 1)
        yield pd.DataFrame({key: [k[0]] * due, ts: t[:due].astype("datetime64[us]"), order: i[:due], "accepted": keep})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, {order} bigint, accepted boolean", ADMIT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


HISTORY = 100


def monitored_runs(runs: DataFrame, out: str, checkpoint: str, metric: str = "accuracy", key: str = "purpose", order: str = "run_id") -> StreamingQuery:
    """STR-7: rows (key, order, kept, declining) in ``out``/runs, the last 100 runs of each key in ``out``/history.

    Runs of a key stand in the order of their micro-batches, inside one by ``order``. kept is the length of the history with
    the run in it; a run declines if its metric is below nine tenths of the metric four runs before. Positions come from
    range partitions and the earlier run by a join on them, so a key with most of the runs is no task of its own, and
    neither files nor partitions need an order. A null metric declines nothing; a null key is a key.
    """
    def handle(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, order, metric).withColumn("_new", F.lit(True))
        if n:
            rows = rows.unionByName(spark.read.parquet(f"{out}/history/batch={n - 1}").withColumn("_new", F.lit(False)))
        placed = number_rows(rows, [key, "_new", order, metric]).withColumnRenamed("position", "_at")
        spans = placed.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
        numbered = placed.join(spans, F.col(key).eqNullSafe(F.col("_key")))
        before = placed.select((F.col("_at") + 4).alias("_at"), F.col(metric).alias("_before"))
        seen = numbered.where("_new").join(before, "_at", "left").withColumn("_rank", F.col("_at") - F.col("_from") + 1)
        declining = (F.col("_rank") > 4) & (F.col(metric) < F.col("_before") * 0.9)
        seen.select(key, order, F.least("_rank", F.lit(HISTORY)).cast("int").alias("kept"), F.coalesce(declining, F.lit(False)).alias("declining")).write.mode("overwrite").parquet(f"{out}/runs/batch={n}")
        numbered.where(F.col("_to") - F.col("_at") < HISTORY).select(key, order, metric).write.mode("overwrite").parquet(f"{out}/history/batch={n}")

    return run_batches(runs, handle, checkpoint)


def training_due(new_rows: DataFrame, key: str, ts: str, as_of: str, minimum: int = 100) -> DataFrame:
    """STR-8: purposes with enough new rows in the last 24 hours."""
    day = F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    return new_rows.groupBy(key).agg(F.count(F.when(day, 1)).alias("new_rows")).withColumn("due", F.col("new_rows") >= minimum)

