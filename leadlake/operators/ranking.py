"""Rankings, percentiles and positional windows (WIN-*, SRT-*), built without a single-task global window.

Ranks over a whole table use the score histogram. Scores carry one decimal, so it has at most ~1000 rows; ties are
ordered by id inside (score, id bucket) cells that hold at most ``bucket`` distinct ids each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, compact, say  # noqa: F401


def top_per_key(df: DataFrame, keys, order, k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key. The planner limits each map partition to k rows per key before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def batch_rank(df: DataFrame, score: str = "score", key: str = "id") -> DataFrame:
    """WIN-3: 1-based rank by score desc, then id, and the percentile ``round((1 - i/n) * 100, 1)``; null scores come last.

    Ranks are positions in range partitions of (score, id), so neither a score shared by a third of the table nor sparse or
    hashed ids put more into one task than its range. Tenths are rounded as whole numbers of the double itself: Spark rounds
    the decimal text of 26.549999999999997 down, where tenfold it is 265.5.
    """
    placed = number_rows(df, [F.desc(score), F.col(key)])
    rank = F.col("position").cast("bigint")
    return placed.withColumns({"batch_rank": rank, "percentile": F.round((1 - (rank - 1) / F.col("_total")) * 100 * 10) / 10}).drop("position", "_total")


def rank_scored(scored: DataFrame, score: str = "score", key: str = "id") -> DataFrame:
    """SCR-29: ``batch_rank`` over a computed score.

    The two columns are written down first: the ranking reads them three times, and a long score expression as a join
    key would be copied into every inferred filter of the plan.
    """
    from ..session import cut_lineage

    return batch_rank(cut_lineage(scored.select(key, score)), score, key)


PERCENTILES = {"p95": 0.95, "p90": 0.9, "p75": 0.75, "p50": 0.5, "p25": 0.25, "p10": 0.1}


def index_percentiles(df: DataFrame, score: str = "score", keys=()) -> DataFrame:
    """WIN-4: element ``int(n*p)`` of the ascending scores, and the upper median, from the cumulative histogram."""
    hist = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    cum = hist.withColumns({
        "_cum": F.sum("_c").over(w.orderBy(score).rowsBetween(Window.unboundedPreceding, 0)),
        "_n": F.sum("_c").over(w)})
    pick = {name: F.min(F.when(F.col("_cum") > F.floor(F.col("_n") * p), F.col(score))).alias(name) for name, p in PERCENTILES.items()}
    median = F.min(F.when(F.col("_cum") > F.floor(F.col("_n") / 2), F.col(score))).alias("median_score")
    return cum.groupBy(*keys).agg(F.max("_n").alias("n"), median, *pick.values())


def percent_below(df: DataFrame, score: str = "score") -> DataFrame:
    """WIN-6: share of scores strictly lower, for every row, by joining the histogram back."""
    hist = df.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_c"))
    shares = hist.select("_s", F.coalesce(F.sum("_c").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("better_count"),
                         F.sum("_c").over(Window.partitionBy()).alias("_n"))
    joined = df.join(shares, F.col(score) == F.col("_s")).drop("_s")
    return joined.withColumn("percentile_rank", F.round(F.col("better_count") * 100.0 / F.col("_n"), 6)).withColumnRenamed("_n", "comparison_count")


def keep_latest(runs: DataFrame, key: str, order: str, k: int = 100) -> DataFrame:
    """WIN-7."""
    return top_per_key(runs, [key], [F.desc(order)], k).drop("rn")


# Fixed retraining thresholds per purpose: metric, bound, and whether the metric must stay above it.
RETRAIN_THRESHOLDS = {
    "priority": [("accuracy", 0.8, True), ("f1_score", 0.75, True)],
    "quality": [("r2_score", 0.7, True), ("mae", 15.0, False)],
    "conversion": [("accuracy", 0.75, True), ("auc", 0.8, True)],
}


def decline_check(runs: DataFrame, key: str = "purpose", order: str = "run_id") -> DataFrame:
    """WIN-8/ML-18: threshold breaches of the latest run and a fall of more than 10 % over the last five runs."""
    last5 = top_per_key(runs, [key], [F.desc(order)], 5)
    g = last5.groupBy(key).agg(
        F.count("*").alias("runs"),
        *[F.max(F.when(F.col("rn") == 1, F.col(c))).alias(f"last_{c}") for c in ("accuracy", "f1_score", "r2_score", "mae", "auc")],
        F.max_by("accuracy", "rn").alias("first_accuracy"), F.max_by("r2_score", "rn").alias("first_r2_score"))
    reasons = []
    for purpose, rules in RETRAIN_THRESHOLDS.items():
        for metric, bound, above in rules:
            v = F.col(f"last_{metric}")
            bad = v < bound if above else v > bound
            word = "below" if above else "above"
            reasons.append(say((F.col(key) == purpose) & bad, f"{metric} {word} threshold"))
    tracked = F.when(F.col(key) == "quality", F.col("last_r2_score") < F.col("first_r2_score") * 0.9).otherwise(
        F.col("last_accuracy") < F.col("first_accuracy") * 0.9)
    reasons.append(say((F.col("runs") >= 5) & tracked, "declining performance"))
    out = g.withColumn("reasons", F.array_join(compact(*reasons), ", "))
    return out.select(key, "runs", "reasons", (F.col("reasons") != "").alias("retrain"))


ERROR_METRICS = ["mae", "rmse", "mse"]


def performance_trend(runs: DataFrame, metrics, key: str = "purpose", order: str = "run_id") -> DataFrame:
    """WIN-9: mean of the last 10 runs, last-5 against previous-5 means, trend and change; error metrics flip the sign."""
    last = top_per_key(runs, [key], [F.desc(order)], 10)
    long = last.unpivot([key, "rn"], list(metrics), "metric", "value")
    g = long.groupBy(key, "metric").agg(
        F.round(F.avg("value"), 6).alias("average"), F.avg(F.when(F.col("rn") <= 5, F.col("value"))).alias("a"),
        F.avg(F.when(F.col("rn") > 5, F.col("value"))).alias("b"))
    change = F.when(F.col("b") != 0, (F.col("a") - F.col("b")) / F.abs("b") * 100).otherwise(0.0)
    signed = F.when(F.col("metric").isin(ERROR_METRICS), -change).otherwise(change)
    return g.select(key, "metric", "average", F.round(change, 6).alias("change_percent"),
                    F.when(F.col("b").isNull(), "insufficient_data").when(signed > 0, "improving").when(signed < 0, "declining").otherwise("stable").alias("trend"))


def best_model(models: DataFrame) -> DataFrame:
    """WIN-10: highest F1 per purpose, R² for quality; ties go to the lower id."""
    value = F.when(F.col("purpose") == "quality", F.col("r2_score")).otherwise(F.col("f1_score"))
    best = F.max_by(F.struct("id", "model_name", value.alias("metric")), F.struct(value, -F.col("id")))
    return models.where("is_active").groupBy("purpose").agg(best.alias("b")).select("purpose", "b.*")


def quality_trend(quality: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """WIN-11: previous score and trend per lead.

    The previous row is found by position: rows are numbered over range partitions, which split a lead that owns a
    large share of the table, and then joined to position - 1.
    """
    rows = number_rows(quality.select("id", "lead_id", "overall_score", "created_at"), ["lead_id", "created_at", "id"]).drop("_total")
    prev = rows.select((F.col("position") + 1).alias("position"), F.col("lead_id").alias("_lead"), F.col("overall_score").alias("_prev"))
    joined = rows.join(prev, "position", "left").withColumn("previous_score", F.when(F.col("_lead") == F.col("lead_id"), F.col("_prev")))
    d = F.col("overall_score") - F.col("previous_score")
    return joined.select("id", "lead_id", "overall_score", "created_at", "previous_score").withColumn(
        "quality_trend", F.when(F.col("previous_score").isNull(), F.lit(None)).when(d > tolerance, "improving").when(d < -tolerance, "declining").otherwise("stable"))


def downsample(df: DataFrame, order_keys, max_points: int = 100) -> DataFrame:
    """PRD-16: every ceil(n/max)-th row in key order, for a long ordered table.

    Range-sorted partitions are numbered locally; their start offsets come from per-partition counts.
    """
    names = [str(k) for k in order_keys]
    return number_rows(df, names).withColumn("_step", F.greatest(F.lit(1), F.ceil(F.col("_total") / max_points))).where(
        (F.col("position") - 1) % F.col("_step") == 0).drop("_step", "_total")


def number_rows(df: DataFrame, keys) -> DataFrame:
    """Position of every row in key order (WIN-12 for tables without an ordinal), keys being unique together.

    The rows are cut by range into partitions and written down once, so that both passes see the same cut.
    """
    from ..session import cut_lineage

    cut = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = cut.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
                           F.sum("_c").over(Window.partitionBy()).alias("_total"))
    rows = cut.withColumn("_p", part).join(starts, "_p")
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("position", F.col("_start") + local + 1).drop("_m", "_p", "_start")


def score_statistics(df: DataFrame, score: str = "score") -> DataFrame:
    """AGG-42/43/44: one row of score statistics, bands, percentiles, label and opportunities."""
    s = F.col(score)
    bands = {"exceptional": s >= 90, "excellent": (s >= 80) & (s < 90), "high": (s >= 70) & (s < 80),
             "medium": (s >= 55) & (s < 70), "low": (s >= 40) & (s < 55), "poor": s < 40}
    agg = df.agg(F.count(score).alias("total_leads"), F.round(F.avg(score), 6).alias("average_score"), F.min(score).alias("min_score"),
                 F.max(score).alias("max_score"), F.round(F.coalesce(F.stddev_samp(score), F.lit(0.0)), 6).alias("standard_deviation"),
                 *[F.count(F.when(c, 1)).alias(n) for n, c in bands.items()])
    out = agg.crossJoin(index_percentiles(df, score).drop("n"))
    n = F.greatest(F.col("total_leads"), F.lit(1))
    rate = (F.col("exceptional") + F.col("excellent")) * 100.0 / n
    a = F.col("average_score")
    label = (F.when((rate >= 30) & (a >= 80), "Exceptional").when((rate >= 20) & (a >= 75), "Excellent")
             .when((rate >= 10) & (a >= 65), "High").when(a >= 55, "Medium").otherwise("Low"))
    chances = compact(
        say(F.col("poor") * 100.0 / n > 20, "High percentage of poor quality leads - review data sources"),
        say(F.col("low") * 100.0 / n > 30, "Consider data enrichment to improve lead quality"),
        say(a < 60, "Overall lead quality below average - implement qualification criteria"),
        say(rate < 10, "Low percentage of excellent leads - refine targeting criteria"))
    return out.withColumns({
        "excellent_rate": F.round(rate, 6), "high_quality_rate": F.round(rate + F.col("high") * 100.0 / n, 6),
        "overall_quality": label, "improvement_opportunities": F.array_join(chances, " | "),
        # Fixed comparison mean.
        "performance_vs_benchmark": F.round(a - 65.0, 6)})
