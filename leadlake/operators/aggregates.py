"""Dashboard, quality, conversion, return and forecast aggregates (AGG-*).

Tenants are a grouping key, so one job serves every owner. Each report is one pass with conditional aggregates;
children are joined to leads on their key before aggregating and nothing is collected per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import compact, present, ratio, recent, say, tiers

PRIORITY_BANDS = [(85, "critical"), (70, "high"), (50, "medium")]
QUALITY_BANDS = [(85, "excellent"), (70, "good"), (50, "fair")]
MATCH_BANDS = [(95, "very_high"), (85, "high"), (75, "medium")]
CONVERSION_BANDS = [(80, "high_ai_score"), (60, "medium_ai_score")]
LEVELS = ["critical", "high", "medium", "low"]


def r6(c: Column) -> Column:
    return F.round(c, 6)


def mean(c) -> Column:
    return r6(F.coalesce(F.avg(c), F.lit(0.0)))


def n_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def known(source: Column) -> Column:
    """PRD-12."""
    return F.coalesce(F.when(source != "", source), F.lit("unknown"))


def owned(child: DataFrame, leads: DataFrame, key: str = "lead_id", cols=()) -> DataFrame:
    """JN-1/JN-5: child rows with the owner (and more) of their lead."""
    side = leads.select(F.col("id").alias("_lead"), "owner_id", *[F.col(c).alias(f"lead_{c}") for c in cols])
    return child.join(side, F.col(key) == F.col("_lead")).drop("_lead")


def lead_statistics(leads: DataFrame) -> DataFrame:
    """AGG-1 as grouping sets: owner, owner x status and owner x source in a single pass."""
    base = leads.select("owner_id", "status", known(F.col("source")).alias("source"), "email", "score")
    sets = [["owner_id"], ["owner_id", "status"], ["owner_id", "source"]]
    cols = [[F.col(c) for c in s] for s in sets]
    return base.groupingSets(cols, "owner_id", "status", "source").agg(
        F.count("*").alias("total"),
        r6(ratio(n_if(present(F.col("email"))), F.count("*"), 100.0)).alias("email_coverage"),
        mean("score").alias("average_score"),
    )


def ai_metrics(leads: DataFrame, predictions: DataFrame, quality: DataFrame) -> DataFrame:
    """AGG-2."""
    p = owned(predictions, leads).groupBy("owner_id").agg(
        F.count("*").alias("leads_analyzed"), mean("confidence").alias("average_ai_confidence"),
        n_if(F.col("prediction_score") > 80).alias("high_priority_leads"))
    q = owned(quality, leads).groupBy("owner_id").agg(
        mean("overall_score").alias("average_data_quality"), n_if(F.col("overall_score") < 70).alias("quality_issues_detected"))
    t = leads.groupBy("owner_id").agg(F.count("*").alias("total"))
    out = t.join(p, "owner_id", "left").join(q, "owner_id", "left").na.fill(0)
    return out.withColumn("ai_coverage", r6(ratio(F.col("leads_analyzed"), F.col("total"), 100.0))).drop("total")


def overview(leads: DataFrame, companies: DataFrame, campaigns: DataFrame, as_of: str) -> DataFrame:
    """AGG-3: per-owner counts; the global company count is a one-row scalar aggregate."""
    l = leads.groupBy("owner_id").agg(F.count("*").alias("total_leads"), n_if(recent(F.col("created_at"), as_of, 7)).alias("recent_leads"))
    c = campaigns.groupBy("owner_id").agg(F.count("*").alias("total_campaigns"))
    n = companies.agg(F.count("*").alias("total_companies"))
    return l.join(c, "owner_id", "left").na.fill(0, ["total_campaigns"]).crossJoin(n)


def count_by(df: DataFrame, *keys, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def campaign_lead_counts(campaigns: DataFrame, leads: DataFrame) -> DataFrame:
    """JN-2/JN-9: leads are counted before the join, campaigns without leads keep 0."""
    counts = leads.where("campaign_id IS NOT NULL").groupBy("campaign_id").agg(F.count("*").alias("leads_count"))
    joined = campaigns.join(counts, F.col("id") == F.col("campaign_id"), "left").drop("campaign_id")
    return joined.withColumn("leads_count", F.coalesce("leads_count", F.lit(0).cast("bigint")))


def period_metrics(leads, predictions, quality, as_of: str, days: int) -> DataFrame:
    """AGG-7."""
    p = owned(predictions.where(recent(F.col("created_at"), as_of, days)), leads).groupBy("owner_id").agg(
        F.count("*").alias("leads_analyzed"), mean("prediction_score").alias("average_priority_score"),
        mean("confidence").alias("average_confidence"))
    q = owned(quality.where(recent(F.col("created_at"), as_of, days)), leads).groupBy("owner_id").agg(
        mean("overall_score").alias("average_data_quality"), F.count("*").alias("quality_assessments"))
    return p.join(q, "owner_id", "full").na.fill(0)


def daily(df: DataFrame, ts: str, *aggs: Column, keys=("owner_id",)) -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(*aggs)


def lead_trends(leads, predictions, quality, as_of: str, days: int, outer: bool = False) -> DataFrame:
    """AGG-11 with JN-7: three daily series per owner merged on date.

    Days without a new lead are dropped as in the report; ``outer`` keeps them.
    """
    new = daily(leads.where(recent(F.col("created_at"), as_of, days)), "created_at", F.count("*").alias("count"))
    ai = daily(owned(predictions.where(recent(F.col("created_at"), as_of, days)), leads), "created_at",
               F.count("*").alias("ai_analyses"), mean("prediction_score").alias("avg_priority"), mean("confidence").alias("avg_confidence"))
    q = daily(owned(quality.where(recent(F.col("created_at"), as_of, days)), leads), "created_at", mean("overall_score").alias("avg_quality"))
    how = "full" if outer else "left"
    return new.join(ai, ["owner_id", "date"], how).join(q, ["owner_id", "date"], how).na.fill(0)


def priority_tiers(predictions: DataFrame, leads: DataFrame) -> DataFrame:
    """AGG-12."""
    return count_by(owned(predictions, leads), "owner_id", tiers(F.col("prediction_score"), PRIORITY_BANDS, "low").alias("priority"))


def insight_levels(insights: DataFrame, leads: DataFrame) -> DataFrame:
    """AGG-13: active priority insights by level, unknown levels left out."""
    rows = insights.where((F.col("status") == "active") & (F.col("insight_type") == "priority") & F.col("priority_level").isin(LEVELS))
    return count_by(owned(rows, leads), "owner_id", F.col("priority_level").alias("priority"))


def merged_levels(predictions, insights, leads) -> DataFrame:
    """JN-15: per level the larger of prediction tier count, insight count and, for high/critical, all active insights.

    The counted series are stacked and pivoted with ``max``, so there is no join at all; missing levels are 0.
    """
    urgent = insights.where((F.col("status") == "active") & F.col("priority_level").isin("high", "critical"))
    stacked = priority_tiers(predictions, leads).unionByName(insight_levels(insights, leads)).unionByName(
        count_by(owned(urgent, leads), "owner_id", F.col("priority_level").alias("priority")))
    return stacked.groupBy("owner_id").agg(*[
        F.coalesce(F.max(F.when(F.col("priority") == level, F.col("count"))), F.lit(0)).alias(f"{level}_priority_count") for level in LEVELS])


def ai_summary(predictions, insights, leads) -> DataFrame:
    """AGG-14 without the text list (SRT-4)."""
    stats = owned(predictions, leads).groupBy("owner_id").agg(
        F.count("*").alias("total_leads_analyzed"), mean("prediction_score").alias("average_prediction_score"),
        mean("confidence").alias("average_confidence"))
    out = merged_levels(predictions, insights, leads).join(stats, "owner_id", "left").na.fill(0)
    # The report publishes the mean prediction score under a quality name; both names are kept.
    return out.withColumn("average_quality_score", F.col("average_prediction_score"))


def operations_performance(log: DataFrame, as_of: str, days: int, model_name: str | None = None) -> DataFrame:
    """AGG-15 in one pass."""
    rows = log.where(recent(F.col("start_time"), as_of, days))
    if model_name:
        rows = rows.where(F.col("model_name") == model_name)
    done = F.col("processing_status") == "completed"
    failed = r6(ratio(n_if(F.col("processing_status") == "failed"), F.count("*"), 100.0))
    return rows.groupBy("user_id").agg(
        n_if(done).alias("total_operations"),
        mean(F.when(done, F.col("processing_duration_ms"))).alias("average_duration_ms"),
        mean(F.when(done, F.col("cpu_usage_percent"))).alias("average_cpu_usage"),
        mean(F.when(done, F.col("memory_usage_mb"))).alias("average_memory_mb"),
        failed.alias("error_rate_percent"), r6(100 - failed).alias("success_rate_percent"))


def flag_mean(c: str) -> Column:
    """Mean of a boolean as 1/0 where null counts as 0."""
    return r6(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)))


def top_issues(quality: DataFrame, leads: DataFrame, k: int = 10) -> DataFrame:
    """AGG-20: issues exploded from JSON text, malformed text skipped; top k per owner by count, then name.

    ``row_number() <= k`` lets the planner keep only k rows per owner before the shuffle.
    """
    rows = owned(quality.select("lead_id", "issues_found"), leads)
    total = rows.groupBy("owner_id").agg(F.count("*").alias("total"))
    parsed = rows.select("owner_id", F.explode(F.from_json("issues_found", "array<string>")).alias("issue"))
    counts = count_by(parsed, "owner_id", "issue")
    w = Window.partitionBy("owner_id").orderBy(F.desc("count"), "issue")
    top = counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
    return top.join(total, "owner_id").withColumn("percentage", r6(F.col("count") * 100.0 / F.col("total"))).drop("total")


def quality_summary(quality, leads) -> DataFrame:
    """AGG-18."""
    cols = {"overall_score": "average_overall_score", "email_quality_score": "average_email_quality",
            "completeness_score": "average_completeness", "accuracy_score": "average_accuracy", "consistency_score": "average_consistency"}
    return owned(quality, leads).groupBy("owner_id").agg(
        F.count("*").alias("total_assessments"), *[mean(c).alias(n) for c, n in cols.items()])


def duplicate_summary(duplicates, leads, as_of: str) -> DataFrame:
    """AGG-22."""
    return owned(duplicates, leads, "primary_lead_id").groupBy("owner_id").agg(
        F.count("*").alias("total_duplicates"), n_if(F.col("auto_merge_recommended")).alias("auto_merge_candidates"),
        mean("match_score").alias("average_match_score"), n_if(recent(F.col("detected_at"), as_of, 7)).alias("recent_detections"))


def converted() -> Column:
    return F.col("status") == "converted"


def conversion_rate(leads, as_of: str, days: int) -> DataFrame:
    """AGG-25 with AGG-28."""
    rows = leads.where(recent(F.col("created_at"), as_of, days))
    seconds = F.unix_timestamp(F.col("updated_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return rows.groupBy("owner_id").agg(
        F.count("*").alias("total_leads"), n_if(converted()).alias("converted_leads"),
        r6(ratio(n_if(converted()), F.count("*"), 100.0)).alias("conversion_rate_percent"),
        r6(F.coalesce(F.avg(F.when(converted(), seconds)), F.lit(0.0)) / 86400).alias("average_days_to_convert"))


def conversion_by_score(leads, predictions, as_of: str, days: int, per_lead: bool = False) -> DataFrame:
    """AGG-26. One count per prediction as in the report; ``per_lead`` keeps only the latest prediction of each lead."""
    if per_lead:
        predictions = latest_by(predictions, "lead_id", "created_at", "id")
    rows = owned(predictions, leads.where(recent(F.col("created_at"), as_of, days)), cols=["status"])
    hit = F.col("lead_status") == "converted"
    return rows.groupBy("owner_id", tiers(F.col("prediction_score"), CONVERSION_BANDS, "low_ai_score").alias("ai_score_tier")).agg(
        F.count("*").alias("total_leads"), n_if(hit).alias("converted"), r6(ratio(n_if(hit), F.count("*"), 100.0)).alias("conversion_rate"))


def latest_by(child: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """WIN-1 as an aggregate: ``max_by`` combines map-side, so a hot key never lands whole in one task."""
    row = F.struct(*child.columns)
    picked = child.groupBy(key).agg(F.max_by(row, F.struct(ts, tie)).alias("r"))
    return picked.select("r.*")


def source_performance(leads, as_of: str, days: int) -> DataFrame:
    """AGG-27."""
    return leads.where(recent(F.col("created_at"), as_of, days)).groupBy("owner_id", "source").agg(
        F.count("*").alias("total_leads"), n_if(converted()).alias("converted"),
        r6(ratio(n_if(converted()), F.count("*"), 100.0)).alias("conversion_rate"), mean("score").alias("average_score"))


def model_comparison(models, predictions, feedback, leads) -> DataFrame:
    """AGG-29, JN-10, SRT-5: active models against per-owner aggregates of their type."""
    p = owned(predictions, leads)
    usage = p.groupBy("owner_id", "model_type").agg(
        F.count("*").alias("predictions_made"), mean("confidence").alias("avg_confidence"),
        mean("processing_time_ms").alias("avg_processing_time_ms"))
    rated = feedback.select("prediction_id", "is_helpful", "is_accurate").join(
        p.select(F.col("id").alias("prediction_id"), "owner_id", "model_type"), "prediction_id")
    votes = rated.groupBy("owner_id", "model_type").agg(flag_mean("is_helpful").alias("user_helpfulness"), flag_mean("is_accurate").alias("user_accuracy"))
    merged = usage.join(votes, ["owner_id", "model_type"], "left").na.fill(0).withColumnRenamed("model_type", "_type")
    active = models.where("is_active").select("model_name", "model_type", "version", "accuracy", F.split_part("model_name", F.lit("_"), F.lit(1)).alias("_key"))
    out = active.join(merged, F.col("_key") == F.col("_type"), "left").drop("_key", "_type").na.fill(
        0, ["predictions_made", "avg_confidence", "avg_processing_time_ms", "user_helpfulness", "user_accuracy"])
    return out.withColumn("performance", r6(F.col("user_accuracy") * 0.4 + F.col("user_helpfulness") * 0.3 + F.col("avg_confidence") * 0.3))


def roi(leads, predictions, quality, log, duplicates, as_of: str, days: int) -> DataFrame:
    """AGG-30. Log rows belong to the owner whose id is the user's; each table is reduced to one row per owner first."""
    in_range = leads.where(recent(F.col("created_at"), as_of, days))
    ops = log.where(recent(F.col("start_time"), as_of, days) & (F.col("processing_status") == "completed")).groupBy(
        F.col("user_id").alias("owner_id")).agg(F.count("*").alias("ops"), F.sum("processing_duration_ms").alias("ai_time"))
    recent_p = predictions.where(recent(F.col("created_at"), as_of, days))
    analyzed = owned(recent_p, leads).groupBy("owner_id").agg(F.count_distinct("lead_id").alias("leads_analyzed_by_ai"))
    q = owned(quality.where(recent(F.col("created_at"), as_of, days)), leads).groupBy("owner_id").agg(
        mean("overall_score").alias("average_data_quality"), F.count("*").alias("quality_assessments"),
        n_if(F.col("overall_score") >= 80).alias("high_quality_leads"))
    hit = F.col("lead_status") == "converted"
    with_ai = owned(predictions.select("lead_id"), in_range, cols=["status"]).groupBy("owner_id").agg(
        r6(ratio(n_if(hit), F.count("*"), 100.0)).alias("ai_conversion_rate"))
    without = in_range.join(predictions.select("lead_id"), F.col("id") == F.col("lead_id"), "left_anti").groupBy("owner_id").agg(
        r6(ratio(n_if(converted()), F.count("*"), 100.0)).alias("non_ai_conversion_rate"))
    dups = owned(duplicates.where(recent(F.col("detected_at"), as_of, days)), leads, "primary_lead_id").groupBy("owner_id").agg(
        F.count("*").alias("duplicates_detected"))
    totals = leads.groupBy("owner_id").agg(n_if(recent(F.col("created_at"), as_of, days)).alias("n_leads"))
    out = totals
    for side in (ops, analyzed, q, with_ai, without, dups):
        out = out.join(side, "owner_id", "left")
    out = out.na.fill(0)
    manual = F.col("leads_analyzed_by_ai") * 300000.0
    hours = (manual - F.col("ai_time")) / 3600000.0
    return out.select(
        "owner_id", r6(hours).alias("time_saved_hours"), r6(hours * 50).alias("estimated_cost_savings"), "leads_analyzed_by_ai",
        "duplicates_detected", "high_quality_leads",
        r6(manual / F.greatest(F.col("ai_time"), F.lit(1.0))).alias("manual_vs_ai_time_ratio"),
        r6(F.col("ai_time") / F.greatest(F.col("ops"), F.lit(1))).alias("average_processing_time_ms"),
        r6(F.col("leads_analyzed_by_ai") * 100.0 / F.greatest(F.col("n_leads"), F.lit(1))).alias("automation_coverage_percent"),
        "average_data_quality", "quality_assessments", "ai_conversion_rate", "non_ai_conversion_rate",
        r6(F.col("ai_conversion_rate") - F.col("non_ai_conversion_rate")).alias("conversion_improvement"))


def trailing_means(daily_counts: DataFrame, calendar: bool = False) -> DataFrame:
    """WIN-5: mean of the last 7 active days and the 7 before, per owner. A series holds at most one row per day.

    ``calendar`` counts days instead of active days.
    """
    if calendar:
        last = daily_counts.groupBy("owner_id").agg(F.max("date").alias("last"))
        ranked = daily_counts.join(last, "owner_id").withColumn("rn", F.datediff("last", "date") + 1)
        points = F.greatest(F.max("rn"), F.lit(0))
    else:
        ranked = daily_counts.withColumn("rn", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("date"))))
        points = F.count("*")
    g = ranked.groupBy("owner_id").agg(
        points.cast("bigint").alias("data_points"),
        (F.sum(F.when(F.col("rn") <= 7, F.col("count"))) / 7).alias("r7"),
        (F.coalesce(F.sum(F.when(F.col("rn").between(8, 14), F.col("count"))), F.lit(0)) / 7).alias("o7"),
        F.avg("count").alias("all_mean"))
    recent_avg = F.when(F.col("data_points") >= 7, F.col("r7")).otherwise(F.col("all_mean"))
    older = F.when(F.col("data_points") >= 14, F.col("o7")).otherwise(recent_avg)
    return g.select("owner_id", "data_points", recent_avg.alias("recent_avg"), older.alias("older_avg"))


def forecast(leads, predictions, quality, as_of: str, forecast_days: int = 30, lookback: int = 90) -> DataFrame:
    """AGG-31."""
    series = daily(leads.where(recent(F.col("created_at"), as_of, lookback)), "created_at", F.count("*").alias("count"))
    trend = trailing_means(series)
    growth = F.when(F.col("data_points") >= 7, (F.col("recent_avg") - F.col("older_avg")) / F.greatest(F.col("older_avg"), F.lit(1.0))).otherwise(0.0)
    q = owned(quality.where(recent(F.col("created_at"), as_of, 14)), leads).groupBy("owner_id").agg(F.avg("overall_score").alias("q"))
    conv = leads.where(recent(F.col("created_at"), as_of, 30)).groupBy("owner_id").agg(
        ratio(n_if(converted()), F.count("*")).alias("conv"))
    usage = owned(predictions.where(recent(F.col("created_at"), as_of, 7)), leads).groupBy("owner_id").agg(F.count("*").alias("ai_usage_weekly"))
    base = trend.withColumn("growth", growth)
    for side in (q, conv, usage):
        base = base.join(side, "owner_id", "left")
    base = base.na.fill(0)
    leads_ahead = F.greatest(F.lit(0.0), F.col("recent_avg") * (1 + F.col("growth")) * forecast_days)
    return base.select(
        "owner_id", r6(leads_ahead).alias("expected_new_leads"), r6(leads_ahead * F.col("conv")).alias("expected_conversions"),
        r6(F.col("conv") * 100).alias("predicted_conversion_rate"), r6("q").alias("expected_data_quality"),
        r6(F.col("growth") * 100).alias("growth_rate"), r6("recent_avg").alias("recent_daily_average"), "ai_usage_weekly", "data_points",
        F.when(F.abs("growth") < 0.2, "high").when(F.abs("growth") < 0.5, "moderate").otherwise("low").alias("trend_stability"))


def activity(predictions, leads, as_of: str, days: int, approximate: bool = False) -> DataFrame:
    """AGG-32."""
    distinct = F.approx_count_distinct("lead_id") if approximate else F.count_distinct("lead_id")
    return owned(predictions.where(recent(F.col("created_at"), as_of, days)), leads).groupBy("owner_id").agg(
        distinct.alias("leads_analyzed"), F.count("*").alias("total_predictions"),
        mean("prediction_score").alias("average_priority_score"), mean("confidence").alias("average_confidence"))


def feedback_summary(feedback, as_of: str, days: int) -> DataFrame:
    """AGG-34."""
    n = F.greatest(F.count("*"), F.lit(1))
    return feedback.where(recent(F.col("created_at"), as_of, days)).groupBy("user_id").agg(
        F.count("*").alias("total_feedback"), mean("rating").alias("average_rating"),
        r6(n_if(F.col("is_helpful")) * 100.0 / n).alias("helpfulness_rate"), r6(n_if(F.col("is_accurate")) * 100.0 / n).alias("accuracy_rate"))


def sentiment(rating: Column) -> Column:
    return F.when(rating >= 4, "positive").when(rating <= 2, "negative").otherwise("neutral")


def system_health(models, predictions, log, as_of: str) -> DataFrame:
    """AGG-36: one row; the feature list is a set over at most six names."""
    name = F.col("model_name")
    feats = F.flatten(F.array(
        F.when(name.contains("priority") | name.contains("classifier"), F.array(F.lit("lead_prioritization"), F.lit("smart_scoring"))).otherwise(F.array().cast("array<string>")),
        F.when(name.contains("quality"), F.array(F.lit("data_quality_assessment"), F.lit("automated_cleanup"))).otherwise(F.array().cast("array<string>")),
        F.when(name.contains("similarity"), F.array(F.lit("lead_similarity"), F.lit("duplicate_detection"))).otherwise(F.array().cast("array<string>"))))
    m = models.where("is_active").select(feats.alias("f"), "model_name").agg(
        F.count("*").alias("active_models"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("f")))), ",").alias("available_features"))
    p = predictions.agg(n_if(recent(F.col("created_at"), as_of, 1)).alias("recent_predictions"))
    day = recent(F.col("start_time"), as_of, 1)
    l = log.agg(mean(F.when(day & (F.col("processing_status") == "completed"), F.col("processing_duration_ms"))).alias("average_response_time_ms"),
                r6(n_if(day & (F.col("processing_status") == "failed")) * 100.0 / F.greatest(n_if(day), F.lit(1))).alias("error_rate_percentage"),
                n_if(F.col("processing_status") == "started").alias("pending_operations"))
    load = F.least(F.lit(100.0), F.col("recent_predictions") / 1000 * 100)
    return m.crossJoin(p).crossJoin(l).withColumn("system_load_percentage", r6(load)).withColumn(
        "system_status", F.when((F.col("error_rate_percentage") > 20) | (F.col("active_models") == 0), "critical").when(
            (F.col("error_rate_percentage") > 10) | (F.col("system_load_percentage") > 80), "degraded").otherwise("healthy"))


def quality_report(quality, leads, as_of: str, days: int) -> DataFrame:
    """AGG-37."""
    return owned(quality, leads).groupBy("owner_id").agg(
        mean("overall_score").alias("overall_score"), F.count("*").alias("total_assessments"),
        n_if(recent(F.col("created_at"), as_of, days) & (F.col("overall_score") >= 80)).alias("recent_improvements"),
        mean("email_quality_score").alias("email_quality"), mean("completeness_score").alias("completeness"),
        mean("accuracy_score").alias("accuracy"))


def insight_summary(insights, leads) -> DataFrame:
    """AGG-39: counts per level, mean impact and the commonest level (ties by name)."""
    by_level = owned(insights, leads).groupBy("owner_id", F.coalesce("priority_level", F.lit("unknown")).alias("level")).agg(
        F.count("*").alias("n"), F.sum("impact_score").alias("impact"))
    return by_level.groupBy("owner_id").agg(
        F.sum("n").alias("total_insights"),
        *[F.coalesce(F.sum(F.when(F.col("level") == lv, F.col("n"))), F.lit(0)).alias(f"n_{lv}") for lv in LEVELS + ["unknown"]],
        r6(F.sum("impact") / F.sum("n")).alias("average_impact_score"),
        F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("top_priority"))


# ---- recommendation texts (AGG-54, fixed wording) ---------------------------------------------------------------


def join_lines(*items: Column) -> Column:
    return F.array_join(compact(*items), " | ")


def duplicate_recommendations() -> Column:
    total, auto = F.col("total_duplicates"), F.col("auto_merge_candidates")
    return join_lines(
        say((total > 0) & (auto > 0), F.format_string("Consider auto-merging %d high-confidence duplicates", auto)),
        say((total > 0) & (total - auto > 0), F.format_string("Review %d potential duplicates manually", total - auto)),
        say((total > 0) & (F.col("average_match_score") < 85), "Consider adjusting duplicate detection threshold for better accuracy"),
        say(total == 0, "No duplicates detected - your lead data quality is excellent!"))


def conversion_insights() -> Column:
    rate = F.col("conversion_rate_percent")
    return join_lines(say(rate > 15, "Excellent conversion rate - consider scaling successful strategies"),
                      say(rate < 5, "Low conversion rate detected - review lead qualification criteria"))


def forecast_recommendations() -> Column:
    g, q, c = F.col("growth_rate") / 100, F.col("expected_data_quality"), F.col("predicted_conversion_rate") / 100
    return join_lines(
        say(g > 0.1, "Lead generation is growing - consider scaling successful acquisition channels"),
        say(g < -0.1, "Lead generation is declining - review and optimize acquisition strategies"),
        say((q > 0) & (q < 70), "Data quality needs improvement - focus on better lead sources and validation"),
        say(q > 85, "Excellent data quality - maintain current standards"),
        say(c < 0.05, "Low conversion rate - improve lead qualification and nurturing processes"),
        say(c > 0.15, "High conversion rate - document and replicate successful approaches"))


def value_drivers() -> Column:
    t, c, d = F.col("time_saved_hours"), F.col("conversion_improvement"), F.col("duplicates_detected")
    band = lambda x, hi, mid: F.when(x > hi, "high").when(x > mid, "medium").otherwise("low")
    return join_lines(
        say(t > 0, F.concat(F.format_string("Time Automation: %.1f hours saved, ", t), band(t, 20, 5))),
        say(c > 0, F.concat(F.format_string("Conversion Improvement: +%.1f%% conversion rate, ", c), band(c, 5, 2))),
        say(d > 0, F.format_string("Data Quality: %d duplicates detected, medium", d)))


def quality_recommendations() -> Column:
    o, e, c = F.col("overall_score"), F.col("email_quality"), F.col("completeness")
    return join_lines(
        say(o < 70, "Overall data quality needs improvement - consider data cleanup"),
        say(e < 60, "Email quality is low - validate and enrich email addresses"),
        say(c < 70, "Data completeness is low - fill in missing lead information"),
        say((o >= 70) & (e >= 60) & (c >= 70), "Great job! Your data quality is excellent."))


def feedback_impact() -> Column:
    h, a, n = F.col("helpfulness_rate"), F.col("accuracy_rate"), F.col("total_feedback")
    return (F.when(n == 0, "No feedback submitted yet. Your feedback helps improve AI accuracy!")
            .when((h > 80) & (a > 80), "Excellent! Your feedback shows our AI is performing very well for you.")
            .when(h > 60, "Good feedback! We're continuously improving based on your input.")
            .otherwise("Thank you for your feedback. We're working to improve AI performance based on your suggestions."))


def model_recommendation() -> Column:
    a = F.col("user_accuracy")
    return (F.when(a > 0.8, F.format_string("'%s' is performing excellently for your data - continue using", "model_name"))
            .when(a > 0.6, F.format_string("'%s' is performing well - consider providing more feedback to improve", "model_name"))
            .otherwise("Model performance could be improved - consider retraining with more data"))
