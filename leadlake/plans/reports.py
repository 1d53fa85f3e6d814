"""Registered dashboard and analytics reports (AGG-1 .. AGG-37, AGG-39, AGG-54)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import recent, tiers
from ..operators import aggregates as A
from ..operators.aggregates import mean, owned
from ..sources.bindings import AS_OF, EVENTS_AS_OF
from .registry import query

# Report dates inside the range of the given tables.
TREND_AS_OF = "1996-01-01 00:00:00"
LONG = 12000

P = "predictions p JOIN leads l ON p.lead_id = l.id"
Q = "quality_scores q JOIN leads l ON q.lead_id = l.id"
I = "insights i JOIN leads l ON i.lead_id = l.id"


def m(c: str) -> str:
    return f"round(coalesce(avg({c}), 0), 6)"


def since(col: str, as_of: str, days: int) -> str:
    return f"{col} >= TIMESTAMP '{as_of}' - INTERVAL {days} DAY"


@query("agg_1", ["leads"], """
SELECT owner_id, status, source, count(*) AS total,
       round(count(CASE WHEN email <> '' THEN 1 END) * 100.0::DOUBLE / count(*), 6) AS email_coverage, round(coalesce(avg(score), 0), 6) AS average_score
FROM (SELECT owner_id, status, coalesce(nullif(source, ''), 'unknown') AS source, email, score FROM leads)
GROUP BY GROUPING SETS ((owner_id), (owner_id, status), (owner_id, source))""")
def agg_1(t):
    return A.lead_statistics(t.leads(dates=False))


@query("agg_2", ["leads", "predictions", "quality_scores"], f"""
SELECT t.owner_id, coalesce(leads_analyzed, 0) AS leads_analyzed, coalesce(average_ai_confidence, 0) AS average_ai_confidence,
  coalesce(high_priority_leads, 0) AS high_priority_leads, coalesce(average_data_quality, 0) AS average_data_quality,
  coalesce(quality_issues_detected, 0) AS quality_issues_detected, round(coalesce(leads_analyzed, 0) * 100.0::DOUBLE / total, 6) AS ai_coverage
FROM (SELECT owner_id, count(*) AS total FROM leads GROUP BY 1) t
LEFT JOIN (SELECT owner_id, count(*) AS leads_analyzed, {m('confidence')} AS average_ai_confidence,
  count(CASE WHEN prediction_score > 80 THEN 1 END) AS high_priority_leads FROM {P} GROUP BY 1) a ON a.owner_id = t.owner_id
LEFT JOIN (SELECT owner_id, {m('overall_score')} AS average_data_quality, count(CASE WHEN overall_score < 70 THEN 1 END) AS quality_issues_detected
  FROM {Q} GROUP BY 1) b ON b.owner_id = t.owner_id""")
def agg_2(t):
    return A.ai_metrics(t.leads(dates=False), t.predictions(), t.quality_scores())


@query("agg_3", ["leads", "companies", "campaigns"], f"""
SELECT l.owner_id, total_leads, recent_leads, coalesce(total_campaigns, 0) AS total_campaigns, (SELECT count(*) FROM companies) AS total_companies
FROM (SELECT owner_id, count(*) AS total_leads, count(CASE WHEN {since('created_at', TREND_AS_OF, 7)} THEN 1 END) AS recent_leads FROM leads GROUP BY 1) l
LEFT JOIN (SELECT owner_id, count(*) AS total_campaigns FROM campaigns GROUP BY 1) c ON c.owner_id = l.owner_id""")
def agg_3(t):
    return A.overview(t.leads(), t.companies(), t.campaigns(), TREND_AS_OF)


@query("agg_4", ["leads"], "SELECT owner_id, status, count(*) AS count FROM leads GROUP BY ALL")
def agg_4(t):
    return A.count_by(t.leads(dates=False), "owner_id", "status")


@query("agg_5", ["leads"], "SELECT owner_id, coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS count FROM leads GROUP BY ALL")
def agg_5(t):
    return A.count_by(t.leads(dates=False), "owner_id", A.known(F.col("source")).alias("source"))


@query("agg_6", ["leads", "campaigns"], """
SELECT c.id, c.name, count(l.id) AS leads_count FROM campaigns c LEFT JOIN leads l ON l.campaign_id = c.id
GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5""")
def agg_6(t):
    counts = A.campaign_lead_counts(t.campaigns().select("id", "name"), t.leads(dates=False))
    return counts.orderBy(F.desc("leads_count"), "id").limit(5)


@query("agg_7", ["leads", "predictions", "quality_scores"], f"""
SELECT coalesce(a.owner_id, b.owner_id) AS owner_id, coalesce(leads_analyzed, 0) AS leads_analyzed, coalesce(average_priority_score, 0) AS average_priority_score,
  coalesce(average_confidence, 0) AS average_confidence, coalesce(average_data_quality, 0) AS average_data_quality, coalesce(quality_assessments, 0) AS quality_assessments
FROM (SELECT owner_id, count(*) AS leads_analyzed, {m('prediction_score')} AS average_priority_score, {m('confidence')} AS average_confidence
  FROM {P} WHERE {since('p.created_at', EVENTS_AS_OF, LONG)} GROUP BY 1) a
FULL JOIN (SELECT owner_id, {m('overall_score')} AS average_data_quality, count(*) AS quality_assessments FROM {Q}
  WHERE {since('q.created_at', EVENTS_AS_OF, LONG)} GROUP BY 1) b ON a.owner_id = b.owner_id""")
def agg_7(t):
    return A.period_metrics(t.leads(dates=False), t.predictions(), t.quality_scores(), EVENTS_AS_OF, LONG)


@query("agg_8", ["leads"], f"""
SELECT owner_id, created_at::DATE AS date, count(*) AS count FROM leads WHERE {since('created_at', TREND_AS_OF, 365)} GROUP BY ALL ORDER BY 1, 2""")
def agg_8(t):
    rows = t.leads().where(recent(F.col("created_at"), TREND_AS_OF, 365))
    return A.daily(rows, "created_at", F.count("*").alias("count")).orderBy("owner_id", "date")


@query("agg_9", ["leads", "predictions"], f"""
SELECT owner_id, p.created_at::DATE AS date, count(*) AS ai_analyses, {m('prediction_score')} AS avg_priority, {m('confidence')} AS avg_confidence
FROM {P} WHERE {since('p.created_at', EVENTS_AS_OF, 20)} GROUP BY ALL""")
def agg_9(t):
    rows = owned(t.predictions().where(recent(F.col("created_at"), EVENTS_AS_OF, 20)), t.leads(dates=False))
    return A.daily(rows, "created_at", F.count("*").alias("ai_analyses"), mean("prediction_score").alias("avg_priority"), mean("confidence").alias("avg_confidence"))


@query("agg_10", ["leads", "quality_scores"], f"""
SELECT owner_id, q.created_at::DATE AS date, {m('overall_score')} AS avg_quality FROM {Q} WHERE {since('q.created_at', AS_OF, 365)} GROUP BY ALL""")
def agg_10(t):
    rows = owned(t.quality_scores().where(recent(F.col("created_at"), AS_OF, 365)), t.leads(dates=False))
    return A.daily(rows, "created_at", mean("overall_score").alias("avg_quality"))


TRENDS_SQL = f"""
SELECT n.owner_id, n.date, n.count, coalesce(ai_analyses, 0) AS ai_analyses, coalesce(avg_priority, 0) AS avg_priority,
  coalesce(avg_confidence, 0) AS avg_confidence, coalesce(avg_quality, 0) AS avg_quality
FROM (SELECT owner_id, created_at::DATE AS date, count(*) AS count FROM leads WHERE {since('created_at', TREND_AS_OF, 365)} GROUP BY ALL) n
LEFT JOIN (SELECT owner_id, p.created_at::DATE AS date, count(*) AS ai_analyses, {m('prediction_score')} AS avg_priority, {m('confidence')} AS avg_confidence
  FROM {P} WHERE {since('p.created_at', TREND_AS_OF, 365)} GROUP BY ALL) a ON a.owner_id = n.owner_id AND a.date = n.date
LEFT JOIN (SELECT owner_id, q.created_at::DATE AS date, {m('overall_score')} AS avg_quality FROM {Q} WHERE {since('q.created_at', TREND_AS_OF, 365)}
  GROUP BY ALL) b ON b.owner_id = n.owner_id AND b.date = n.date"""


@query("agg_11", ["leads", "predictions", "quality_scores"], TRENDS_SQL)
def agg_11(t):
    return A.lead_trends(t.leads(), t.predictions(), t.quality_scores(), TREND_AS_OF, 365)


@query("jn_7", ["leads", "predictions", "quality_scores"], TRENDS_SQL)
def jn_7(t):
    return A.lead_trends(t.leads(), t.predictions(), t.quality_scores(), TREND_AS_OF, 365)


TIER = "CASE WHEN prediction_score >= 85 THEN 'critical' WHEN prediction_score >= 70 THEN 'high' WHEN prediction_score >= 50 THEN 'medium' ELSE 'low' END"


@query("agg_12", ["leads", "predictions"], f"SELECT owner_id, {TIER} AS priority, count(*) AS count FROM {P} GROUP BY ALL")
def agg_12(t):
    return A.priority_tiers(t.predictions(), t.leads(dates=False))


@query("agg_13", ["leads", "insights"], f"""
SELECT owner_id, priority_level AS priority, count(*) AS count FROM {I} WHERE i.status = 'active' AND insight_type = 'priority'
AND priority_level IS NOT NULL GROUP BY ALL""")
def agg_13(t):
    return A.insight_levels(t.insights(), t.leads(dates=False))


MERGED = f"""
SELECT owner_id, coalesce(max(n) FILTER (WHERE priority = 'critical'), 0) AS critical_priority_count, coalesce(max(n) FILTER (WHERE priority = 'high'), 0) AS high_priority_count,
 coalesce(max(n) FILTER (WHERE priority = 'medium'), 0) AS medium_priority_count, coalesce(max(n) FILTER (WHERE priority = 'low'), 0) AS low_priority_count
FROM (SELECT owner_id, {TIER} AS priority, count(*) AS n FROM {P} GROUP BY ALL
 UNION ALL SELECT owner_id, priority_level, count(*) FROM {I} WHERE i.status = 'active' AND insight_type = 'priority' GROUP BY ALL
 UNION ALL SELECT owner_id, priority_level, count(*) FROM {I} WHERE i.status = 'active' AND priority_level IN ('high', 'critical') GROUP BY ALL) GROUP BY owner_id"""


@query("jn_15", ["leads", "predictions", "insights"], MERGED)
def jn_15(t):
    return A.merged_levels(t.predictions(), t.insights(), t.leads(dates=False))


@query("agg_14", ["leads", "predictions", "insights"], f"""
SELECT g.*, coalesce(total_leads_analyzed, 0) AS total_leads_analyzed, coalesce(s, 0) AS average_prediction_score, coalesce(c, 0) AS average_confidence,
 coalesce(s, 0) AS average_quality_score FROM ({MERGED}) g
LEFT JOIN (SELECT owner_id, count(*) AS total_leads_analyzed, {m('prediction_score')} AS s, {m('confidence')} AS c FROM {P} GROUP BY 1) a ON a.owner_id = g.owner_id""")
def agg_14(t):
    return A.ai_summary(t.predictions(), t.insights(), t.leads(dates=False))


@query("agg_15", ["processing_log"], f"""
SELECT user_id, count(CASE WHEN processing_status = 'completed' THEN 1 END) AS total_operations,
 round(coalesce(avg(processing_duration_ms) FILTER (WHERE processing_status = 'completed'), 0), 6) AS average_duration_ms,
 round(coalesce(avg(cpu_usage_percent) FILTER (WHERE processing_status = 'completed'), 0), 6) AS average_cpu_usage,
 round(coalesce(avg(memory_usage_mb) FILTER (WHERE processing_status = 'completed'), 0), 6) AS average_memory_mb,
 round(count(CASE WHEN processing_status = 'failed' THEN 1 END) * 100.0::DOUBLE / count(*), 6) AS error_rate_percent,
 round(100 - round(count(CASE WHEN processing_status = 'failed' THEN 1 END) * 100.0::DOUBLE / count(*), 6), 6) AS success_rate_percent
FROM processing_log WHERE {since('start_time', EVENTS_AS_OF, 20)} GROUP BY 1""")
def agg_15(t):
    return A.operations_performance(t.processing_log(), EVENTS_AS_OF, 20)


@query("agg_16", ["processing_log"], f"""
SELECT user_id, start_time::DATE AS date, count(*) AS operations, {m('processing_duration_ms')} AS avg_duration_ms FROM processing_log
WHERE processing_status = 'completed' AND {since('start_time', EVENTS_AS_OF, 20)} GROUP BY ALL""")
def agg_16(t):
    rows = t.processing_log().where((F.col("processing_status") == "completed") & recent(F.col("start_time"), EVENTS_AS_OF, 20))
    return A.daily(rows, "start_time", F.count("*").alias("operations"), mean("processing_duration_ms").alias("avg_duration_ms"), keys=("user_id",))


@query("agg_17", ["feedback"], f"""
SELECT user_id, created_at::DATE AS date, round(avg(CASE WHEN is_accurate THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM feedback
WHERE {since('created_at', EVENTS_AS_OF, 20)} GROUP BY ALL""")
def agg_17(t):
    return A.daily(t.feedback().where(recent(F.col("created_at"), EVENTS_AS_OF, 20)), "created_at", A.flag_mean("is_accurate").alias("accuracy"), keys=("user_id",))


@query("agg_18", ["leads", "quality_scores"], f"""
SELECT owner_id, count(*) AS total_assessments, {m('overall_score')} AS average_overall_score, {m('email_quality_score')} AS average_email_quality,
 {m('completeness_score')} AS average_completeness, {m('accuracy_score')} AS average_accuracy, {m('consistency_score')} AS average_consistency FROM {Q} GROUP BY 1""")
def agg_18(t):
    return A.quality_summary(t.quality_scores(), t.leads(dates=False))


@query("agg_19", ["leads", "quality_scores"], f"""
SELECT owner_id, CASE WHEN overall_score >= 85 THEN 'excellent' WHEN overall_score >= 70 THEN 'good' WHEN overall_score >= 50 THEN 'fair' ELSE 'poor' END AS quality_tier,
 count(*) AS count FROM {Q} GROUP BY ALL""")
def agg_19(t):
    rows = owned(t.quality_scores(), t.leads(dates=False))
    return A.count_by(rows, "owner_id", tiers(F.col("overall_score"), A.QUALITY_BANDS, "poor").alias("quality_tier"))


@query("agg_20", ["leads", "quality_scores"], f"""
SELECT i.owner_id, issue, count, round(count * 100.0::DOUBLE / total, 6) AS percentage FROM
 (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY count DESC, issue) AS rn FROM
  (SELECT owner_id, issue, count(*) AS count FROM (SELECT owner_id, unnest(from_json(issues_found, '["VARCHAR"]')) AS issue FROM {Q} WHERE json_valid(issues_found)) GROUP BY ALL)) i
 JOIN (SELECT owner_id, count(*) AS total FROM {Q} GROUP BY 1) s ON s.owner_id = i.owner_id WHERE rn <= 10""")
def agg_20(t):
    return A.top_issues(t.quality_scores(), t.leads(dates=False))


@query("agg_21", ["leads", "quality_scores"], f"""
SELECT owner_id, q.created_at::DATE AS date, {m('overall_score')} AS avg_quality, count(*) AS assessments FROM {Q} WHERE {since('q.created_at', AS_OF, 365)} GROUP BY ALL""")
def agg_21(t):
    rows = owned(t.quality_scores().where(recent(F.col("created_at"), AS_OF, 365)), t.leads(dates=False))
    return A.daily(rows, "created_at", mean("overall_score").alias("avg_quality"), F.count("*").alias("assessments"))


@query("agg_25", ["leads"], f"""
SELECT owner_id, count(*) AS total_leads, count(*) FILTER (WHERE status = 'converted') AS converted_leads,
 round(count(*) FILTER (WHERE status = 'converted') * 100.0::DOUBLE / count(*), 6) AS conversion_rate_percent,
 round(coalesce(avg(epoch(date_trunc('second', updated_at)) - epoch(date_trunc('second', created_at))) FILTER (WHERE status = 'converted'), 0) / 86400, 6) AS average_days_to_convert
FROM leads WHERE {since('created_at', TREND_AS_OF, 365)} GROUP BY 1""")
def agg_25(t):
    return A.conversion_rate(t.leads(), TREND_AS_OF, 365)


@query("agg_26", ["leads", "predictions"], f"""
SELECT owner_id, CASE WHEN prediction_score >= 80 THEN 'high_ai_score' WHEN prediction_score >= 60 THEN 'medium_ai_score' ELSE 'low_ai_score' END AS ai_score_tier,
 count(*) AS total_leads, count(*) FILTER (WHERE status = 'converted') AS converted, round(count(*) FILTER (WHERE status = 'converted') * 100.0::DOUBLE / count(*), 6) AS conversion_rate
FROM {P} WHERE {since('l.created_at', TREND_AS_OF, 365)} GROUP BY ALL""")
def agg_26(t):
    return A.conversion_by_score(t.leads(), t.predictions(), TREND_AS_OF, 365)


@query("agg_27", ["leads"], f"""
SELECT owner_id, source, count(*) AS total_leads, count(*) FILTER (WHERE status = 'converted') AS converted,
 round(count(*) FILTER (WHERE status = 'converted') * 100.0::DOUBLE / count(*), 6) AS conversion_rate, {m('score')} AS average_score
FROM leads WHERE {since('created_at', TREND_AS_OF, 365)} GROUP BY ALL""")
def agg_27(t):
    return A.source_performance(t.leads(), TREND_AS_OF, 365)


@query("agg_28", ["leads"], f"""
SELECT owner_id, round(coalesce(avg(epoch(date_trunc('second', updated_at)) - epoch(date_trunc('second', created_at))) FILTER (WHERE status = 'converted'), 0) / 86400, 6) AS average_days_to_convert
FROM leads WHERE {since('created_at', AS_OF, LONG)} GROUP BY 1""")
def agg_28(t):
    return A.conversion_rate(t.leads(), AS_OF, LONG).select("owner_id", "average_days_to_convert")


COMPARISON = f"""
SELECT model_name, mo.model_type, version, accuracy, u.owner_id, coalesce(predictions_made, 0) AS predictions_made, coalesce(avg_confidence, 0) AS avg_confidence,
 coalesce(avg_processing_time_ms, 0) AS avg_processing_time_ms, coalesce(user_helpfulness, 0) AS user_helpfulness, coalesce(user_accuracy, 0) AS user_accuracy,
 round(coalesce(user_accuracy, 0) * 0.4::DOUBLE + coalesce(user_helpfulness, 0) * 0.3::DOUBLE + coalesce(avg_confidence, 0) * 0.3::DOUBLE, 6) AS performance
FROM (SELECT * EXCLUDE (predictions_made) FROM models WHERE is_active) mo
LEFT JOIN (SELECT owner_id, model_type, count(*) AS predictions_made, {m('confidence')} AS avg_confidence, {m('processing_time_ms')} AS avg_processing_time_ms FROM {P} GROUP BY ALL) u
 ON split_part(model_name, '_', 1) = u.model_type
LEFT JOIN (SELECT owner_id, model_type, round(avg(CASE WHEN is_helpful THEN 1.0::DOUBLE ELSE 0 END), 6) AS user_helpfulness, round(avg(CASE WHEN is_accurate THEN 1.0::DOUBLE ELSE 0 END), 6) AS user_accuracy
 FROM feedback f JOIN predictions p ON f.prediction_id = p.id JOIN leads l ON p.lead_id = l.id GROUP BY ALL) v ON v.owner_id = u.owner_id AND v.model_type = u.model_type"""


@query("agg_29", ["leads", "predictions", "feedback", "models"], COMPARISON)
def agg_29(t):
    return A.model_comparison(t.models(), t.predictions(), t.feedback(), t.leads(dates=False))


@query("srt_5", ["leads", "predictions", "feedback", "models"], COMPARISON + " ORDER BY performance DESC, model_name")
def srt_5(t):
    return A.model_comparison(t.models(), t.predictions(), t.feedback(), t.leads(dates=False)).orderBy(F.desc("performance"), "model_name")


@query("jn_10", ["leads", "predictions", "models"], f"""
SELECT model_name, owner_id, count(*) AS predictions_made FROM {P} JOIN (SELECT model_name FROM models WHERE is_active) mo
 ON split_part(model_name, '_', 1) = p.model_type GROUP BY ALL""")
def jn_10(t):
    usage = A.count_by(owned(t.predictions(), t.leads(dates=False)), "owner_id", "model_type", name="predictions_made")
    active = t.models().where("is_active").select("model_name", F.split_part("model_name", F.lit("_"), F.lit(1)).alias("model_type"))
    return active.join(usage, "model_type").groupBy("model_name", "owner_id").agg(F.sum("predictions_made").alias("predictions_made"))


@query("agg_31", ["leads", "predictions", "quality_scores"], f"""
, s AS (SELECT owner_id, created_at::DATE AS date, count(*) AS c FROM leads WHERE {since('created_at', TREND_AS_OF, 90)} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY date DESC) AS rn FROM s),
g AS (SELECT owner_id, count(*) AS n, coalesce(sum(c) FILTER (WHERE rn <= 7), 0)::DOUBLE / 7 AS r7, coalesce(sum(c) FILTER (WHERE rn BETWEEN 8 AND 14), 0)::DOUBLE / 7 AS o7, avg(c) AS a FROM r GROUP BY 1),
h AS (SELECT owner_id, n, CASE WHEN n >= 7 THEN r7 ELSE a END AS ra, CASE WHEN n >= 14 THEN o7 WHEN n >= 7 THEN r7 ELSE a END AS oa FROM g),
k AS (SELECT owner_id, n, ra, CASE WHEN n >= 7 THEN (ra - oa) / greatest(oa, 1) ELSE 0 END AS gr FROM h),
q2 AS (SELECT owner_id, avg(overall_score) AS q FROM {Q} WHERE {since('q.created_at', TREND_AS_OF, 14)} GROUP BY 1),
c2 AS (SELECT owner_id, count(*) FILTER (WHERE status = 'converted')::DOUBLE / count(*) AS cv FROM leads WHERE {since('created_at', TREND_AS_OF, 30)} GROUP BY 1),
u2 AS (SELECT owner_id, count(*) AS u FROM {P} WHERE {since('p.created_at', TREND_AS_OF, 7)} GROUP BY 1)
SELECT k.owner_id, round(greatest(0, ra * (1 + gr) * 30), 6) AS expected_new_leads, round(greatest(0, ra * (1 + gr) * 30) * coalesce(cv, 0), 6) AS expected_conversions,
 round(coalesce(cv, 0) * 100, 6) AS predicted_conversion_rate, round(coalesce(q, 0), 6) AS expected_data_quality, round(gr * 100, 6) AS growth_rate,
 round(ra, 6) AS recent_daily_average, coalesce(u, 0) AS ai_usage_weekly, n AS data_points,
 CASE WHEN abs(gr) < 0.2 THEN 'high' WHEN abs(gr) < 0.5 THEN 'moderate' ELSE 'low' END AS trend_stability
FROM k LEFT JOIN q2 ON q2.owner_id = k.owner_id LEFT JOIN c2 ON c2.owner_id = k.owner_id LEFT JOIN u2 ON u2.owner_id = k.owner_id""")
def agg_31(t):
    return A.forecast(t.leads(), t.predictions(), t.quality_scores(), TREND_AS_OF)


@query("agg_32", ["leads", "predictions"], f"""
SELECT owner_id, count(DISTINCT lead_id) AS leads_analyzed, count(*) AS total_predictions, {m('prediction_score')} AS average_priority_score, {m('confidence')} AS average_confidence
FROM {P} WHERE {since('p.created_at', EVENTS_AS_OF, 20)} GROUP BY 1""")
def agg_32(t):
    return A.activity(t.predictions(), t.leads(dates=False), EVENTS_AS_OF, 20)


@query("agg_33", ["leads", "predictions"], f"""
SELECT owner_id, coalesce(nullif(model_type, ''), 'unknown') AS model_type, count(*) AS usage_count FROM {P} WHERE {since('p.created_at', EVENTS_AS_OF, 20)} GROUP BY ALL""")
def agg_33(t):
    rows = owned(t.predictions().where(recent(F.col("created_at"), EVENTS_AS_OF, 20)), t.leads(dates=False))
    return A.count_by(rows, "owner_id", A.known(F.col("model_type")).alias("model_type"), name="usage_count")


FEEDBACK_SQL = f"""
SELECT user_id, count(*) AS total_feedback, round(avg(rating), 6) AS average_rating, round(count(*) FILTER (WHERE is_helpful) * 100.0::DOUBLE / count(*), 6) AS helpfulness_rate,
 round(count(*) FILTER (WHERE is_accurate) * 100.0::DOUBLE / count(*), 6) AS accuracy_rate FROM feedback WHERE {since('created_at', EVENTS_AS_OF, 20)} GROUP BY 1"""


@query("agg_34", ["feedback"], FEEDBACK_SQL)
def agg_34(t):
    return A.feedback_summary(t.feedback(), EVENTS_AS_OF, 20)


@query("agg_35", ["feedback"], """
SELECT user_id, created_at::DATE AS date, CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment,
 count(*) AS feedback_count, round(avg(rating), 6) AS avg_rating FROM feedback GROUP BY GROUPING SETS ((user_id, date), (user_id, sentiment))""")
def agg_35(t):
    rows = t.feedback().select("user_id", F.to_date("created_at").alias("date"), A.sentiment(F.col("rating")).alias("sentiment"), "rating")
    sets = [[F.col("user_id"), F.col("date")], [F.col("user_id"), F.col("sentiment")]]
    return rows.groupingSets(sets, "user_id", "date", "sentiment").agg(F.count("*").alias("feedback_count"), mean("rating").alias("avg_rating"))


HEALTH_AS_OF = "2024-01-30 00:00:00"


@query("agg_36", ["models", "predictions", "processing_log"], f"""
SELECT *, CASE WHEN error_rate_percentage > 20 OR active_models = 0 THEN 'critical' WHEN error_rate_percentage > 10 OR system_load_percentage > 80 THEN 'degraded' ELSE 'healthy' END AS system_status
FROM (SELECT (SELECT count(*) FROM models WHERE is_active) AS active_models,
 (SELECT array_to_string(list_sort(list_distinct(flatten(list((CASE WHEN contains(model_name, 'priority') OR contains(model_name, 'classifier') THEN ['lead_prioritization', 'smart_scoring'] ELSE [] END)
   || (CASE WHEN contains(model_name, 'quality') THEN ['data_quality_assessment', 'automated_cleanup'] ELSE [] END)
   || (CASE WHEN contains(model_name, 'similarity') THEN ['lead_similarity', 'duplicate_detection'] ELSE [] END))))), ',') FROM models WHERE is_active) AS available_features,
 (SELECT count(*) FROM predictions WHERE {since('created_at', HEALTH_AS_OF, 1)}) AS recent_predictions,
 round(least(100, (SELECT count(*) FROM predictions WHERE {since('created_at', HEALTH_AS_OF, 1)})::DOUBLE / 1000 * 100), 6) AS system_load_percentage,
 (SELECT {m('processing_duration_ms')} FROM processing_log WHERE processing_status = 'completed' AND {since('start_time', HEALTH_AS_OF, 1)}) AS average_response_time_ms,
 (SELECT round(count(*) FILTER (WHERE processing_status = 'failed') * 100.0::DOUBLE / greatest(count(*), 1), 6) FROM processing_log WHERE {since('start_time', HEALTH_AS_OF, 1)}) AS error_rate_percentage,
 (SELECT count(*) FROM processing_log WHERE processing_status = 'started') AS pending_operations)""")
def agg_36(t):
    return A.system_health(t.models(), t.predictions(), t.processing_log(), HEALTH_AS_OF)


REPORT_SQL = f"""
SELECT owner_id, {m('overall_score')} AS overall_score, count(*) AS total_assessments, count(*) FILTER (WHERE {since('q.created_at', AS_OF, 365)} AND overall_score >= 80) AS recent_improvements,
 {m('email_quality_score')} AS email_quality, {m('completeness_score')} AS completeness, {m('accuracy_score')} AS accuracy FROM {Q} GROUP BY 1"""


@query("agg_37", ["leads", "quality_scores"], REPORT_SQL)
def agg_37(t):
    return A.quality_report(t.quality_scores(), t.leads(dates=False), AS_OF, 365)


@query("agg_39", ["leads", "insights"], f"""
, b AS (SELECT owner_id, coalesce(priority_level, 'unknown') AS level, count(*) AS n, sum(impact_score) AS s FROM {I} GROUP BY ALL)
SELECT owner_id, sum(n)::BIGINT AS total_insights, coalesce(sum(n) FILTER (WHERE level = 'critical'), 0)::BIGINT AS n_critical, coalesce(sum(n) FILTER (WHERE level = 'high'), 0)::BIGINT AS n_high,
 coalesce(sum(n) FILTER (WHERE level = 'medium'), 0)::BIGINT AS n_medium, coalesce(sum(n) FILTER (WHERE level = 'low'), 0)::BIGINT AS n_low,
 coalesce(sum(n) FILTER (WHERE level = 'unknown'), 0)::BIGINT AS n_unknown, round(sum(s) / sum(n), 6) AS average_impact_score,
 (SELECT level FROM b b2 WHERE b2.owner_id = b.owner_id ORDER BY n DESC, level LIMIT 1) AS top_priority FROM b GROUP BY owner_id""")
def agg_39(t):
    return A.insight_summary(t.insights(), t.leads(dates=False))


@query("agg_54", ["leads", "quality_scores", "feedback"], f"""
SELECT 'quality' AS report, owner_id AS subject, array_to_string(list_filter([
  CASE WHEN overall_score < 70 THEN 'Overall data quality needs improvement - consider data cleanup' END,
  CASE WHEN email_quality < 60 THEN 'Email quality is low - validate and enrich email addresses' END,
  CASE WHEN completeness < 70 THEN 'Data completeness is low - fill in missing lead information' END,
  CASE WHEN overall_score >= 70 AND email_quality >= 60 AND completeness >= 70 THEN 'Great job! Your data quality is excellent.' END], lambda x: x IS NOT NULL), ' | ') AS message
FROM ({REPORT_SQL})
UNION ALL SELECT 'conversion', owner_id, CASE WHEN r > 15 THEN 'Excellent conversion rate - consider scaling successful strategies' WHEN r < 5 THEN 'Low conversion rate detected - review lead qualification criteria' ELSE '' END
FROM (SELECT owner_id, count(*) FILTER (WHERE status = 'converted') * 100.0 / count(*) AS r FROM leads WHERE {since('created_at', TREND_AS_OF, 365)} GROUP BY 1)
UNION ALL SELECT 'feedback', user_id, CASE WHEN helpfulness_rate > 80 AND accuracy_rate > 80 THEN 'Excellent! Your feedback shows our AI is performing very well for you.'
 WHEN helpfulness_rate > 60 THEN 'Good feedback! We''re continuously improving based on your input.'
 ELSE 'Thank you for your feedback. We''re working to improve AI performance based on your suggestions.' END FROM ({FEEDBACK_SQL})""")
def agg_54(t):
    leads = t.leads(dates=False)
    quality = A.quality_report(t.quality_scores(), leads, AS_OF, 365).select(
        F.lit("quality").alias("report"), F.col("owner_id").alias("subject"), A.quality_recommendations().alias("message"))
    conv = A.conversion_rate(t.leads(), TREND_AS_OF, 365).select(F.lit("conversion").alias("report"), F.col("owner_id").alias("subject"), A.conversion_insights().alias("message"))
    fb = A.feedback_summary(t.feedback(), EVENTS_AS_OF, 20).select(F.lit("feedback").alias("report"), F.col("user_id").alias("subject"), A.feedback_impact().alias("message"))
    return quality.unionByName(conv).unionByName(fb)
