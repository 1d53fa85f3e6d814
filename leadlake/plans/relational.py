"""Registered filters, joins, rankings, sorts and set operators (PRD, JN, WIN, SRT, SET and score statistics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import present, recent, say, compact
from ..functions.record import normalize, with_company
from ..operators import aggregates as A
from ..operators import ranking as W
from ..operators import tables as T
from ..operators.aggregates import owned
from ..sources.bindings import EVENTS_AS_OF
from .registry import query
from .reports import P, Q, TREND_AS_OF, I, m, since

BASIC = ["id", "first_name", "last_name", "email", "status", "score"]


@query("prd_1", ["leads"], "SELECT owner_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM leads GROUP BY 1")
def prd_1(t):
    return t.leads(dates=False).groupBy("owner_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("prd_2", ["leads"], "SELECT id, status FROM leads WHERE status = 'converted'")
def prd_2(t):
    return T.where_equals(t.leads(dates=False), status="converted", source="").select("id", "status")


@query("prd_3", ["leads"], "SELECT id, score FROM leads WHERE score >= 70.0")
def prd_3(t):
    return T.min_score(t.leads(dates=False), 70.0).select("id", "score")


@query("prd_4", ["leads"], "SELECT id, email FROM leads WHERE email IS NOT NULL AND email <> ''")
def prd_4(t):
    return t.leads(dates=False).where(present(F.col("email"))).select("id", "email")


@query("prd_5", ["leads"], "SELECT id, status FROM leads WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def prd_5(t):
    wanted = t.raw("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return t.leads(dates=False).select("id", "status").join(wanted, "id", "left_semi")


@query("prd_6", ["predictions"], f"SELECT id, lead_id, created_at FROM predictions WHERE {since('created_at', EVENTS_AS_OF, 7)}")
def prd_6(t):
    return t.predictions().where(recent(F.col("created_at"), EVENTS_AS_OF, 7)).select("id", "lead_id", "created_at")


@query("prd_7", ["leads"], "SELECT id, owner_id FROM leads WHERE id <> 10")
def prd_7(t):
    return t.leads(dates=False).where(F.col("id") != 10).select("id", "owner_id")


@query("prd_8", ["feedback", "predictions", "models"], """
SELECT f.id, f.prediction_id, p.model_type, (SELECT min(model_name) FROM models WHERE is_active AND contains(model_name, p.model_type)) AS model_name
FROM feedback f JOIN predictions p ON f.prediction_id = p.id WHERE EXISTS (SELECT 1 FROM models WHERE is_active AND contains(model_name, p.model_type))""")
def prd_8(t):
    return T.feedback_models(t.feedback(), t.predictions(), t.models())


@query("prd_9", ["models", "insights"], "SELECT 'model' AS kind, id FROM models WHERE is_active UNION ALL SELECT 'insight', id FROM insights WHERE status = 'active'")
def prd_9(t):
    return t.models().where("is_active").select(F.lit("model").alias("kind"), "id").unionByName(
        t.insights().where("status = 'active'").select(F.lit("insight").alias("kind"), "id"))


@query("prd_10", ["leads", "predictions", "insights"], """
SELECT l.id, EXISTS (SELECT 1 FROM insights i WHERE i.lead_id = l.id AND i.status = 'active' AND i.insight_type = 'priority')
 AND coalesce((SELECT max(created_at) FROM predictions p WHERE p.lead_id = l.id) > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY, false) AS cached FROM leads l""")
def prd_10(t):
    return T.cached_split(t.leads(dates=False), t.predictions(), t.insights(), "2024-01-30 00:00:00")


@query("prd_11", ["leads", "companies"], """
SELECT l.id, coalesce(first_name, '') AS first_name, coalesce(email, '') AS email, coalesce(title, '') AS title, coalesce(source, '') AS source, coalesce(score, 0) AS score,
 coalesce(c.name, '') AS company_name, coalesce(c.industry, '') AS company_industry FROM leads l LEFT JOIN companies c ON l.company_id = c.id""")
def prd_11(t):
    rows = normalize(with_company(t.leads(dates=False), t.companies()))
    return rows.select("id", "first_name", "email", "title", "source", "score", F.col("company.name").alias("company_name"), F.col("company.industry").alias("company_industry"))


@query("prd_12", ["leads"], "SELECT id, CASE WHEN source IS NULL OR source = '' THEN 'unknown' ELSE source END AS source FROM leads")
def prd_12(t):
    return t.leads(dates=False).select("id", A.known(F.col("source")).alias("source"))


@query("prd_13", ["quality_scores"], """
SELECT id, array_to_string(list_filter([CASE WHEN NOT overall_score BETWEEN 0 AND 90 THEN 'overall_score' END, CASE WHEN NOT email_quality_score BETWEEN 0 AND 100 THEN 'email_quality_score' END,
 CASE WHEN NOT accuracy_score BETWEEN 0 AND 98 THEN 'accuracy_score' END, CASE WHEN NOT contains(issues_found, 'flag') THEN 'issues_found' END], lambda x: x IS NOT NULL), ',') AS reasons,
 overall_score BETWEEN 0 AND 90 AND email_quality_score BETWEEN 0 AND 100 AND accuracy_score BETWEEN 0 AND 98 AND coalesce(contains(issues_found, 'flag'), true) AS valid FROM quality_scores""")
def prd_13(t):
    rules = {"overall_score": F.col("overall_score").between(0, 90), "email_quality_score": F.col("email_quality_score").between(0, 100),
             "accuracy_score": F.col("accuracy_score").between(0, 98), "issues_found": F.col("issues_found").rlike("flag")}
    return T.validate_rows(t.quality_scores(), rules).select("id", F.array_join("reasons", ",").alias("reasons"), "valid")


@query("prd_14", ["leads", "companies"], """
SELECT item, count(*) AS n FROM (SELECT unnest([CASE WHEN coalesce(first_name, '') = '' THEN 'issue: missing first_name' END, CASE WHEN coalesce(last_name, '') = '' THEN 'issue: missing last_name' END,
 CASE WHEN coalesce(email, '') = '' THEN 'issue: missing email' END, CASE WHEN coalesce(title, '') = '' THEN 'issue: missing title' END,
 CASE WHEN email <> '' AND NOT contains(email, '@') THEN 'issue: invalid email' END,
 CASE WHEN l.phone <> '' AND length(regexp_replace(l.phone, '[\\s()+-]', '', 'g')) < 10 THEN 'warning: short phone' END,
 CASE WHEN coalesce(c.name, '') = '' THEN 'issue: missing company name' END, CASE WHEN NOT score BETWEEN 0 AND 100 THEN 'issue: score out of range' END]) AS item
 FROM leads l LEFT JOIN companies c ON l.company_id = c.id) WHERE item IS NOT NULL GROUP BY 1""")
def prd_14(t):
    return T.validation_summary(with_company(t.leads(dates=False), t.companies()))


@query("prd_16", [], """
SELECT event_id, value, position FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS position, count(*) OVER () AS n FROM events)
WHERE (position - 1) % greatest(1, ceil(n / 100.0))::BIGINT = 0""")
def prd_16(t):
    return W.downsample(t.raw("events").select("event_id", "value"), ["event_id"], 100)


@query("prd_17", ["leads", "predictions"], f"""
SELECT l.owner_id, coalesce(a.total, 0) AS total_analyzed, coalesce(a.s, 0) AS avg_priority, coalesce(a.c, 0) AS avg_confidence
FROM (SELECT DISTINCT owner_id FROM leads) l LEFT JOIN (SELECT owner_id, count(*) AS total, {m('prediction_score')} AS s, {m('confidence')} AS c FROM {P}
 WHERE {since('p.created_at', EVENTS_AS_OF, 2)} GROUP BY 1) a ON a.owner_id = l.owner_id""")
def prd_17(t):
    leads = t.leads(dates=False)
    a = A.activity(t.predictions(), leads, EVENTS_AS_OF, 2)
    return leads.select("owner_id").distinct().join(a, "owner_id", "left").select(
        "owner_id", F.coalesce("total_predictions", F.lit(0)).alias("total_analyzed"),
        F.coalesce("average_priority_score", F.lit(0.0)).alias("avg_priority"), F.coalesce("average_confidence", F.lit(0.0)).alias("avg_confidence"))


# ---- joins ------------------------------------------------------------------------------------------------------


@query("jn_1", ["leads", "predictions"], f"SELECT p.id, p.lead_id, owner_id, prediction_score FROM {P}")
def jn_1(t):
    return owned(t.predictions(), t.leads(dates=False)).select("id", "lead_id", "owner_id", "prediction_score")


@query("jn_2", ["leads", "campaigns"], "SELECT c.id, c.name, count(l.id) AS leads_count FROM campaigns c LEFT JOIN leads l ON l.campaign_id = c.id GROUP BY 1, 2")
def jn_2(t):
    return A.campaign_lead_counts(t.campaigns().select("id", "name"), t.leads(dates=False))


@query("jn_3", ["leads", "companies"], "SELECT l.id, l.company_id, c.name AS company_name, c.size AS company_size FROM leads l LEFT JOIN companies c ON l.company_id = c.id")
def jn_3(t):
    rows = with_company(t.leads(dates=False), t.companies())
    return rows.select("id", "company_id", F.col("company.name").alias("company_name"), F.col("company.size").alias("company_size"))


@query("jn_4", ["leads", "predictions"], "SELECT id, status FROM leads WHERE id NOT IN (SELECT lead_id FROM predictions)")
def jn_4(t):
    return t.leads(dates=False).join(t.predictions().select("lead_id"), F.col("id") == F.col("lead_id"), "left_anti").select("id", "status")


@query("jn_6", ["leads", "predictions", "feedback"], """
SELECT owner_id, model_type, count(*) AS n, round(avg(CASE WHEN is_helpful THEN 1.0::DOUBLE ELSE 0 END), 6) AS helpfulness, round(avg(CASE WHEN is_accurate THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
FROM feedback f JOIN predictions p ON f.prediction_id = p.id JOIN leads l ON p.lead_id = l.id GROUP BY ALL""")
def jn_6(t):
    p = owned(t.predictions(), t.leads(dates=False)).select(F.col("id").alias("prediction_id"), "owner_id", "model_type")
    return t.feedback().join(p, "prediction_id").groupBy("owner_id", "model_type").agg(
        F.count("*").alias("n"), A.flag_mean("is_helpful").alias("helpfulness"), A.flag_mean("is_accurate").alias("accuracy"))


@query("jn_8", ["leads", "predictions", "quality_scores"], """
SELECT l.id, p.prediction_score, p.confidence, q.overall_score FROM leads l
LEFT JOIN (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) = 1) p ON p.lead_id = l.id
LEFT JOIN (SELECT * FROM quality_scores QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) = 1) q ON q.lead_id = l.id""")
def jn_8(t):
    p = A.latest_by(t.predictions().select("id", "lead_id", "created_at", "prediction_score", "confidence"), "lead_id", "created_at", "id").select("lead_id", "prediction_score", "confidence")
    q = A.latest_by(t.quality_scores().select("id", "lead_id", "created_at", "overall_score"), "lead_id", "created_at", "id").select("lead_id", "overall_score")
    leads = t.leads(dates=False).select("id", F.col("id").alias("lead_id"))
    return leads.join(p, "lead_id", "left").join(q, "lead_id", "left").drop("lead_id")


@query("jn_9", ["leads", "campaigns"], "SELECT c.id, c.status, coalesce(n, 0) AS leads_count FROM campaigns c LEFT JOIN (SELECT campaign_id, count(*) AS n FROM leads GROUP BY 1) ON campaign_id = c.id")
def jn_9(t):
    return A.campaign_lead_counts(t.campaigns().select("id", "status"), t.leads(dates=False))


@query("jn_14", ["companies"], """
SELECT s_suppkey AS row_id, coalesce(c.id, n.new_id) AS company_id FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'acme.com' ELSE 'sup' || (s_suppkey % 17) || '.com' END AS domain FROM supplier) s
LEFT JOIN (SELECT domain, min(id) AS id FROM companies WHERE domain <> '' GROUP BY 1) c ON c.domain = s.domain
LEFT JOIN (SELECT domain, 1000000 + row AS new_id FROM (SELECT 'sup' || (s_suppkey % 17) || '.com' AS domain, min(s_suppkey) AS row FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1)) n ON n.domain = s.domain""")
def jn_14(t):
    incoming = t.raw("supplier").selectExpr("s_suppkey AS row_id", "CASE WHEN s_suppkey % 3 = 0 THEN 'acme.com' ELSE 'sup' || (s_suppkey % 17) || '.com' END AS domain")
    known = t.companies().where(present(F.col("domain"))).groupBy("domain").agg(F.min("id").alias("company_id"))
    fresh = incoming.join(known, "domain", "left_anti").groupBy("domain").agg((F.min("row_id") + 1000000).alias("company_id"))
    return incoming.join(known.unionByName(fresh), "domain").select("row_id", "company_id")


@query("jn_16", ["leads", "companies"], """
, f AS (SELECT domain, max(size) AS size, max(revenue) AS revenue, max(technologies) FILTER (WHERE technologies <> '[]') AS technologies, 'https://linkedin.com/in/found' AS linkedin_url FROM companies WHERE domain <> '' GROUP BY 1)
SELECT l.id, CASE WHEN coalesce(c.size, '') = '' AND f.size <> '' THEN f.size ELSE c.size END AS size, CASE WHEN coalesce(c.revenue, '') = '' AND f.revenue <> '' THEN f.revenue ELSE c.revenue END AS revenue,
 CASE WHEN f.technologies <> '' THEN f.technologies ELSE c.technologies END AS technologies, CASE WHEN coalesce(l.linkedin_url, '') = '' AND f.linkedin_url <> '' THEN f.linkedin_url ELSE l.linkedin_url END AS linkedin_url,
 array_to_string(list_filter([CASE WHEN coalesce(c.size, '') = '' AND f.size <> '' THEN 'company_size' END, CASE WHEN coalesce(c.revenue, '') = '' AND f.revenue <> '' THEN 'company_revenue' END,
  CASE WHEN f.technologies <> '' THEN 'technologies' END, CASE WHEN coalesce(l.linkedin_url, '') = '' AND f.linkedin_url <> '' THEN 'linkedin_url' END], lambda x: x IS NOT NULL), ',') AS enriched_fields
FROM leads l JOIN companies c ON l.company_id = c.id LEFT JOIN f ON f.domain = c.domain""")
def jn_16(t):
    c = t.companies().select(F.col("id").alias("company_id"), "domain", "size", "revenue", "technologies")
    rows = t.leads(dates=False).select("id", "company_id", "linkedin_url").join(c, "company_id")
    found = t.companies().where("domain <> ''").groupBy("domain").agg(
        F.max("size").alias("size"), F.max("revenue").alias("revenue"), F.max(F.when(F.col("technologies") != "[]", F.col("technologies"))).alias("technologies"), F.lit("https://linkedin.com/in/found").alias("linkedin_url"))
    return T.enrich(rows, found).withColumn("enriched_fields", F.array_join("enriched_fields", ","))


@query("jn_17", ["leads"], """
, p AS (SELECT id, email, row_number() OVER (ORDER BY id) AS position FROM leads)
SELECT a.id AS lead1_id, b.id AS lead2_id FROM p a JOIN p b ON b.position = a.position + 1 WHERE a.position % 2 = 1""")
def jn_17(t):
    rows = W.number_rows(t.leads(dates=False).select("id"), ["id"]).drop("_total")
    return T.adjacent_pairs(rows).select(F.col("a.id").alias("lead1_id"), F.col("b.id").alias("lead2_id"))


@query("jn_18", ["leads", "companies"], """
, k AS (SELECT c.domain, lower(first_name) AS kf, lower(last_name) AS kl, email, l.id AS ord FROM leads l JOIN companies c ON l.company_id = c.id WHERE contains(email, '@') AND c.domain <> ''
  AND first_name <> '' AND last_name <> ''),
c0 AS (SELECT l.id, c.domain, lower(first_name) AS cf, lower(last_name) AS cl FROM leads l JOIN companies c ON l.company_id = c.id WHERE NOT coalesce(contains(email, '@'), false) AND c.domain <> ''
  AND first_name <> '' AND last_name <> '')
SELECT id, c0.domain, arg_min(email, ord) AS matched_email, min(ord) AS matched_ord FROM c0 JOIN k ON k.domain = c0.domain AND contains(kf, cf) AND contains(kl, cl) GROUP BY 1, 2""")
def jn_18(t):
    c = t.companies().where("domain <> ''").select(F.col("id").alias("company_id"), "domain")
    rows = t.leads(dates=False).where(present(F.col("first_name")) & present(F.col("last_name"))).join(c, "company_id")
    has = F.coalesce(F.col("email").contains("@"), F.lit(False))
    return T.match_known_people(rows.where(~has), rows.where(has).withColumn("ord", F.col("id")))


# ---- windows ----------------------------------------------------------------------------------------------------


@query("win_1", ["predictions"], "SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) = 1")
def win_1(t):
    return A.latest_by(t.predictions(), "lead_id", "created_at", "id")


@query("win_2", ["predictions", "insights"], """
SELECT 'prediction' AS kind, lead_id, id, rn FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) AS rn FROM predictions) WHERE rn <= 5
UNION ALL SELECT 'insight', lead_id, id, rn FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) AS rn FROM insights WHERE status = 'active') WHERE rn <= 3""")
def win_2(t):
    order = [F.desc("created_at"), F.desc("id")]
    p = W.top_per_key(t.predictions(), ["lead_id"], order, 5).select(F.lit("prediction").alias("kind"), "lead_id", "id", F.col("rn").cast("bigint").alias("rn"))
    i = W.top_per_key(t.insights().where("status = 'active'"), ["lead_id"], order, 3).select(F.lit("insight").alias("kind"), "lead_id", "id", F.col("rn").cast("bigint").alias("rn"))
    return p.unionByName(i)


RANK = "SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS batch_rank, round((1 - (row_number() OVER (ORDER BY score DESC, id) - 1)::DOUBLE / count(*) OVER ()) * 100, 1) AS percentile FROM leads"


@query("win_3", ["leads"], RANK)
def win_3(t):
    return W.batch_rank(t.leads(dates=False).select("id", "score"))


PICKS = ", ".join(f"s[floor(n * {p}::DOUBLE)::INT + 1] AS {k}" for k, p in W.PERCENTILES.items())


@query("win_4", ["leads"], f"SELECT owner_id, n, s[floor(n / 2)::INT + 1] AS median_score, {PICKS} FROM (SELECT owner_id, list_sort(list(score)) AS s, count(score) AS n FROM leads GROUP BY 1)")
def win_4(t):
    return W.index_percentiles(t.leads(dates=False), "score", ["owner_id"])


@query("win_5", ["leads"], f"""
, s AS (SELECT owner_id, created_at::DATE AS date, count(*) AS c FROM leads WHERE {since('created_at', TREND_AS_OF, 90)} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY date DESC) AS rn FROM s),
g AS (SELECT owner_id, count(*) AS n, coalesce(sum(c) FILTER (WHERE rn <= 7), 0)::DOUBLE / 7 AS r7, coalesce(sum(c) FILTER (WHERE rn BETWEEN 8 AND 14), 0)::DOUBLE / 7 AS o7, avg(c) AS a FROM r GROUP BY 1)
SELECT owner_id, n AS data_points, round(CASE WHEN n >= 7 THEN r7 ELSE a END, 6) AS recent_avg, round(CASE WHEN n >= 14 THEN o7 WHEN n >= 7 THEN r7 ELSE a END, 6) AS older_avg FROM g""")
def win_5(t):
    series = A.daily(t.leads().where(recent(F.col("created_at"), TREND_AS_OF, 90)), "created_at", F.count("*").alias("count"))
    return A.trailing_means(series).select("owner_id", "data_points", A.r6(F.col("recent_avg")).alias("recent_avg"), A.r6(F.col("older_avg")).alias("older_avg"))


@query("win_6", ["leads"], "SELECT id, score, rank() OVER (ORDER BY score) - 1 AS better_count, count(*) OVER () AS comparison_count, round((rank() OVER (ORDER BY score) - 1) * 100.0::DOUBLE / count(*) OVER (), 6) AS percentile_rank FROM leads")
def win_6(t):
    return W.percent_below(t.leads(dates=False).select("id", "score"))


@query("win_7", ["runs"], "SELECT run_id, purpose, accuracy FROM runs QUALIFY row_number() OVER (PARTITION BY purpose ORDER BY run_id DESC) <= 100")
def win_7(t):
    return W.keep_latest(t.runs().select("run_id", "purpose", "accuracy"), "purpose", "run_id", 100)


DECLINE = """
, r AS (SELECT *, row_number() OVER (PARTITION BY purpose ORDER BY run_id DESC) AS rn FROM runs QUALIFY rn <= 5),
g AS (SELECT purpose, count(*) AS runs, arg_min(accuracy, rn) AS la, arg_min(f1_score, rn) AS lf, arg_min(r2_score, rn) AS lr, arg_min(mae, rn) AS lm, arg_min(auc, rn) AS lu, arg_max(accuracy, rn) AS fa, arg_max(r2_score, rn) AS fr FROM r GROUP BY 1)
SELECT *, reasons <> '' AS retrain FROM (SELECT purpose, runs, array_to_string(list_filter([CASE WHEN purpose = 'priority' AND la < 0.8 THEN 'accuracy below threshold' END, CASE WHEN purpose = 'priority' AND lf < 0.75 THEN 'f1_score below threshold' END,
 CASE WHEN purpose = 'quality' AND lr < 0.7 THEN 'r2_score below threshold' END, CASE WHEN purpose = 'quality' AND lm > 15 THEN 'mae above threshold' END,
 CASE WHEN purpose = 'conversion' AND la < 0.75 THEN 'accuracy below threshold' END, CASE WHEN purpose = 'conversion' AND lu < 0.8 THEN 'auc below threshold' END,
 CASE WHEN runs >= 5 AND CASE WHEN purpose = 'quality' THEN lr < fr * 0.9 ELSE la < fa * 0.9 END THEN 'declining performance' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM g)"""


@query("win_8", ["runs"], DECLINE)
def win_8(t):
    return W.decline_check(t.runs())


@query("ml_18", ["runs"], DECLINE)
def ml_18(t):
    return W.decline_check(t.runs())


@query("win_9", ["runs"], """
, r AS (SELECT *, row_number() OVER (PARTITION BY purpose ORDER BY run_id DESC) AS rn FROM runs QUALIFY rn <= 10),
u AS (UNPIVOT (SELECT purpose, rn, accuracy, f1_score, mae FROM r) ON accuracy, f1_score, mae INTO NAME metric VALUE value),
g AS (SELECT purpose, metric, round(avg(value), 6) AS average, avg(value) FILTER (WHERE rn <= 5) AS a, avg(value) FILTER (WHERE rn > 5) AS b FROM u GROUP BY ALL),
h AS (SELECT *, CASE WHEN b <> 0 THEN (a - b) / abs(b) * 100 ELSE 0 END AS ch FROM g)
SELECT purpose, metric, average, round(ch, 6) AS change_percent, CASE WHEN b IS NULL THEN 'insufficient_data' WHEN CASE WHEN metric = 'mae' THEN -ch ELSE ch END > 0 THEN 'improving'
 WHEN CASE WHEN metric = 'mae' THEN -ch ELSE ch END < 0 THEN 'declining' ELSE 'stable' END AS trend FROM h""")
def win_9(t):
    return W.performance_trend(t.runs(), ["accuracy", "f1_score", "mae"])


@query("win_10", ["models"], """
SELECT purpose, id, model_name, metric FROM (SELECT *, CASE WHEN purpose = 'quality' THEN r2_score ELSE f1_score END AS metric FROM models WHERE is_active)
QUALIFY row_number() OVER (PARTITION BY purpose ORDER BY metric DESC, id) = 1""")
def win_10(t):
    return W.best_model(t.models())


@query("win_11", ["quality_scores"], """
SELECT *, CASE WHEN previous_score IS NULL THEN NULL WHEN overall_score - previous_score > 2 THEN 'improving' WHEN overall_score - previous_score < -2 THEN 'declining' ELSE 'stable' END AS quality_trend
FROM (SELECT id, lead_id, overall_score, created_at, lag(overall_score) OVER (PARTITION BY lead_id ORDER BY created_at, id) AS previous_score FROM quality_scores)""")
def win_11(t):
    return W.quality_trend(t.quality_scores())


@query("win_12", ["leads"], "SELECT id, row_number() OVER (ORDER BY id) - 1 AS batch_position FROM leads")
def win_12(t):
    return W.number_rows(t.leads(dates=False).select("id"), ["id"]).select("id", (F.col("position") - 1).alias("batch_position"))


# ---- sorts ------------------------------------------------------------------------------------------------------


@query("srt_1", ["leads"], "SELECT id, first_name, last_name, email, status, score FROM leads ORDER BY id LIMIT 100 OFFSET 50")
def srt_1(t):
    return t.leads(dates=False).select(*BASIC).orderBy("id").offset(50).limit(100)


@query("srt_2", ["processing_log"], "SELECT start_time::DATE AS date, count(*) AS operations FROM processing_log GROUP BY 1 ORDER BY 1")
def srt_2(t):
    return A.daily(t.processing_log(), "start_time", F.count("*").alias("operations"), keys=()).orderBy("date")


@query("srt_3", ["insights"], "SELECT id, lead_id, priority_level, created_at FROM insights WHERE status = 'active' ORDER BY priority_level DESC NULLS LAST, created_at DESC, id LIMIT 50")
def srt_3(t):
    return t.insights().where("status = 'active'").select("id", "lead_id", "priority_level", "created_at").orderBy(
        F.desc_nulls_last("priority_level"), F.desc("created_at"), "id").limit(50)


@query("srt_4", ["leads", "insights"], f"""
SELECT owner_id, i.id, insight_text FROM {I} WHERE priority_level IN ('high', 'critical') AND i.status = 'active' QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY i.created_at DESC, i.id) <= 5""")
def srt_4(t):
    rows = owned(t.insights().where((F.col("status") == "active") & F.col("priority_level").isin("high", "critical")), t.leads(dates=False))
    return W.top_per_key(rows, ["owner_id"], [F.desc("created_at"), F.col("id")], 5).select("owner_id", "id", "insight_text")


@query("srt_6", ["models"], "SELECT id, model_name, accuracy FROM models WHERE is_active ORDER BY accuracy DESC NULLS LAST, id")
def srt_6(t):
    return t.models().where("is_active").select("id", "model_name", "accuracy").orderBy(F.desc_nulls_last("accuracy"), "id")


# ---- sets -------------------------------------------------------------------------------------------------------


@query("set_1", ["quality_scores"], """
SELECT DISTINCT unnest(from_json(issues_found, '["VARCHAR"]')) AS issue FROM quality_scores WHERE json_valid(issues_found)""")
def set_1(t):
    return t.quality_scores().select(F.explode(F.from_json("issues_found", "array<string>")).alias("issue")).distinct()


@query("set_2", ["leads", "companies"], """
, u AS (SELECT c.domain, l.email, 1 AS src, l.id AS ord FROM leads l JOIN companies c ON l.company_id = c.id WHERE contains(l.email, '@') AND c.domain <> ''
 UNION ALL SELECT c.domain, lower(l.email), 2, l.id FROM leads l JOIN companies c ON l.company_id = c.id WHERE contains(l.email, '@') AND c.domain <> ''),
d AS (SELECT domain, email, min(src) AS src, arg_min(ord, src * 1000000000 + ord) AS ord FROM u GROUP BY 1, 2)
SELECT domain, email, src, ord FROM d QUALIFY row_number() OVER (PARTITION BY domain ORDER BY src, ord, email) <= 50""")
def set_2(t):
    c = t.companies().where("domain <> ''").select(F.col("id").alias("company_id"), "domain")
    rows = t.leads(dates=False).where(F.col("email").contains("@")).join(c, "company_id")
    a = rows.select("domain", "email", F.lit(1).alias("src"), F.col("id").alias("ord"))
    b = rows.select("domain", F.lower("email").alias("email"), F.lit(2).alias("src"), F.col("id").alias("ord"))
    first = a.unionByName(b).groupBy("domain", "email").agg(F.min(F.struct("src", "ord")).alias("f")).select("domain", "email", "f.src", "f.ord")
    return W.top_per_key(first, ["domain"], [F.col("src"), F.col("ord"), F.col("email")], 50).drop("rn")


@query("set_4", ["leads"], """
, w AS (SELECT id, list_distinct(list_filter(string_split_regex(trim(lower(coalesce(title, ''))), '\\s+'), lambda x: x <> '')) AS t FROM leads)
SELECT a.id AS lead1_id, b.id AS lead2_id, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t)) END, 6) AS jaccard
FROM w a JOIN w b ON b.id = a.id + 1""")
def set_4(t):
    words = F.filter(F.array_distinct(F.split(F.trim(F.lower(F.coalesce("title", F.lit("")))), r"\s+")), lambda x: x != "")
    w = t.leads(dates=False).select("id", words.alias("t"))
    b = w.select((F.col("id") - 1).alias("id"), F.col("id").alias("lead2_id"), F.col("t").alias("u"))
    j = F.when((F.size("t") == 0) | (F.size("u") == 0), 0.0).otherwise(F.size(F.array_intersect("t", "u")) / F.size(F.array_union("t", "u")))
    return w.join(b, "id").select(F.col("id").alias("lead1_id"), "lead2_id", F.round(j, 6).alias("jaccard"))


@query("set_5", ["leads", "predictions"], """
SELECT owner_id, id IN (SELECT lead_id FROM predictions) AS has_ai, count(*) AS total, count(*) FILTER (WHERE status = 'converted') AS converted FROM leads GROUP BY ALL""")
def set_5(t):
    leads, p = t.leads(dates=False), t.predictions().select("lead_id")
    on = F.col("id") == F.col("lead_id")
    both = leads.join(p, on, "left_semi").withColumn("has_ai", F.lit(True)).unionByName(leads.join(p, on, "left_anti").withColumn("has_ai", F.lit(False)))
    return both.groupBy("owner_id", "has_ai").agg(F.count("*").alias("total"), A.n_if(A.converted()).alias("converted"))


# ---- score statistics -------------------------------------------------------------------------------------------

STATS = f"""
, b AS (SELECT count(score) AS total_leads, round(avg(score), 6) AS average_score, min(score) AS min_score, max(score) AS max_score, round(stddev_samp(score), 6) AS standard_deviation,
 count(*) FILTER (WHERE score >= 90) AS exceptional, count(*) FILTER (WHERE score >= 80 AND score < 90) AS excellent, count(*) FILTER (WHERE score >= 70 AND score < 80) AS high,
 count(*) FILTER (WHERE score >= 55 AND score < 70) AS medium, count(*) FILTER (WHERE score >= 40 AND score < 55) AS low, count(*) FILTER (WHERE score < 40) AS poor, list_sort(list(score)) AS s, count(score) AS n FROM leads),
c AS (SELECT * EXCLUDE (s, n), s[floor(n / 2)::INT + 1] AS median_score, {PICKS}, (exceptional + excellent) * 100.0::DOUBLE / n AS rate FROM b)
SELECT * EXCLUDE (rate), round(rate, 6) AS excellent_rate, round(rate + high * 100.0::DOUBLE / total_leads, 6) AS high_quality_rate,
 CASE WHEN rate >= 30 AND average_score >= 80 THEN 'Exceptional' WHEN rate >= 20 AND average_score >= 75 THEN 'Excellent' WHEN rate >= 10 AND average_score >= 65 THEN 'High' WHEN average_score >= 55 THEN 'Medium' ELSE 'Low' END AS overall_quality,
 array_to_string(list_filter([CASE WHEN poor * 100.0 / total_leads > 20 THEN 'High percentage of poor quality leads - review data sources' END, CASE WHEN low * 100.0 / total_leads > 30 THEN 'Consider data enrichment to improve lead quality' END,
  CASE WHEN average_score < 60 THEN 'Overall lead quality below average - implement qualification criteria' END, CASE WHEN rate < 10 THEN 'Low percentage of excellent leads - refine targeting criteria' END], lambda x: x IS NOT NULL), ' | ') AS improvement_opportunities,
 round(average_score - 65, 6) AS performance_vs_benchmark FROM c"""


@query("agg_42", ["leads"], STATS)
def agg_42(t):
    return W.score_statistics(t.leads(dates=False))


@query("agg_43", ["leads"], "SELECT overall_quality FROM (SELECT CASE WHEN rate >= 30 AND a >= 80 THEN 'Exceptional' WHEN rate >= 20 AND a >= 75 THEN 'Excellent' WHEN rate >= 10 AND a >= 65 THEN 'High' WHEN a >= 55 THEN 'Medium' ELSE 'Low' END AS overall_quality FROM (SELECT avg(score) AS a, count(*) FILTER (WHERE score >= 80) * 100.0 / count(score) AS rate FROM leads))")
def agg_43(t):
    return W.score_statistics(t.leads(dates=False)).select("overall_quality")


@query("agg_44", ["leads"], """
SELECT unnest(list_filter([CASE WHEN p > 20 THEN 'High percentage of poor quality leads - review data sources' END, CASE WHEN w > 30 THEN 'Consider data enrichment to improve lead quality' END,
 CASE WHEN a < 60 THEN 'Overall lead quality below average - implement qualification criteria' END, CASE WHEN e < 10 THEN 'Low percentage of excellent leads - refine targeting criteria' END], lambda x: x IS NOT NULL)) AS opportunity
FROM (SELECT avg(score) AS a, count(*) FILTER (WHERE score < 40) * 100.0 / count(score) AS p, count(*) FILTER (WHERE score >= 40 AND score < 55) * 100.0 / count(score) AS w, count(*) FILTER (WHERE score >= 80) * 100.0 / count(score) AS e FROM leads)""")
def agg_44(t):
    stats = W.score_statistics(t.leads(dates=False))
    return stats.select(F.explode(F.filter(F.split("improvement_opportunities", r" \| "), lambda x: x != "")).alias("opportunity"))
