"""Registered sources, sinks, helpers and streams (SRC, SNK, FN, STR and the remaining AGG, SET, SRT rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import emails as M
from ..functions import quality as Q
from ..functions.exprs import age_days, present
from ..functions.features import optimal_timing, with_features
from ..functions.priority import with_priority
from ..functions.record import drop_work, prepare
from ..functions.score import ScoringConfig, with_lead_score
from ..operators import aggregates as A
from ..operators import tables as T
from ..session import cut_lineage
from ..sources import readers as RD
from ..sources import sinks as SK
from ..sources.bindings import AS_OF, EVENTS_AS_OF
from ..streaming import jobs as ST
from .features import TIMING, XF, duplicates
from .learning import scratch
from .registry import query
from .reports import P, since
from .scoring import PARTS, SCORED, XPRI, nested, total
from .sqltext import BASE
from .sqltext import W as WORK

SX = {"w": WORK, "parts": PARTS, "scored": SCORED}
BLANK = total().split("ELSE ", 1)[1].rsplit(" END", 1)[0]


@query("src_1", [], "SELECT count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders")
def src_1(t):
    schema = t.raw("orders").select("o_orderkey").schema
    return RD.scan(t.spark, f"{t.sf_dir}/orders.parquet", schema).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("src_2", BASE, f"SELECT id, {BLANK} AS score, 7::BIGINT AS owner_id, 3::BIGINT AS campaign_id FROM parts", {"w": WORK, "parts": PARTS})
def src_2(t):
    path = f"{scratch(t)}/leads"
    nested(t).drop("score", "owner_id", "campaign_id", "company_id").write.json(path)
    return RD.bulk_import(RD.read_leads(t.spark, path), 7, 3, AS_OF).select("id", "score", "owner_id", "campaign_id")


@query("src_3")
def src_3(t):
    path = f"{scratch(t)}/samples"
    with_features(nested(t), AS_OF).select(F.struct("seniority_score", "industry_relevance").alias("features"), F.col("status").alias("label"), F.col("id").alias("lead_id")).write.json(path)
    return RD.read_samples(t.spark, path, ["seniority_score", "industry_relevance"])


@query("src_4", BASE, """SELECT l.id, substring(coalesce(l.email, ''), 1, 255) AS email, 'new' AS status, (c.domain IN (SELECT domain FROM companies WHERE website <> '')) AS known_company FROM leads l LEFT JOIN companies c ON l.company_id = c.id""")
def src_4(t):
    scraped = nested(t).drop("company_id")
    stored = t.companies().where("website <> ''")
    _, leads = RD.ingest(scraped, stored, 1, AS_OF)
    return leads.select("id", "email", "status", (F.col("company_id") < 2**62).alias("known_company"))


FLAT = """SELECT coalesce(first_name, '') AS first_name, coalesce(last_name, '') AS last_name, coalesce(email, '') AS email, coalesce(l.phone, '') AS phone, coalesce(title, '') AS title, coalesce(l.linkedin_url, '') AS linkedin_url, coalesce(source, '') AS source,
 coalesce(status, '') AS status, coalesce(score, 0) AS score, coalesce(c.name, '') AS company_name, coalesce(c.domain, '') AS company_domain, coalesce(c.industry, '') AS company_industry, coalesce(c.size, '') AS company_size, coalesce(c.location, '') AS company_location,
 coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S'), '') AS created_at FROM leads l LEFT JOIN companies c ON l.company_id = c.id"""


def csv_back(t, path):
    return t.spark.read.option("header", True).option("emptyValue", "").csv(path)


@query("snk_1", BASE, FLAT)
def snk_1(t):
    return SK.flat_export(nested(t))


@query("snk_2", BASE, 'SELECT email AS "Email", score AS "Score", company_name AS "Company Name" FROM flat', {"flat": FLAT})
def snk_2(t):
    path = f"{scratch(t)}/xlsx"
    SK.export_leads(nested(t), path, "xlsx")
    return csv_back(t, path).select(F.coalesce("Email", F.lit("")).alias("Email"), F.col("Score").cast("double").alias("Score"), F.coalesce("Company Name", F.lit("")).alias("Company Name"))


@query("snk_3", BASE, "SELECT l.id, l.email, c.name AS company_name FROM leads l LEFT JOIN companies c ON l.company_id = c.id")
def snk_3(t):
    path = f"{scratch(t)}/json"
    SK.export_leads(nested(t), path, "json")
    return t.spark.read.schema("id bigint, email string, company struct<name:string>").json(path).select("id", "email", F.col("company.name").alias("company_name"))


@query("snk_4", BASE, "SELECT count(*) AS n, round(sum(score), 1) AS total_score FROM leads")
def snk_4(t):
    path = f"{scratch(t)}/csv"
    SK.export_leads(nested(t), path, "csv")
    return csv_back(t, path).agg(F.count("*").alias("n"), F.round(F.sum(F.col("score").cast("double")), 1).alias("total_score"))


@query("snk_5", BASE + ["predictions", "quality_scores"], """SELECT l.id, c.name AS company_name, p.prediction_score, q.overall_score FROM leads l LEFT JOIN companies c ON l.company_id = c.id
LEFT JOIN (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) = 1) p ON p.lead_id = l.id
LEFT JOIN (SELECT * FROM quality_scores QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) = 1) q ON q.lead_id = l.id WHERE l.status = 'converted'""")
def snk_5(t):
    rows = T.where_equals(nested(t), status="converted")
    p = A.latest_by(t.predictions().select("id", "lead_id", "created_at", "prediction_score"), "lead_id", "created_at", "id").select(F.col("lead_id").alias("id"), "prediction_score")
    q = A.latest_by(t.quality_scores().select("id", "lead_id", "created_at", "overall_score"), "lead_id", "created_at", "id").select(F.col("lead_id").alias("id"), "overall_score")
    return rows.select("id", F.col("company.name").alias("company_name")).join(p, "id", "left").join(q, "id", "left")


@query("snk_6", BASE, "SELECT l.id, coalesce(l.email, '') AS email, coalesce(l.title, '') AS title, coalesce(l.status, '') AS status, coalesce(c.name, '') AS company_name, coalesce(c.domain, '') AS company_domain FROM leads l LEFT JOIN companies c ON l.company_id = c.id")
def snk_6(t):
    path = f"{scratch(t)}/dataset"
    SK.save_dataset(nested(t), path, "csv")
    return csv_back(t, path).select(F.col("id").cast("bigint").alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("email", "title", "status", "company_name", "company_domain")])


@query("snk_7", BASE, "SELECT l.id, c.name AS company_name, c.size AS company_size, array_to_string(from_json(c.technologies, '[\"VARCHAR\"]'), ', ') AS company_technologies FROM leads l LEFT JOIN companies c ON l.company_id = c.id")
def snk_7(t):
    return SK.flatten(nested(t)).select("id", "company_name", "company_size", "company_technologies")


@query("snk_8", ["leads"], "SELECT id, email FROM leads WHERE email <> ''")
def snk_8(t):
    path = f"{scratch(t)}/emails"
    SK.write_rows(t.leads(dates=False).where("email <> ''").select("id", "email"), path, "json")
    return t.spark.read.schema("id bigint, email string").json(path)


@query("snk_9", ["leads", "companies", "campaigns"], f"""SELECT owner_id, 'overview' AS metric_type, metric_name, value::DOUBLE AS value, 'basic' AS category FROM (UNPIVOT (SELECT l.owner_id, total_leads, recent_leads, coalesce(total_campaigns, 0) AS total_campaigns, (SELECT count(*) FROM companies) AS total_companies
FROM (SELECT owner_id, count(*) AS total_leads, count(CASE WHEN {since('created_at', AS_OF, 7)} THEN 1 END) AS recent_leads FROM leads GROUP BY 1) l LEFT JOIN (SELECT owner_id, count(*) AS total_campaigns FROM campaigns GROUP BY 1) c ON c.owner_id = l.owner_id)
ON total_leads, recent_leads, total_campaigns, total_companies INTO NAME metric_name VALUE value)""")
def snk_9(t):
    return SK.long_metrics(A.overview(t.leads(), t.companies(), t.campaigns(), AS_OF), ["owner_id"], "overview", "basic")


@query("snk_10", ["leads", "predictions"], f"""SELECT owner_id, 'performance' AS metric_type, metric_name, value::DOUBLE AS value, 'performance' AS category FROM (UNPIVOT (SELECT owner_id, count(DISTINCT lead_id)::DOUBLE AS leads_analyzed, count(*)::DOUBLE AS total_predictions, round(avg(prediction_score), 6) AS average_priority_score, round(avg(confidence), 6) AS average_confidence
FROM {P} WHERE {since('p.created_at', EVENTS_AS_OF, 20)} GROUP BY 1) ON leads_analyzed, total_predictions, average_priority_score, average_confidence INTO NAME metric_name VALUE value)""")
def snk_10(t):
    return SK.long_metrics(A.activity(t.predictions(), t.leads(dates=False), EVENTS_AS_OF, 20), ["owner_id"], "performance", "performance")


@query("snk_11", BASE, "SELECT id AS lead_id, 'priority' AS model_type, priority_score AS prediction_score, confidence FROM pri2", {k: v for k, v in XPRI.items() if k != "pri3"})
def snk_11(t):
    path = scratch(t)
    scored = with_priority(nested(t), AS_OF)
    SK.prediction_rows(scored, AS_OF).write.mode("append").parquet(f"{path}/predictions")
    SK.quality_rows(Q.assess(nested(t), AS_OF), AS_OF).write.mode("append").parquet(f"{path}/quality")
    SK.insight_rows(scored, AS_OF).write.mode("append").parquet(f"{path}/insights")
    return t.spark.read.parquet(f"{path}/predictions").select("lead_id", "model_type", "prediction_score", "confidence")


@query("snk_12", ["predictions", "leads"], """SELECT lead_id, max(prediction_score) AS prediction_score FROM (SELECT lead_id, prediction_score FROM predictions WHERE model_type = 'purchase' AND lead_id NOT IN (SELECT id FROM leads WHERE status = 'converted') QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) = 1
UNION ALL SELECT id, score FROM leads WHERE status = 'converted') GROUP BY 1""")
def snk_12(t):
    latest = A.latest_by(t.predictions().where("model_type = 'purchase'"), "lead_id", "created_at", "id").select("lead_id", "prediction_score")
    fresh = t.leads(dates=False).where("status = 'converted'").select(F.col("id").alias("lead_id"), F.col("score").alias("prediction_score"))
    return SK.merge_upsert(latest, fresh, ["lead_id"])


@query("snk_13", ["leads"], "SELECT primary_lead_id, id AS duplicate_lead_id FROM (SELECT id, lower(email) AS e FROM leads WHERE email <> '') JOIN (SELECT lower(email) AS e2, min(id) AS primary_lead_id FROM leads WHERE email <> '' GROUP BY 1) ON e = e2 WHERE id <> primary_lead_id")
def snk_13(t):
    d = cut_lineage(duplicates(t).select("primary_lead_id", "duplicate_lead_id", "status"))
    pair = ["primary_lead_id", "duplicate_lead_id"]
    return SK.insert_absent(d.where("status = 'merged'").select(*pair), d.select(*pair), ["primary_lead_id", "duplicate_lead_id"])


@query("snk_14", ["leads", "predictions", "insights"], """SELECT 'predictions' AS t, count(*) AS n FROM predictions WHERE lead_id NOT IN (SELECT id FROM leads WHERE status = 'rejected') UNION ALL SELECT 'insights', count(*) FROM insights WHERE lead_id NOT IN (SELECT id FROM leads WHERE status = 'rejected')
UNION ALL SELECT 'leads', count(*) FROM leads WHERE status <> 'rejected'""")
def snk_14(t):
    leads = t.leads(dates=False)
    kept = SK.delete_leads(leads.where("status = 'rejected'"), leads, {"predictions": t.predictions(), "insights": t.insights()})
    out = None
    for name, df in kept.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("snk_15", ["leads", "insights"], """SELECT i.id, CASE WHEN i.id % 3 = 0 AND l.owner_id = i.id % 5 THEN 'resolved' ELSE i.status END AS status FROM insights i LEFT JOIN leads l ON l.id = i.lead_id""")
def snk_15(t):
    ins = t.insights()
    updates = ins.select("id", F.when(F.col("id") % 3 == 0, "resolved").otherwise("archived").alias("new_status"), (F.col("id") % 5).alias("user_id"), F.lit("ok").alias("feedback"))
    return SK.update_status(ins, t.leads(dates=False), updates)[0].select("id", "status")


@query("snk_18", BASE, f"SELECT id AS lead_id, u AS missing_field, TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY AS expires_at FROM (SELECT id, unnest(list_filter([CASE WHEN fn = '' THEN 'first_name' END, CASE WHEN ln = '' THEN 'last_name' END, CASE WHEN email = '' THEN 'email' END, CASE WHEN title = '' THEN 'title' END, CASE WHEN phone = '' THEN 'phone' END, CASE WHEN linkedin = '' THEN 'linkedin_url' END, CASE WHEN website = '' THEN 'website' END, CASE WHEN co_industry = '' THEN 'company_industry' END, CASE WHEN co_size = '' THEN 'company_size' END, CASE WHEN co_location = '' THEN 'company_location' END], lambda x: x IS NOT NULL)) AS u FROM w WHERE status <> 'new')", {"w": WORK})
def snk_18(t):
    opp = prepare(nested(t), AS_OF).select("id", Q.enrichment_opportunities().alias("opportunities"))
    pending = t.leads(dates=False).where("status = 'new'").select(F.col("id").alias("lead_id"), F.lit("pending").alias("status"))
    return SK.enrichment_rows(opp, pending, AS_OF).select("lead_id", "missing_field", "expires_at")


@query("snk_19", BASE, f"SELECT id AS lead_id, CASE WHEN status = 'new' THEN 'stored' ELSE best_day END AS best_day FROM (SELECT {TIMING}, status FROM fea)", XF)
def snk_19(t):
    leads = nested(t)
    stored = leads.where("status = 'new'").select(F.col("id").alias("lead_id"), F.lit("stored").alias("best_day"))
    todo = leads.join(stored.select(F.col("lead_id").alias("id")), "id", "left_anti")
    fresh = drop_work(with_features(todo, AS_OF, keep_work=True).withColumn("o", optimal_timing())).select(F.col("id").alias("lead_id"), "o.best_day")
    return stored.unionByName(fresh)


@query("snk_20", ["leads"], "SELECT id AS entity_id, 'score' AS operation_type, '{\"score\":' || score || '}' AS details FROM leads")
def snk_20(t):
    return SK.log_rows(t.leads(dates=False), "score", AS_OF, [F.col("score")]).select("entity_id", "operation_type", "details")


@query("snk_21", ["feedback", "predictions"], "SELECT id, CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment FROM feedback WHERE prediction_id IN (SELECT id FROM predictions)")
def snk_21(t):
    return SK.feedback_rows(t.feedback(), t.predictions())[0].select("id", "sentiment")


@query("snk_22", BASE, "SELECT id, lead_score FROM scored", SX)
def snk_22(t):
    """The exported configuration, written as JSON and imported again, scores as the original does."""
    path, cfg = f"{scratch(t)}/model", ScoringConfig()
    one = t.spark.range(1).select(F.to_json(F.struct(F.create_map(*[F.lit(x) for kv in cfg.weights.items() for x in (kv[0], float(kv[1]))]).alias("weights"),
                                                     F.create_map(*[F.lit(x) for kv in cfg.source_multipliers.items() for x in kv]).alias("source_multipliers"))).alias("value"))
    one.write.text(path)
    row = t.spark.read.schema("weights map<string,double>, source_multipliers map<string,double>").json(path).first()
    return with_lead_score(nested(t), AS_OF, ScoringConfig().updated({"weights": dict(row.weights), "source_multipliers": dict(row.source_multipliers)})).select("id", "lead_score")


# ---- helpers ----------------------------------------------------------------------------------------------------


@query("fn_1", ["quality_scores"], """SELECT id, len(CASE WHEN json_valid(issues_found) THEN from_json(issues_found, '["VARCHAR"]') WHEN issues_found IS NOT NULL THEN [issues_found] END)::INT AS n FROM quality_scores""")
def fn_1(t):
    parsed = F.coalesce(F.from_json("issues_found", "array<string>"), F.when(F.col("issues_found").isNotNull(), F.array("issues_found")))
    return t.quality_scores().select("id", F.when(parsed.isNotNull(), F.size(parsed)).alias("n"))


@query("fn_2", [], "SELECT event_id, (props->>'k')::DOUBLE AS k FROM events")
def fn_2(t):
    return t.raw("events").select("event_id", F.from_json("props", "map<string,double>")["k"].alias("k"))


@query("fn_3", ["leads"], f"SELECT id, created_at::DATE AS day, floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(created_at))) / 86400)::INT AS age_days FROM leads")
def fn_3(t):
    return t.leads().select("id", F.to_date("created_at").alias("day"), age_days(F.col("created_at"), AS_OF).alias("age_days"))


@query("fn_4", ["leads"], "SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE date_trunc('second', created_at) END AS parsed FROM leads")
def fn_4(t):
    raw = F.when(F.col("id") % 9 == 0, F.lit("not a date")).otherwise(F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return t.leads().select("id", F.try_to_timestamp(raw).cast("timestamp_ntz").alias("parsed"))


@query("fn_5", ["leads"], "SELECT owner_id, round(count(*) FILTER (WHERE status = 'converted') * 100.0::DOUBLE / count(*), 6) AS rate FROM leads GROUP BY 1")
def fn_5(t):
    return t.leads(dates=False).groupBy("owner_id").agg(A.r6(A.ratio(A.n_if(A.converted()), F.count("*"), 100.0)).alias("rate"))


@query("fn_6", ["leads"], "SELECT id, md5(lower(email)) AS avatar_key FROM leads WHERE email <> ''")
def fn_6(t):
    return t.leads(dates=False).where(present(F.col("email"))).select("id", F.md5(F.lower("email")).alias("avatar_key"))


NAMES = ["leads", "companies", "campaigns", "predictions", "quality_scores", "insights"]


@query("agg_50", NAMES, " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in NAMES))
def agg_50(t):
    out = None
    for n in NAMES:
        df = t.leads(dates=False) if n == "leads" else getattr(t, n)()
        c = df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


WANTED = ["linkedin", "referral", "website", "event", "purchased", "webinar", "hunter"]


@query("set_3", ["leads"], f"SELECT owner_id, unnest(list_filter({WANTED}, lambda x: NOT list_contains(have, x))) AS missing FROM (SELECT owner_id, list(DISTINCT source) AS have FROM leads GROUP BY 1)")
def set_3(t):
    """Required names minus those present, per owner; the present set is cut to the closed list before it is gathered."""
    have = t.leads(dates=False).where(F.col("source").isin(WANTED)).groupBy("owner_id").agg(F.collect_set("source").alias("have"))
    return have.select("owner_id", F.explode(F.array_except(F.array(*[F.lit(x) for x in WANTED]), "have")).alias("missing"))


@query("agg_56", ["predictions", "quality_scores", "insights", "models"], """SELECT p, q, i, active_models, total_models, CASE WHEN active_models > 0 AND p > 0 THEN 'online' WHEN active_models > 0 OR p > 0 THEN 'limited' ELSE 'offline' END AS status
FROM (SELECT (SELECT count(*) FROM predictions) AS p, (SELECT count(*) FROM quality_scores) AS q, (SELECT count(*) FROM insights) AS i, (SELECT count(*) FILTER (WHERE is_active) FROM models) AS active_models, (SELECT count(*) FROM models) AS total_models)""")
def agg_56(t):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    m = t.models().agg(A.n_if(F.col("is_active")).alias("active_models"), F.count("*").alias("total_models"))
    r = n(t.predictions(), "p").crossJoin(n(t.quality_scores(), "q")).crossJoin(n(t.insights(), "i")).crossJoin(m)
    return r.withColumn("status", F.when((F.col("active_models") > 0) & (F.col("p") > 0), "online").when((F.col("active_models") > 0) | (F.col("p") > 0), "limited").otherwise("offline"))


@query("agg_49", BASE, """SELECT campaign_id, field, value, count(*) AS n FROM (SELECT campaign_id, 'industry' AS field, coalesce(nullif(c.industry, ''), 'Unknown') AS value FROM leads l LEFT JOIN companies c ON l.company_id = c.id
 UNION ALL SELECT campaign_id, 'title', coalesce(nullif(title, ''), 'Unknown') FROM leads UNION ALL SELECT campaign_id, 'size', coalesce(nullif(c.size, ''), 'Unknown') FROM leads l LEFT JOIN companies c ON l.company_id = c.id) GROUP BY ALL""")
def agg_49(t):
    u = lambda c: F.when(present(c), c).otherwise("Unknown")
    rows = nested(t).select("campaign_id", u(F.col("company.industry")).alias("industry"), u(F.col("title")).alias("title"), u(F.col("company.size")).alias("size"))
    return A.count_by(rows.unpivot(["campaign_id"], ["industry", "title", "size"], "field", "value"), "campaign_id", "field", "value", name="n")


@query("srt_11", ["quality_scores"], """SELECT id, array_to_string(from_json(issues_found, '["VARCHAR"]')[1:1], ',') AS first_issue FROM quality_scores WHERE json_valid(issues_found)""")
def srt_11(t):
    q = t.quality_scores().withColumn("i", F.from_json("issues_found", "array<string>")).where("i IS NOT NULL")
    return q.select("id", F.array_join(F.slice("i", 1, 1), ",").alias("first_issue"))


# ---- streams ----------------------------------------------------------------------------------------------------


def lead_stream(t):
    """Leads with their company written as parquet files and read as a stream."""
    path = scratch(t)
    nested(t).write.parquet(f"{path}/in")
    stored = t.spark.read.parquet(f"{path}/in")
    return path, ST.read_table(t.spark, f"{path}/in", stored.schema), stored


@query("str_1", BASE, "SELECT id, lead_score FROM scored", SX)
def str_1(t):
    path, stream, _ = lead_stream(t)
    ST.analyze_changes(stream, f"{path}/out", AS_OF, f"{path}/cp").awaitTermination()
    return t.spark.read.parquet(f"{path}/out/scores").select("id", "lead_score")


@query("str_2", BASE, "SELECT id AS lead_id, priority_score AS prediction_score FROM pri2", {k: v for k, v in XPRI.items() if k != "pri3"})
def str_2(t):
    path, stream, _ = lead_stream(t)
    ST.analyze_changes(stream, f"{path}/out", AS_OF, f"{path}/cp").awaitTermination()
    return t.spark.read.parquet(f"{path}/out/predictions").select("lead_id", "prediction_score")


@query("str_3")
def str_3(t):
    path = scratch(t)
    rows = nested(t)
    rows.where("created_at >= TIMESTAMP_NTZ '1996-01-01 00:00:00'").write.parquet(f"{path}/in")
    rows.where("created_at IS NULL OR created_at < TIMESTAMP_NTZ '1996-01-01 00:00:00'").write.parquet(f"{path}/old")
    stored = t.spark.read.parquet(f"{path}/old")
    ST.duplicates_of_new(ST.read_table(t.spark, f"{path}/in", stored.schema), stored, f"{path}/out", AS_OF, f"{path}/cp", tenant="owner_id").awaitTermination()
    return t.spark.read.parquet(f"{path}/out/pairs").select("primary_lead_id", "duplicate_lead_id", "match_score")


def event_stream(t):
    """The events as a stream; the time column is cast for watermarks."""
    path = scratch(t)
    t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{path}/in")
    schema = t.spark.read.parquet(f"{path}/in").schema
    return path, ST.read_table(t.spark, f"{path}/in", schema)


def sunk(t, df, path, mode="append"):
    """Run a stream to its end into parquet."""
    df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{path}/out")


@query("str_4", [], """SELECT ts::DATE::TIMESTAMP AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL""")
def str_4(t):
    path, stream = event_stream(t)
    m = ST.rolling_metrics(stream, "ts", ["event_type"], "1 day", None, F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    ST.upsert_changes(m, f"{path}/out", f"{path}/cp").awaitTermination()
    return ST.latest(t.spark, f"{path}/out", ["window", "event_type"]).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("str_5", [], """WITH RECURSIVE r AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2
UNION ALL SELECT r.user_id, r.event_type, min(e.ts) FROM r JOIN events e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.ts >= r.ts + INTERVAL 1 HOUR GROUP BY 1, 2) SELECT * FROM r""")
def str_5(t):
    path, stream = event_stream(t)
    keys = ["user_id", "event_type"]
    ST.first_within(stream, keys, "ts", 3600, f"{path}/out", f"{path}/cp").awaitTermination()
    return ST.latest(t.spark, f"{path}/out/results", keys).select(*keys, F.col("ts").cast("timestamp_ntz").alias("ts"))


# Requests of a user one after the other; the list holds the times of the last accepted ones.
RATE = """WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE ts IS NOT NULL),
r AS (SELECT user_id, event_id, ts, rn, true AS accepted, true AS accepted_long, [ts] AS a, [ts] AS b FROM o WHERE rn = 1
UNION ALL SELECT o.user_id, o.event_id, o.ts, o.rn, x, y, CASE WHEN x THEN list_append(a, o.ts) ELSE a END, CASE WHEN y THEN list_append(b, o.ts) ELSE b END FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1,
LATERAL (SELECT len(list_filter(a, lambda z: o.ts - z < INTERVAL 60 SECOND)) < 30 AS x, len(list_filter(b, lambda z: o.ts - z < INTERVAL 864000 SECOND)) < 3 AS y))
SELECT user_id, event_id, ts, accepted, accepted_long FROM r"""


@query("str_6", [], RATE)
def str_6(t):
    """Thirty requests a minute, and three in ten days, which the test events do exceed."""
    events = t.raw("events")
    slow = ST.admitted(events, "user_id", "ts", "event_id", 3, 864_000).select("event_id", F.col("accepted").alias("accepted_long"))
    return ST.admitted(events, "user_id", "ts", "event_id").join(slow, "event_id").select("user_id", "event_id", "ts", "accepted", "accepted_long")


@query("str_7", ["runs"], """, r AS (SELECT purpose, run_id, accuracy, row_number() OVER w AS rn, lag(accuracy, 4) OVER w AS a4 FROM runs WINDOW w AS (PARTITION BY purpose ORDER BY run_id))
SELECT purpose, run_id, least(rn, 100)::INT AS kept, coalesce(accuracy < a4 * 0.9, false) AS declining FROM r""")
def str_7(t):
    path = scratch(t)
    t.runs().write.parquet(f"{path}/in")
    schema = t.spark.read.parquet(f"{path}/in").schema
    ST.monitored_runs(ST.read_table(t.spark, f"{path}/in", schema), f"{path}/out", f"{path}/cp").awaitTermination()
    return t.spark.read.parquet(f"{path}/out/runs").drop("batch")


@query("str_8", ["predictions"], f"SELECT model_type, count(*) FILTER (WHERE {since('created_at', '2024-01-30 00:00:00', 1)}) AS new_rows, count(*) FILTER (WHERE {since('created_at', '2024-01-30 00:00:00', 1)}) >= 100 AS due FROM predictions GROUP BY 1")
def str_8(t):
    return ST.training_due(t.predictions(), "model_type", "created_at", "2024-01-30 00:00:00")


_ = M
