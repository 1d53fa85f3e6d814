"""Registered analyzer features, derived rows, similarity and entity resolution (FEA, DRV, SIM, ER, related AGG and SNK)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import rules as R
from ..functions.record import prepare, with_company
from ..functions.similarity import ratio, sequence_ratio
from ..operators import aggregates as A
from ..operators import ranking as W
from ..operators import resolve as ER
from ..operators.ranking import number_rows
from ..operators.tables import adjacent_pairs
from ..session import cut_lineage, spread
from ..sources.bindings import AS_OF, EVENTS_AS_OF
from .quality import REPORT
from .quality import X as QX
from .registry import query
from .scoring import nested
from .sqltext import BASE, case, ends, has, lines, lit, one_of, pts, when
from .sqltext import W as WORK


def bands(col, table, otherwise, blank):
    return "(" + case([(f"{col} = ''", blank)] + [(has(col, ws), v) for v, ws in table], otherwise) + ")::DOUBLE"


EQ = pts("has_at", "least(100, greatest(0, 50 + " + case([("regexp_matches(email_l, '^[a-z]+\\.[a-z]+@')", 25), ("regexp_matches(email_l, '^[a-z]+[a-z]+@')", 15)], 0) + "+" + pts(one_of("domain", R.FEATURE_FREE_DOMAINS), -10, 20) + "+"
         + case([(ends("domain", [".ai", ".io", ".tech"]), 15), (ends("domain", [".com"]), 10)], 0) + "+" + case([("length(local) < 3", -15), ("length(local) > 20", -10)], 0) + "+" + pts(has("local", R.FEATURE_GENERIC), -20) + "))")
ENG = "least(100, 50 + methods * 10 + " + "+".join([pts("linkedin <> ''", 15), pts("fn <> '' AND ln <> ''", 10), pts("co_website <> ''", 8), pts(has("title", ["manager", "director", "head", "lead"]), 12)]) + ")"
COMP = "(((fn <> '')::INT + (ln <> '')::INT + (email <> '')::INT + (title <> '')::INT) * 2 + (phone <> '')::INT + (linkedin <> '')::INT + (co_name <> '')::INT + (co_industry <> '')::INT + (co_size <> '')::INT + (co_location <> '')::INT) * 100.0::DOUBLE / 14"
FRESH = "(" + case([("age IS NULL", 50), ("age <= 7", 100), ("age <= 30", 90), ("age <= 90", 70), ("age <= 180", 50)], "greatest(20, 100 - age / 10.0::DOUBLE)") + ")::DOUBLE"
CONS = ("greatest(0, 100 + " + pts("has_at AND co_domain <> '' AND domain <> co_domain AND NOT contains(co_domain, domain) AND NOT contains(domain, co_domain)", -20) + "+"
        + pts("email <> '' AND fn <> '' AND NOT contains(lower(local), lower(fn)) AND NOT contains(lower(local), lower(ln))", -15) + "+" + pts(has("title", ["ceo", "cto", "cfo"]) + " AND contains(co_size, '1-10')", -5) + ")")
SRCQ = "(" + case([(f"source = '{k}'", v) for k, v in R.FEATURE_SOURCE.items()], 50) + ")::DOUBLE"
FEA = f"""SELECT *, least(90, greatest(10, greatest(30, 80 - seniority_score * 0.3::DOUBLE) + {pts('has_email AND email_quality_score > 70', 15)} + {pts('has_linkedin', 10)} + industry_relevance * 0.2::DOUBLE + {pts('company_size_score BETWEEN 60 AND 90', 10)})) AS response_likelihood,
 [has_email::INT::DOUBLE, has_phone::INT::DOUBLE, has_linkedin::INT::DOUBLE, email_quality_score, seniority_score, title_decision_power, industry_relevance, company_size_score, location_score, engagement_potential, completeness_score, source_quality] AS vector
FROM (SELECT *, email <> '' AS has_email, phone <> '' AS has_phone, linkedin <> '' AS has_linkedin, {EQ} AS email_quality_score, {bands('title', R.FEATURE_SENIORITY, 30, 0)} AS seniority_score, {bands('title', R.FEATURE_DECISION, 20, 0)} AS title_decision_power,
 {bands('co_industry', R.FEATURE_INDUSTRY, 50, 50)} AS industry_relevance, {bands('co_size', R.FEATURE_SIZE, 50, 50)} AS company_size_score, {bands('co_location', R.FEATURE_LOCATION, 50, 50)} AS location_score, ({ENG})::DOUBLE AS engagement_potential,
 {COMP} AS completeness_score, {FRESH} AS freshness_score, {CONS} AS consistency_score, {SRCQ} AS source_quality FROM w)"""
ANA = f"""SELECT *, least(95, greatest(5, 50 + {pts('has_email', 15)} + {pts('has_phone', 10)} + {pts('has_linkedin', 8)} + seniority_score * 0.3::DOUBLE + title_decision_power * 0.25::DOUBLE + industry_relevance * 0.2::DOUBLE
  + company_size_score * 0.15::DOUBLE + location_score * 0.1::DOUBLE + completeness_score * 0.1::DOUBLE + source_quality * 0.1::DOUBLE)) AS priority_score,
 least(100, greatest(0, completeness_score * 0.4::DOUBLE + (email_quality_score + {pts('has_phone', 50)} + {pts('has_linkedin', 30)}) / 3 * 0.3::DOUBLE + (seniority_score + industry_relevance) / 2 * 0.2::DOUBLE + (source_quality + freshness_score) / 2 * 0.1::DOUBLE)) AS quality_score,
 least(0.95::DOUBLE, greatest(0.1::DOUBLE, completeness_score / 100 * 0.4::DOUBLE + consistency_score / 100 * 0.3::DOUBLE + freshness_score / 100 * 0.2::DOUBLE + least(1, source_quality / 80) * 0.1::DOUBLE)) AS confidence,
 least(100, 50 + {pts('seniority_score >= 80', 10)} + {pts('freshness_score >= 90', 15)}) AS urgency_score FROM fea"""
XF, XA = {"w": WORK, "fea": FEA}, {"w": WORK, "fea": FEA, "ana": ANA}


def feats(t):
    return X.with_features(nested(t), AS_OF)


def r6(c):
    return F.round(c, 6).alias(c)


for key, col in [("fea_1", "email_quality_score"), ("fea_2", "seniority_score"), ("fea_3", "title_decision_power"), ("fea_4", "industry_relevance"), ("fea_5", "company_size_score"), ("fea_6", "location_score"),
                 ("fea_7", "engagement_potential"), ("fea_8", "response_likelihood"), ("fea_9", "completeness_score"), ("fea_10", "freshness_score"), ("fea_11", "consistency_score"), ("fea_12", "source_quality")]:
    query(key, BASE, f"SELECT id, round({col}, 6) AS {col} FROM fea", XF)(lambda t, col=col: feats(t).select("id", r6(col)))


@query("fea_13", BASE, "SELECT id, array_to_string(list_transform(vector, lambda x: round(x)::BIGINT), ',') AS vector FROM fea", XF)
def fea_13(t):
    return feats(t).select("id", F.array_join(F.transform("vector", lambda x: F.round(x, 0).cast("bigint").cast("string")), ",").alias("vector"))


@query("fea_14", BASE, "SELECT id, round(priority_score, 6) AS priority_score, round(quality_score, 6) AS quality_score FROM ana", XA)
def fea_14(t):
    return feats(t).select("id", F.round(X.rule_priority(), 6).alias("priority_score"), F.round(X.rule_quality(), 6).alias("quality_score"))


@query("fea_15", BASE, "SELECT id, round(confidence, 6) AS confidence FROM ana", XA)
def fea_15(t):
    return feats(t).select("id", F.round(X.confidence(), 6).alias("confidence"))


def analyzed(t):
    return X.analyze(nested(t), AS_OF)


EXPL = f"""CASE WHEN s = '' THEN 'Standard lead profile with moderate conversion potential' ELSE CASE WHEN priority_score >= 60 THEN 'High-priority lead: ' ELSE 'Lower priority: ' END || s END"""
EXS = "(SELECT *, CASE WHEN priority_score >= 80 THEN " + lines(when("seniority_score >= 80", "Executive-level contact with high decision-making authority"), when("industry_relevance >= 80", "operates in high-value target industry"),
      when("has_email AND email_quality_score > 70", "high-quality professional contact information available"), sep=", ") + " WHEN priority_score >= 60 THEN " + lines(
      when("title_decision_power >= 60", "Senior professional with influence in decision-making"), when("company_size_score >= 70", "works at optimally-sized company for our solution"),
      when("completeness_score >= 70", "comprehensive lead profile with good data quality"), sep=", ") + " ELSE " + lines(when("completeness_score < 50", "limited contact information available"),
      when("seniority_score < 40", "junior-level contact with limited decision authority"), when("industry_relevance < 50", "industry may not be ideal fit for our solution"), sep=", ") + " END AS s FROM ana)"


@query("drv_1", BASE, f"SELECT id, {EXPL} AS explanation FROM {EXS}", XA)
def drv_1(t):
    return analyzed(t).select("id", F.col("priority_explanation").alias("explanation"))


ACTS = ("array_to_string(((CASE WHEN priority_score >= 80 THEN ['Schedule immediate personalized outreach', 'Research recent company news and funding', 'Prepare executive-level value proposition'] WHEN priority_score >= 60 THEN ['Add to priority campaign within 24 hours', 'Customize messaging for their industry'] ELSE ['Include in nurture campaign', 'Consider data enrichment before outreach'] END) || list_filter(["
        + ", ".join(["CASE WHEN NOT has_email THEN '🔍 Find email address using lead enrichment tools' WHEN email_quality_score < 50 THEN '⚠️ Verify email deliverability before sending' END", when("NOT has_phone AND seniority_score > 70", "📞 Research phone number for executive outreach"),
                     when("NOT has_linkedin", "🔗 Find LinkedIn profile for social selling approach"), when("completeness_score < 60", "📊 Enrich lead data before outreach")]) + "], lambda x: x IS NOT NULL))[1:6], ' | ')")


@query("drv_2", BASE, f"SELECT id, {ACTS} AS actions FROM ana", XA)
def drv_2(t):
    return analyzed(t).select("id", F.array_join("recommended_actions", " | ").alias("actions"))


@query("drv_3", BASE, """SELECT id, CASE WHEN NOT has_email AND has_linkedin THEN 'linkedin' ELSE 'email' END AS primary_channel, CASE WHEN NOT (NOT has_email AND has_linkedin) AND has_phone AND seniority_score >= 70 THEN 'phone' ELSE 'linkedin' END AS secondary_channel,
 CASE WHEN seniority_score >= 80 THEN 'executive' WHEN seniority_score < 40 THEN 'friendly' ELSE 'professional' END AS message_tone, CASE WHEN industry_relevance >= 80 OR seniority_score >= 80 THEN 'high' ELSE 'medium' END AS personalization_level,
 CASE WHEN seniority_score >= 80 THEN 'executive' ELSE 'standard' END AS follow_up_sequence,
 CASE WHEN industry_relevance >= 80 THEN 'industry_specific_roi' WHEN seniority_score >= 80 THEN 'strategic_outcomes' WHEN seniority_score < 40 THEN 'features_benefits' ELSE 'value_proposition' END AS content_focus FROM fea""", XF)
def drv_3(t):
    return feats(t).select("id", X.engagement_strategy().alias("s")).select("id", "s.*")


@query("drv_4", BASE, """SELECT id, CASE WHEN industry_relevance >= 80 THEN 'wednesday' ELSE 'tuesday' END AS best_day, CASE WHEN seniority_score >= 80 THEN 8 WHEN industry_relevance >= 80 THEN 9 ELSE 10 END AS best_hour_start,
 CASE WHEN seniority_score >= 80 THEN 9 WHEN industry_relevance >= 80 THEN 11 ELSE 12 END AS best_hour_end, CASE WHEN seniority_score >= 80 THEN 0.8::DOUBLE WHEN industry_relevance >= 80 THEN 0.7 ELSE 0.5 END AS confidence,
 CASE WHEN seniority_score >= 80 THEN 'Executive contacts often check email early morning before meetings start' WHEN industry_relevance >= 80 THEN 'Tech industry professionals often prefer mid-week, morning contacts' ELSE '' END AS reasoning FROM fea""", XF)
def drv_4(t):
    return feats(t).select("id", X.timing_analysis().alias("s")).select("id", "s.best_day", "s.best_hour_start", "s.best_hour_end", "s.confidence", "s.reasoning")


ZONE = case([(has("co_location", ws), lit(z)) for z, ws in R.TIMEZONES], "'UTC'")
TIMING = f"""id, CASE WHEN industry_relevance >= 80 THEN 'wednesday' ELSE 'tuesday' END AS best_day, CASE WHEN seniority_score >= 80 THEN 8 WHEN industry_relevance >= 80 THEN 9 ELSE 10 END AS best_hour_start,
 CASE WHEN location_score >= 80 THEN {ZONE} ELSE 'UTC' END AS timezone, round(CASE WHEN seniority_score >= 80 THEN 0.8::DOUBLE WHEN industry_relevance >= 80 THEN 0.7 ELSE 0.6 END + {pts('location_score >= 80', 0.1)}, 6) AS confidence,
 CASE WHEN seniority_score >= 80 THEN 0.28::DOUBLE WHEN industry_relevance >= 80 THEN 0.22 ELSE 0.15 END AS success_rate"""


@query("drv_5", BASE, f"SELECT {TIMING} FROM fea", XF)
def drv_5(t):
    return X.analyze(nested(t), AS_OF).select("id", "optimal_timing.best_day", "optimal_timing.best_hour_start", "optimal_timing.timezone", "optimal_timing.confidence", "optimal_timing.success_rate")


@query("drv_6", BASE, f"SELECT id, {ZONE} AS timezone FROM w", {"w": WORK})
def drv_6(t):
    return prepare(nested(t), AS_OF).select("id", X.timezone().alias("timezone"))


PROB = "least(0.8::DOUBLE, 0.05::DOUBLE * CASE WHEN seniority_score >= 80 THEN 3 WHEN seniority_score >= 60 THEN 2 ELSE 1 END * (1 + industry_relevance / 100) * CASE WHEN company_size_score >= 80 THEN 1.5::DOUBLE ELSE 1 END * (0.5::DOUBLE + completeness_score / 200) * (0.7::DOUBLE + engagement_potential / 333))"


@query("drv_7", BASE, f"SELECT id, round({PROB}, 6) AS conversion_probability FROM fea", XF)
def drv_7(t):
    return feats(t).select("id", F.round(X.conversion_probability(), 6).alias("conversion_probability"))


@query("drv_8", BASE, "SELECT id, urgency_score FROM ana", XA)
def drv_8(t):
    return feats(t).select("id", X.urgency(AS_OF).alias("urgency_score"))


IMPACT = f"""CASE WHEN company_size_score >= 85 THEN 'large' WHEN company_size_score <= 60 THEN 'small' ELSE 'medium' END AS deal_size_potential, CASE WHEN industry_relevance >= 90 THEN 'high' WHEN industry_relevance <= 50 THEN 'low' ELSE 'medium' END AS strategic_value,
 CASE WHEN company_size_score >= 85 AND seniority_score >= 80 THEN '$50K-$200K' WHEN company_size_score >= 70 THEN '$20K-$75K' WHEN company_size_score >= 50 THEN '$5K-$30K' ELSE '$1K-$15K' END AS estimated_deal_value,
 CASE WHEN company_size_score >= 85 THEN '6-12 months' WHEN company_size_score >= 70 THEN '3-6 months' WHEN seniority_score >= 80 THEN '2-4 months' ELSE '1-3 months' END AS sales_cycle_length,
 {lines(when('seniority_score >= 80', 'Decision-maker authority'), when('industry_relevance >= 80', 'High industry fit'), when('completeness_score >= 80', 'Complete contact profile'), when('engagement_potential >= 70', 'High engagement potential'), when('source_quality >= 80', 'High-quality lead source'))} AS success_indicators,
 {lines(when('completeness_score < 50', 'Incomplete contact information'), when('response_likelihood < 40', 'Low response probability'), when('consistency_score < 70', 'Data quality concerns'), when('freshness_score < 50', 'Outdated lead information'), when('industry_relevance < 50', 'Industry fit concerns'))} AS risk_factors"""


@query("drv_9", BASE, f"SELECT id, {IMPACT} FROM fea", XF)
def drv_9(t):
    b = feats(t).select("id", X.business_impact().alias("b")).select("id", "b.*")
    return b.withColumns({c: F.array_join(c, " | ") for c in ("success_indicators", "risk_factors")})


@query("drv_10", BASE, f"SELECT id, {lines(when('priority_score >= 80', 'High-Priority Lead Detected'), when('quality_score < 60', 'Data Quality Enhancement Needed'), when('urgency_score >= 80', 'Time-Sensitive Opportunity'), when('industry_relevance >= 85', 'High-Value Industry Target'), when('engagement_potential >= 80', 'High Engagement Potential'))} AS titles FROM ana", XA)
def drv_10(t):
    return analyzed(t).select("id", F.array_join(F.transform("insights", lambda i: i.title), " | ").alias("titles"))


OUT = "least(100, greatest(0, " + case([(f"actual_outcome = '{k}'", v) for k, v in R.OUTCOME_SCORES.items()], 50) + " + CASE WHEN rating > 0 THEN (rating - 3) * 10 ELSE 0 END))::DOUBLE"


@query("drv_11", ["feedback"], f"SELECT id, {OUT} AS label FROM feedback")
def drv_11(t):
    return t.feedback().select("id", X.outcome_score(F.col("actual_outcome"), F.col("rating")).alias("label"))


@query("drv_18", BASE, f"SELECT {TIMING.replace('confidence', 'timing_confidence')}, round(priority_score, 6) AS priority_score, round(quality_score, 6) AS quality_score, round(a_conf, 6) AS confidence, urgency_score, round({PROB}, 6) AS conversion_probability FROM (SELECT *, confidence AS a_conf FROM ana)", XA)
def drv_18(t):
    a = analyzed(t)
    return a.select("id", "optimal_timing.best_day", "optimal_timing.best_hour_start", "optimal_timing.timezone", F.col("optimal_timing.confidence").alias("timing_confidence"), "optimal_timing.success_rate",
                    r6("priority_score"), r6("quality_score"), r6("confidence"), "urgency_score", r6("conversion_probability"))


@query("drv_19", BASE, """SELECT count(*) AS profiles, sum(n)::BIGINT AS leads, max(n) AS largest FROM (SELECT count(*) AS n FROM leads l LEFT JOIN companies c ON l.company_id = c.id GROUP BY coalesce(email, ''), coalesce(title, ''), coalesce(c.name, ''), coalesce(c.size, ''))""")
def drv_19(t):
    g = nested(t).groupBy(X.profile_key().alias("k")).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("profiles"), F.sum("n").alias("leads"), F.max("n").alias("largest"))


# ---- batch rollups ----------------------------------------------------------------------------------------------


@query("agg_41", BASE, """SELECT owner_id, count(*) AS total_analyzed, round(avg(priority_score), 6) AS average_priority, round(avg(quality_score), 6) AS average_quality, round(avg(confidence), 6) AS average_confidence,
 count(*) FILTER (WHERE priority_score >= 80) AS high_priority_count, count(*) FILTER (WHERE priority_score >= 60 AND priority_score < 80) AS medium_priority_count, count(*) FILTER (WHERE priority_score < 60) AS low_priority_count FROM ana GROUP BY 1""", XA)
def agg_41(t):
    p = F.col("priority_score")
    return analyzed(t).groupBy("owner_id").agg(
        F.count("*").alias("total_analyzed"), A.mean("priority_score").alias("average_priority"), A.mean("quality_score").alias("average_quality"), A.mean("confidence").alias("average_confidence"),
        A.n_if(p >= 80).alias("high_priority_count"), A.n_if((p >= 60) & (p < 80)).alias("medium_priority_count"), A.n_if(p < 60).alias("low_priority_count"))


@query("agg_55", BASE, """SELECT owner_id, array_to_string(list_filter([CASE WHEN h > 0 THEN '🎯 Focus on ' || h || ' high-priority leads first' END, CASE WHEN q > 0 THEN '📊 Enrich data for ' || q || ' leads before outreach' END,
 CASE WHEN c > 0 THEN '⚠️ Validate ' || c || ' leads with uncertain analysis' END, '🏢 Create industry-specific campaigns for technology sector'], lambda x: x IS NOT NULL)[1:5], ' | ') AS recommendations
FROM (SELECT owner_id, count(*) FILTER (WHERE priority_score >= 80) AS h, count(*) FILTER (WHERE quality_score < 60) AS q, count(*) FILTER (WHERE confidence < 0.5) AS c FROM ana GROUP BY 1)""", XA)
def agg_55(t):
    from ..functions.exprs import compact, say

    g = analyzed(t).groupBy("owner_id").agg(A.n_if(F.col("priority_score") >= 80).alias("h"), A.n_if(F.col("quality_score") < 60).alias("q"), A.n_if(F.col("confidence") < 0.5).alias("c"))
    items = compact(say(F.col("h") > 0, F.format_string("🎯 Focus on %d high-priority leads first", "h")), say(F.col("q") > 0, F.format_string("📊 Enrich data for %d leads before outreach", "q")),
                    say(F.col("c") > 0, F.format_string("⚠️ Validate %d leads with uncertain analysis", "c")), F.lit("🏢 Create industry-specific campaigns for technology sector"))
    return g.select("owner_id", F.array_join(F.slice(items, 1, 5), " | ").alias("recommendations"))


AGG40 = f"""SELECT a.id, a.owner_id, CASE WHEN priority_score >= 80 THEN 'high' WHEN priority_score >= 60 THEN 'medium' ELSE 'low' END AS band, round(r.overall_score, 6) AS quality, r.overall_score < 70 AS quality_issue FROM ana a JOIN report r ON r.id = a.id"""


def batch_bands(t):
    """AGG-40 in long form: one row per lead with its band, so an id list is never gathered into one cell."""
    from ..functions.quality import assess

    rows = cut_lineage(X.with_features(nested(t), AS_OF).withColumn("priority_score", X.rule_priority()).select("id", "priority_score"))
    q = assess(nested(t), AS_OF).select("id", "owner_id", "overall_score")
    p = F.col("priority_score")
    return q.join(rows, "id").select("id", "owner_id", F.when(p >= 80, "high").when(p >= 60, "medium").otherwise("low").alias("band"), F.round("overall_score", 6).alias("quality"), (F.col("overall_score") < 70).alias("quality_issue"))


@query("agg_40", BASE, AGG40, {**QX, "fea": FEA, "ana": ANA})
def agg_40(t):
    return batch_bands(t)


@query("sim_3", [], """SELECT a.vec_id AS id1, b.vec_id AS id2, round(greatest(0, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def sim_3(t):
    e = t.raw("embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("id2"), F.col("embedding").alias("v"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("id1"), "id2", F.round(X.cosine("embedding", "v"), 6).alias("cosine"))


@query("sim_4", BASE, """SELECT a.id AS id1, b.id AS id2, round(1 - list_sum(list_transform(list_zip(a.vector, b.vector), lambda p: abs(p[1] - p[2]))) / 12 / 100, 6) AS similarity FROM fea a JOIN fea b ON b.id = a.id + 1""", XF)
def sim_4(t):
    f = cut_lineage(feats(t).select("id", "vector"))
    b = f.select((F.col("id") - 1).alias("id"), F.col("id").alias("id2"), F.col("vector").alias("v"))
    return f.join(b, "id").select(F.col("id").alias("id1"), "id2", F.round(X.mean_difference("vector", "v"), 6).alias("similarity"))


@query("sim_5", BASE, """, t AS (SELECT id, co_industry, co_size, list_distinct(list_filter(string_split_regex(trim(title), '\\s+'), lambda x: x <> '')) AS ws FROM w)
SELECT a.id AS id1, b.id AS id2, round(least(1, CASE WHEN len(a.ws) > 0 AND len(b.ws) > 0 THEN len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(a.ws || b.ws)) * 0.3::DOUBLE ELSE 0 END
 + CASE WHEN a.co_industry = b.co_industry AND a.co_industry <> '' THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN a.co_size = b.co_size AND a.co_size <> '' THEN 0.3::DOUBLE ELSE 0 END), 6) AS similarity FROM t a JOIN t b ON b.id = a.id + 1""", {"w": WORK})
def sim_5(t):
    p = prepare(nested(t), AS_OF).select("id", F.struct(F.filter(F.array_distinct(F.split(F.trim("w_title"), r"\s+")), lambda x: x != "").alias("ws"), F.col("w_co_industry").alias("i"), F.col("w_co_size").alias("s")).alias("a"))
    q = p.select((F.col("id") - 1).alias("id"), F.col("id").alias("id2"), F.col("a").alias("b"))
    j = F.when((F.size("a.ws") > 0) & (F.size("b.ws") > 0), F.size(F.array_intersect("a.ws", "b.ws")) / F.size(F.array_union("a.ws", "b.ws")) * 0.3).otherwise(0.0)
    same = lambda f, x: F.when((F.col(f"a.{f}") == F.col(f"b.{f}")) & (F.col(f"a.{f}") != ""), x).otherwise(0.0)
    return p.join(q, "id").select(F.col("id").alias("id1"), "id2", F.round(F.least(F.lit(1.0), j + same("i", 0.4) + same("s", 0.3)), 6).alias("similarity"))


def feature_struct():
    return F.struct("id", *X.VECTOR, "vector")


@query("sim_6", BASE, "SELECT a.id AS id1, b.id AS id2, " + lines(*[when(f"abs(a.{f} - b.{f}) < {tol}", n) for n, f, tol in [
    ("email_quality", "email_quality_score", 20), ("seniority_level", "seniority_score", 25), ("industry_sector", "industry_relevance", 20), ("company_size", "company_size_score", 20), ("geographic_region", "location_score", 25)]],
    when("abs(a.methods - b.methods) <= 1", "contact_completeness"), sep=",") + " AS matching FROM fea a JOIN fea b ON b.id = a.id + 1", XF)
def sim_6(t):
    f = cut_lineage(feats(t).select("id", feature_struct().alias("a")))
    b = f.select((F.col("id") - 1).alias("id"), F.col("id").alias("id2"), F.col("a").alias("b"))
    return f.join(b, "id").select(F.col("id").alias("id1"), "id2", F.array_join(X.matching_features("a", "b"), ",").alias("matching"))


def numbered(t):
    return number_rows(nested(t).select("id", "first_name", "last_name", "email", "title", F.col("company.name").alias("company_name"), F.col("company.location").alias("location"),
                                        F.col("company.industry").alias("industry"), F.col("company.domain").alias("domain")), ["id"]).drop("_total")


@query("sim_1")
def sim_1(t):
    p = adjacent_pairs(numbered(t))
    n = lambda s: F.lower(F.coalesce(F.col(f"{s}.email"), F.lit("")))
    return p.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), ratio(n("a"), n("b")).alias("ratio"))


def _filled(side: str, column: str):
    return F.trim(F.lower(F.coalesce(F.col(f"{side}.{column}"), F.lit(""))))


def text_similarity(a, b):
    """The ratio of two texts; 0 if either is blank."""
    return F.when((a != "") & (b != ""), sequence_ratio(a, b)).otherwise(F.lit(0.0))


@query("sim_2")
def sim_2(t):
    p = adjacent_pairs(numbered(t))
    return p.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), *[text_similarity(_filled("a", c), _filled("b", c)).alias(f"{c}_similarity") for c in ("email", "company_name", "title", "location")])


@query("sim_7")
def sim_7(t):
    p = adjacent_pairs(numbered(t))
    nm = lambda s: F.trim(F.concat_ws(" ", _filled(s, "first_name"), _filled(s, "last_name")))
    alike = lambda c: text_similarity(_filled("a", c), _filled("b", c))
    f = p.select(F.col("a.id").alias("lead1_id"), F.col("b.id").alias("lead2_id"), text_similarity(nm("a"), nm("b")).alias("name_similarity"), alike("email").alias("email_similarity"),
                 alike("company_name").alias("company_similarity"), alike("title").alias("title_similarity"), alike("location").alias("location_similarity"),
                 (_filled("a", "industry") == _filled("b", "industry")).alias("industry_match"), ((_filled("a", "domain") == _filled("b", "domain")) & (_filled("a", "domain") != "")).alias("same_company_domain"))
    s = F.col("name_similarity") * 0.3 + F.col("email_similarity") * 0.2 + F.col("company_similarity") * 0.3 + F.col("title_similarity") * 0.2
    return f.withColumn("similarity_score", s).withColumn("label", F.when(F.col("similarity_score") > 0.7, "similar").otherwise("different"))


# ---- entity resolution ------------------------------------------------------------------------------------------


#: The scan by itself takes .85; detection and its stored and reported forms take .8.
DETECTION = 0.8


def groups(t, threshold=0.85):
    return ER.duplicate_groups(nested(t), threshold, "owner_id")


@query("er_1")
def er_1(t):
    """Scores every lead against the next one in id order; the planted copies are neighbours."""
    p = cut_lineage(ER.profiles(nested(t)))
    a = p.select("id", F.struct("id", *ER.FIELDS).alias("a"))
    b = p.select((F.col("id") - 1).alias("id"), F.struct("id", *ER.FIELDS).alias("b"))
    return ER.score_pairs(a.join(b, "id")).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), F.array_join("matching_fields", ",").alias("matching_fields"))


@query("er_2")
def er_2(t):
    return groups(t).withColumn("matching_fields", F.array_join("matching_fields", ","))


@query("jn_12")
def jn_12(t):
    return groups(t).select("primary_lead_id", "duplicate_lead_id", F.round("score", 6).alias("score"))


@query("er_3")
def er_3(t):
    g = cut_lineage(groups(t))
    rec = g.groupBy("primary_lead_id").agg(F.count(F.when(ER.merge_recommendation() == "auto_merge", 1)).alias("auto_merge"))
    return ER.merge_strategies(g).join(rec, "primary_lead_id")


@query("er_4", ["leads"], """SELECT primary_lead_id, id AS duplicate_lead_id FROM (SELECT id, lower(email) AS e FROM leads WHERE email <> '') JOIN (SELECT lower(email) AS e2, min(id) AS primary_lead_id FROM leads WHERE email <> '' GROUP BY 1) ON e = e2 WHERE id <> primary_lead_id""")
def er_4(t):
    return ER.same_email(t.leads(dates=False))


DUPS = """dup AS (SELECT primary_lead_id, id AS duplicate_lead_id, 60 + (id * 7) % 41 AS match_score, (id * 7) % 41 >= 35 AS auto_merge_recommended, CASE id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'merged' ELSE 'rejected' END AS status,
 TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY * (id % 30) AS detected_at FROM (SELECT id, lower(email) AS e FROM leads WHERE email <> '') JOIN (SELECT lower(email) AS e2, min(id) AS primary_lead_id FROM leads WHERE email <> '' GROUP BY 1) ON e = e2 WHERE id <> primary_lead_id)"""


def duplicates(t):
    d = ER.same_email(t.leads(dates=False))
    i = F.col("duplicate_lead_id")
    return d.withColumns({"match_score": 60 + (i * 7) % 41, "auto_merge_recommended": (i * 7) % 41 >= 35, "status": F.when(i % 3 == 0, "pending").when(i % 3 == 1, "merged").otherwise("rejected"),
                          "detected_at": F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - make_dt_interval(CAST(duplicate_lead_id % 30 AS INT))")})


DJ = "dup d JOIN leads l ON d.primary_lead_id = l.id"


@query("jn_5", ["leads"], f", {DUPS} SELECT owner_id, primary_lead_id, duplicate_lead_id FROM {DJ}")
def jn_5(t):
    return A.owned(duplicates(t), t.leads(dates=False), "primary_lead_id").select("owner_id", "primary_lead_id", "duplicate_lead_id")


@query("agg_22", ["leads"], f", {DUPS} SELECT owner_id, count(*) AS total_duplicates, count(*) FILTER (WHERE auto_merge_recommended) AS auto_merge_candidates, round(avg(match_score), 6) AS average_match_score, count(*) FILTER (WHERE detected_at >= TIMESTAMP '2024-01-24') AS recent_detections FROM {DJ} GROUP BY 1")
def agg_22(t):
    return A.duplicate_summary(duplicates(t), t.leads(dates=False), EVENTS_AS_OF)


@query("agg_23", ["leads"], f", {DUPS} SELECT owner_id, d.status, count(*) AS count FROM {DJ} GROUP BY ALL")
def agg_23(t):
    return A.count_by(A.owned(duplicates(t), t.leads(dates=False), "primary_lead_id"), "owner_id", "status")


@query("agg_24", ["leads"], f", {DUPS} SELECT owner_id, CASE WHEN match_score >= 95 THEN 'very_high' WHEN match_score >= 85 THEN 'high' WHEN match_score >= 75 THEN 'medium' ELSE 'low' END AS score_tier, count(*) AS count FROM {DJ} GROUP BY ALL")
def agg_24(t):
    from ..functions.exprs import tiers

    return A.count_by(A.owned(duplicates(t), t.leads(dates=False), "primary_lead_id"), "owner_id", tiers(F.col("match_score"), A.MATCH_BANDS, "low").alias("score_tier"))


@query("agg_30", ["leads", "predictions", "quality_scores", "processing_log"], f""", {DUPS},
 o AS (SELECT user_id AS owner_id, count(*) AS ops, sum(processing_duration_ms) AS tm FROM processing_log WHERE processing_status = 'completed' GROUP BY 1), n AS (SELECT owner_id, count(DISTINCT lead_id) AS la FROM predictions p JOIN leads l ON p.lead_id = l.id GROUP BY 1),
 q AS (SELECT owner_id, round(avg(overall_score), 6) AS aq, count(*) AS qa, count(*) FILTER (WHERE overall_score >= 80) AS hq FROM quality_scores q JOIN leads l ON q.lead_id = l.id GROUP BY 1),
 a AS (SELECT owner_id, round(count(*) FILTER (WHERE status = 'converted') * 100.0::DOUBLE / count(*), 6) AS ac FROM predictions p JOIN leads l ON p.lead_id = l.id WHERE l.created_at IS NOT NULL GROUP BY 1),
 b AS (SELECT owner_id, round(count(*) FILTER (WHERE status = 'converted') * 100.0::DOUBLE / count(*), 6) AS nc FROM leads WHERE created_at IS NOT NULL AND id NOT IN (SELECT lead_id FROM predictions) GROUP BY 1),
 dd AS (SELECT owner_id, count(*) AS dn FROM {DJ} GROUP BY 1), tt AS (SELECT owner_id, count(created_at) AS nl FROM leads GROUP BY 1)
SELECT tt.owner_id, round((coalesce(la, 0) * 300000.0::DOUBLE - coalesce(tm, 0)) / 3600000, 6) AS time_saved_hours, round((coalesce(la, 0) * 300000.0::DOUBLE - coalesce(tm, 0)) / 3600000 * 50, 6) AS estimated_cost_savings, coalesce(la, 0) AS leads_analyzed_by_ai, coalesce(dn, 0) AS duplicates_detected,
 coalesce(hq, 0) AS high_quality_leads, round(coalesce(la, 0) * 300000.0::DOUBLE / greatest(coalesce(tm, 0), 1), 6) AS manual_vs_ai_time_ratio, round(coalesce(tm, 0) / greatest(coalesce(ops, 0), 1), 6) AS average_processing_time_ms, round(coalesce(la, 0) * 100.0::DOUBLE / greatest(nl, 1), 6) AS automation_coverage_percent,
 coalesce(aq, 0) AS average_data_quality, coalesce(qa, 0) AS quality_assessments, coalesce(ac, 0) AS ai_conversion_rate, coalesce(nc, 0) AS non_ai_conversion_rate, round(coalesce(ac, 0) - coalesce(nc, 0), 6) AS conversion_improvement
FROM tt LEFT JOIN o ON o.owner_id = tt.owner_id LEFT JOIN n ON n.owner_id = tt.owner_id LEFT JOIN q ON q.owner_id = tt.owner_id LEFT JOIN a ON a.owner_id = tt.owner_id LEFT JOIN b ON b.owner_id = tt.owner_id LEFT JOIN dd ON dd.owner_id = tt.owner_id""")
def agg_30(t):
    return A.roi(t.leads(), t.predictions(), t.quality_scores(), t.processing_log(), duplicates(t), EVENTS_AS_OF, 12000)


SIMILAR = """, ref AS (SELECT owner_id, id AS ref_id, vector AS rv FROM (SELECT f.owner_id, f.id, f.vector, row_number() OVER (PARTITION BY f.owner_id ORDER BY f.score DESC, f.id) AS rn FROM fea f) WHERE rn = 1)
SELECT ref_id AS reference_id, id AS lead_id, s AS similarity_score, rank FROM (SELECT ref_id, f.id, s, row_number() OVER (PARTITION BY ref_id ORDER BY s DESC, f.id) AS rank FROM
 (SELECT ref_id, f.id, round(greatest(0, least(1, list_cosine_similarity(rv, f.vector))), 6) AS s FROM fea f JOIN ref ON ref.owner_id = f.owner_id WHERE f.id <> ref_id) f WHERE s >= 0.7) f WHERE rank <= 10"""


def similar(t, k=10):
    """Reference per owner: the best stored score, lowest id on ties."""
    f = cut_lineage(feats(t).select("id", "owner_id", "score", feature_struct().alias("c")))
    refs = f.groupBy("owner_id").agg(F.max_by("c", F.struct("score", -F.col("id"))).alias("r"))
    return ER.similar_to_references(refs, f.select("owner_id", "c"), "owner_id", X.cosine("c.vector", "r.vector"), 0.7, k)


@query("er_5", BASE, SIMILAR, XF)
def er_5(t):
    return similar(t).select(F.col("r.id").alias("reference_id"), F.col("c.id").alias("lead_id"), "similarity_score", F.col("rank").cast("bigint").alias("rank"))


@query("jn_13", BASE, SIMILAR, XF)
def jn_13(t):
    return similar(t).select(F.col("r.id").alias("reference_id"), F.col("c.id").alias("lead_id"), "similarity_score", F.col("rank").cast("bigint").alias("rank"))


@query("srt_7", BASE, SIMILAR + " ORDER BY reference_id, rank", XF)
def srt_7(t):
    return similar(t).select(F.col("r.id").alias("reference_id"), F.col("c.id").alias("lead_id"), "similarity_score", F.col("rank").cast("bigint").alias("rank")).orderBy("reference_id", "rank")


@query("er_6", BASE, f"SELECT reference_id AS lead_id_1, lead_id AS lead_id_2, similarity_score, round(similarity_score * 100, 4) AS business_relevance, 'reference' AS similarity_type FROM sim", {**XF, "ref": "SELECT owner_id, id AS ref_id, vector AS rv FROM (SELECT f.owner_id, f.id, f.vector, row_number() OVER (PARTITION BY f.owner_id ORDER BY f.score DESC, f.id) AS rn FROM fea f) WHERE rn = 1",
      "sim": SIMILAR[SIMILAR.index("SELECT ref_id AS reference_id"):]})
def er_6(t):
    s = similar(t)
    return s.select(F.col("r.id").alias("lead_id_1"), F.col("c.id").alias("lead_id_2"), "similarity_score", F.round(F.col("similarity_score") * 100, 4).alias("business_relevance"), F.lit("reference").alias("similarity_type"))


PAIRS = """SELECT id1, id2, score FROM (SELECT a.vec_id AS id1, b.vec_id AS id2, round(greatest(0, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE score >= {} ORDER BY score DESC, id1, id2 LIMIT 20"""


def embedding_pairs(t, threshold):
    return ER.top_similar_pairs(t.raw("embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("vector")), 20, threshold)


@query("er_7_vectors", [], PAIRS.format(0.3))
def er_7_vectors(t):
    """The same on the raw vectors of a table."""
    return embedding_pairs(t, 0.3)


MATCHING = lines(*[when(f"abs(a.{f} - b.{f}) < {tol}", n) for n, f, tol in [
    ("email_quality", "email_quality_score", 20), ("seniority_level", "seniority_score", 25), ("industry_sector", "industry_relevance", 20), ("company_size", "company_size_score", 20), ("geographic_region", "location_score", 25)]],
    when("abs(a.methods - b.methods) <= 1", "contact_completeness"), sep=",")
LEAD_PAIRS = f"""(SELECT p.id1, p.id2, p.score, {MATCHING} AS matching FROM
 (SELECT id1, id2, score FROM (SELECT a.id AS id1, b.id AS id2, round(greatest(0, least(1, list_cosine_similarity(a.vector, b.vector))), 6) AS score FROM fea a JOIN fea b ON a.id < b.id) WHERE score >= 0.7 ORDER BY score DESC, id1, id2 LIMIT 20) p
 JOIN fea a ON a.id = p.id1 JOIN fea b ON b.id = p.id2)"""


def lead_pairs(t):
    """The twenty most similar pairs of leads by their feature vectors, and what they have in common."""
    rows = with_company(spread(t.leads(), "id"), t.companies())
    f = cut_lineage(X.with_features(rows, AS_OF).select("id", feature_struct().alias("a")))
    pairs = ER.top_similar_pairs(f.select("id", "a.vector"), 20, 0.7, tile_rows=512)
    both = pairs.join(f.withColumnRenamed("id", "id1"), "id1").join(f.select(F.col("id").alias("id2"), F.col("a").alias("b")), "id2")
    return both.select("id1", "id2", "score", F.array_join(X.matching_features("a", "b"), ",").alias("matching"))


@query("er_7", BASE, f"SELECT * FROM {LEAD_PAIRS}", XF)
def er_7(t):
    return lead_pairs(t)


@query("jn_11", BASE, f"SELECT id1, id2, score FROM {LEAD_PAIRS}", XF)
def jn_11(t):
    return lead_pairs(t).select("id1", "id2", "score")


@query("srt_8", BASE, f"SELECT id1, id2, score, row_number() OVER (ORDER BY score DESC, id1, id2) AS rank FROM {LEAD_PAIRS}", XF)
def srt_8(t):
    """Twenty rows, so the window over all of them is small."""
    return lead_pairs(t).select("id1", "id2", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id1", "id2")).cast("bigint").alias("rank"))


@query("snk_16", BASE, f"SELECT id1 AS lead_id_1, id2 AS lead_id_2, score AS similarity_score, matching AS matching_features, 0.8::DOUBLE AS confidence, round(score * 100, 4) AS business_relevance FROM {LEAD_PAIRS}", XF)
def snk_16(t):
    return lead_pairs(t).select(F.col("id1").alias("lead_id_1"), F.col("id2").alias("lead_id_2"), F.col("score").alias("similarity_score"), F.col("matching").alias("matching_features"), F.lit(0.8).alias("confidence"), F.round(F.col("score") * 100, 4).alias("business_relevance"))


@query("er_8")
def er_8(t):
    return groups(t, DETECTION).select("primary_lead_id", "duplicate_lead_id", F.when(F.col("confidence") >= 0.95, "auto_merge").otherwise("manual_review").alias("decision"))


@query("snk_17")
def snk_17(t):
    return ER.duplicate_records(groups(t, DETECTION), EVENTS_AS_OF)


@query("agg_53")
def agg_53(t):
    """Totals per primary; the id lists of the report are the rows of ``er_8``."""
    c = F.col("confidence")
    return groups(t, DETECTION).groupBy("primary_lead_id").agg(F.count("*").alias("total_duplicates"), A.n_if(c >= 0.95).alias("auto_merge"), A.n_if(c < 0.95).alias("manual_review"), F.round(F.avg("confidence"), 6).alias("group_confidence"))


@query("pri_17", BASE, f"SELECT r.id, round(r.overall_score, 6) AS overall_score, coalesce(n, 0) AS similar_leads FROM report r LEFT JOIN (SELECT reference_id, count(*) AS n FROM (SELECT * FROM sim WHERE rank <= 5) GROUP BY 1) s ON s.reference_id = r.id",
       {**QX, "fea": FEA, "ref": "SELECT owner_id, id AS ref_id, vector AS rv FROM (SELECT f.owner_id, f.id, f.vector, row_number() OVER (PARTITION BY f.owner_id ORDER BY f.score DESC, f.id) AS rn FROM fea f) WHERE rn = 1", "sim": SIMILAR[SIMILAR.index("SELECT ref_id AS reference_id"):]})
def pri_17(t):
    from ..functions.quality import assess

    near = similar(t, 5).groupBy(F.col("r.id").alias("id")).agg(F.count("*").alias("similar_leads"))
    q = assess(nested(t), AS_OF).select("id", F.round("overall_score", 6).alias("overall_score"))
    return q.join(near, "id", "left").withColumn("similar_leads", F.coalesce("similar_leads", F.lit(0)))


_ = (W, REPORT)
