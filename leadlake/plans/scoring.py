"""Registered lead-score and priority queries (SCR-*, PRI-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import priority as PR
from ..functions import rules as R
from ..functions import score as S
from ..functions.record import drop_work, prepare, with_company
from ..operators import ranking as W
from ..session import cut_lineage
from ..sources.bindings import AS_OF
from .registry import query
from .sqltext import BASE, case, ends, has, lines, lit, one_of, pts, when
from .sqltext import W as WORK


def nested(t):
    return with_company(t.leads(), t.companies())


def parts(t):
    return S.with_parts(nested(t), AS_OF)


wt = R.SCORE_WEIGHTS
label = "split_part(co_domain, '.', 1)"
D1, D2, D3 = (R.DOMAIN_TIERS[k] for k in ("tier_1", "tier_2", "tier_3"))
EMAIL_DOMAIN = (pts(one_of("lower(domain)", R.SCORE_FREE_DOMAINS), -8, 5) + "+" + case([(ends("domain", D1), 8), (ends("domain", D2), 5), (ends("domain", D3), 2)], 0)
                + "+" + pts("length(split_part(domain, '.', 1)) >= 8", 2))
EMAIL = pts("email <> ''", "greatest(0, 25 + " + pts(f"regexp_matches(email_l, {lit(R.PROFESSIONAL_MAILBOX)})", 8) + "+"
            + case([(f"contains(email_l, '{g}')", -15 if g in R.HARSH_MAILBOXES else -10) for g in R.GENERIC_MAILBOXES], 0)
            + f"+ (CASE WHEN domain <> '' THEN {EMAIL_DOMAIN} ELSE 0 END) + " + case([("length(email) > 50", -3), ("length(email) < 10", -5)], 0)
            + "+" + pts("regexp_matches(email, '[0-9]{3,}')", -3) + ")")
CONTACT = (pts("phone <> ''", "(15 + " + pts("length(phone_d) >= 10", 3) + "+" + pts("starts_with(phone, '+')", 2) + ")") + "+"
           + pts("linkedin <> ''", "(20 + " + case([("contains(linkedin_l, 'linkedin.com/in/')", 8), ("contains(linkedin_l, 'linkedin.com/company/')", 5), ("contains(linkedin_l, 'linkedin.com')", 3)], 0)
                 + "+" + pts("contains(linkedin, '/in/') AND NOT regexp_matches(linkedin, '/in/[a-z]+-[a-z]+-\\w{8}')", 4) + ")"))
TITLE = pts("title <> ''", "(" + case([
    (has("title", R.EXECUTIVE_TITLES), "60 + " + pts(has("title", ["ceo", "founder", "president", "managing partner"]), 15)),
    (has("title", R.SENIOR_TITLES), "45 + " + pts(has("title", ["vp", "vice president"]), 8)),
    (has("title", R.MANAGER_TITLES), "28 + " + pts(has("title", ["senior", "lead", "principal"]), 6))], "14 + " + pts(has("title", ["senior", "principal", "lead"]), 10))
    + "+" + pts(has("title", R.VALUED_FUNCTIONS), 5.5) + "+" + case([("title_words >= 4", 5), ("title_words >= 3", 2.5)], 0) + ")")
SENIORITY = case([("title = ''", "NULL"), (has("title", R.EXECUTIVE_TITLES), "'executive'"), (has("title", R.SENIOR_TITLES), "'senior'"), (has("title", R.MANAGER_TITLES), "'manager'")], "'individual'")
INDUSTRY = case([("co_industry = ''", "0"),
                 (has("co_industry", R.INDUSTRY_TIERS["tier_1"]), "40 + " + pts(has("co_industry", ["ai", "artificial intelligence", "machine learning", "ml"]), 12) + "+" + pts(has("co_industry", ["fintech", "financial technology"]), 10)),
                 (has("co_industry", R.INDUSTRY_TIERS["tier_2"]), "30 + " + pts(has("co_industry", ["saas", "software as a service"]), 8)),
                 (has("co_industry", R.INDUSTRY_TIERS["tier_3"]), "25")], "10 + " + pts(has("co_industry", R.STABLE_INDUSTRIES), 3)) + "::DOUBLE"
SIZE = pts("co_size <> ''", "(" + case([(f"contains(co_size, '{k}')", f"15 * {m}::DOUBLE") for k, m in R.SIZE_MULTIPLIERS.items()], "15 * 0.6::DOUBLE") + "+"
           + pts(has("co_size", ["1-10", "11-50"]) + " AND " + has("co_industry", ["ai", "fintech", "saas", "blockchain"]), 8) + ")")
LOCATION = pts("co_location <> ''", "(" + case([(has("co_location", R.LOCATION_TIERS["tier_1"]), 22), (has("co_location", R.LOCATION_TIERS["tier_2"]), 16), (has("co_location", R.LOCATION_TIERS["tier_3"]), 12),
                                                (has("co_location", R.ENGLISH_COUNTRIES), 8), (has("co_location", R.EU_COUNTRIES), 7)], 4) + "+" + pts(has("co_location", ["remote", "distributed"]), 5) + ")")
DOMAIN = pts("co_domain <> ''", "(" + case([(ends("co_domain", D1), 23), (ends("co_domain", D2), 18), (ends("co_domain", D3), 15)], 6) + "+"
             + case([(f"length({label}) BETWEEN 3 AND 10", 6), (f"length({label}) BETWEEN 11 AND 15", 3), (f"length({label}) > 25", -4)], 0) + "+" + pts(f"regexp_matches({label}, '[0-9]')", -3)
             + "+" + pts(f"contains({label}, '-')", -2) + "+" + pts(f"length({label}) <= 12 AND regexp_matches({label}, '^\\p{{L}}+$')", 4) + ")")
MATURITY = ("least(15, " + pts("co_website <> ''", 3) + "+" + pts("starts_with(co_website, 'https://')", 2) + "+"
            + pts("length(co_description) > 50", "(4 + " + pts(has("co_description", R.PROFESSIONAL_TERMS), 2) + ")") + "+ co_social * 1.5::DOUBLE)")
GROWTH = pts("co_revenue <> ''", "(5 + " + pts(has("co_revenue", R.REVENUE_MARKS), 8) + ")") + "+" + pts(has("co_description", R.FUNDING_MARKS), 6) + "+ least(co_tech * 0.5::DOUBLE, 5)"
COMPANY = f"(CASE WHEN has_company THEN {INDUSTRY} + {SIZE} + {LOCATION} + {DOMAIN} + {MATURITY} + {GROWTH} ELSE 0 END)::DOUBLE"
ALPHA = lambda c: f"regexp_matches(regexp_replace({c}, '[-'']', '', 'g'), '^\\p{{L}}+$')"
SINGLE = "(CASE WHEN fn <> '' THEN fn ELSE ln END)"
NAME = ("(CASE WHEN fn = '' AND ln = '' THEN 0 ELSE greatest(0, (CASE WHEN fn <> '' AND ln <> '' THEN 10 + "
        + pts(f"length(fn) BETWEEN 2 AND 20 AND length(ln) BETWEEN 2 AND 25 AND {ALPHA('fn')} AND {ALPHA('ln')}", "(6 + " + pts("length(fn) BETWEEN 3 AND 12 AND length(ln) BETWEEN 3 AND 15", 3) + ")")
        + " ELSE 6 + " + pts(f"length({SINGLE}) >= 2 AND {ALPHA(SINGLE)}", 2) + " END) + " + pts(has("lower(fn || ' ' || ln)", R.FAKE_NAME_WORDS), -10) + ") END)::DOUBLE")
SOURCE = (case([(f"source = '{k}'", f"8 * {m}::DOUBLE") for k, m in R.SOURCE_MULTIPLIERS.items()], "8") + "+" + case([(f"source = '{k}'", v) for k, v in R.SOURCE_EXTRA.items()], 0))
FRESH = "(5 + " + case([("age IS NULL", 0), ("age <= 7", 5), ("age <= 30", 3), ("age <= 90", 1)], -2) + ")::DOUBLE"
SOCIAL = "least(8, " + "+".join(pts(f"{c} <> ''", v) for c, v in (("linkedin", 3), ("twitter", 2), ("github", 2), ("facebook", 2))) + "+ co_social * 1.5::DOUBLE)"
ENGAGE = "least(20, methods * 3 + " + pts(has("title", R.DECISION_WORDS), 5) + "+" + case([(has("co_size", ["1-10", "11-50"]), 4), ("contains(co_size, '51-200')", 6)], 0) + ")::DOUBLE"
INTENT = "(" + has("title", R.INTENT_TITLES) + " OR " + has("co_description", R.GROWTH_WORDS) + ")"
PROFILE = "(email <> '' AND NOT " + has("email", ["gmail", "yahoo", "hotmail"]) + " AND linkedin <> '' AND phone <> '')"
SUCCESS = ("(" + has("co_industry", ["technology", "software", "saas"]) + "::INT + " + has("title", ["director", "vp", "head", "chief"])
           + "::INT + (email <> '' AND phone <> '' AND linkedin <> '')::INT + " + has("co_size", ["51-200", "201-500"]) + "::INT >= 3)")
RISK = "(" + has("email", ["info@", "contact@", "admin@"]) + "::INT + (fn = '' OR ln = '')::INT + (co_domain <> '' AND (length(co_domain) > 30 OR " + has("co_domain", ["_", "%"]) + "))::INT >= 2)"
AI = pts(INTENT, 8) + "+" + pts(f"(part_email > 20 AND part_contact > 15) OR {PROFILE}", 6) + "+" + pts(SUCCESS, 10) + "+" + pts(RISK, -5)
TREND = case([(f"contains(co_industry, '{k}')", v) for k, v in R.INDUSTRY_TRENDS.items()], 0)
PART_SQL = {"email": EMAIL, "contact": CONTACT, "title": TITLE, "company": COMPANY, "name": NAME, "source": SOURCE, "freshness": FRESH, "social": SOCIAL, "engagement": ENGAGE}
PARTS = f"SELECT *, {', '.join(f'{v} AS part_{k}' for k, v in PART_SQL.items())} FROM w"
SUM = " + ".join(f"part_{k}" for k in PART_SQL)


def total(extra: str = "0") -> str:
    return (f"CASE WHEN raw_title IS NULL OR raw_source IS NULL THEN 50.0::DOUBLE ELSE round(greatest(5, least(95, (({SUM} + {extra} + {AI} + {TREND}) / 258::DOUBLE) * 100)), 1) END")


SCORED = f"SELECT *, {total()} AS lead_score FROM parts"
X = {"w": WORK, "parts": PARTS, "scored": SCORED}
XW = {"w": WORK}
XP = {"w": WORK, "parts": PARTS}
AGG = "SELECT id, {} FROM {}"

for key, part in [("scr_1", "email"), ("scr_3", "contact"), ("scr_4", "title"), ("scr_12", "company"), ("scr_13", "name"), ("scr_14", "source"), ("scr_15", "freshness"), ("scr_16", "social"), ("scr_17", "engagement")]:
    query(key, BASE, f"SELECT id, {PART_SQL[part]} AS score FROM w", XW)(
        lambda t, part=part: parts(t).select("id", F.col(f"part_{part}").alias("score")))

CFG = S.ScoringConfig()
for key, fn, sql in [
    ("scr_2", lambda: F.when(F.col("w_domain") != "", S.email_domain_score()), f"CASE WHEN domain <> '' THEN ({EMAIL_DOMAIN})::DOUBLE END"),
    ("scr_5", S.seniority_level, SENIORITY), ("scr_6", lambda: S.industry_score(CFG), INDUSTRY), ("scr_7", lambda: S.company_size_score(CFG), SIZE),
    ("scr_8", lambda: S.location_score(CFG), LOCATION), ("scr_9", lambda: S.domain_quality_score(CFG), DOMAIN), ("scr_10", S.company_maturity_score, MATURITY),
    ("scr_11", S.company_growth_score, GROWTH),
]:
    query(key, BASE, f"SELECT id, {sql} AS score FROM w", XW)(lambda t, fn=fn: prepare(nested(t), AS_OF).select("id", fn().alias("score")))


def with_campaign(t):
    c = t.campaigns().select(F.col("id").alias("campaign_id"), "campaign_type", "urgent",
                             F.array_compact(F.array("target_region")).alias("target_regions"), F.array_compact(F.array("target_industry")).alias("target_industries"))
    return nested(t).join(c, "campaign_id", "left")


CONTEXT = ("(" + case([(f"campaign_type = 'enterprise' AND ({has('co_size', R.ENTERPRISE_SIZES)} OR {has('title', R.ENTERPRISE_TITLES)})", 10), (f"campaign_type = 'smb' AND {has('co_size', R.SMB_SIZES)}", 8)], 0)
           + "+" + pts("contains(co_location, lower(target_region))", 5) + "+" + pts("contains(co_industry, lower(target_industry))", 8) + "+" + pts("urgent AND phone <> '' AND email <> ''", 6) + ")")
JOINED = "parts p LEFT JOIN (SELECT id AS cid, campaign_type, target_region, target_industry, urgent FROM campaigns) c ON p.campaign_id = c.cid"


@query("scr_18", BASE + ["campaigns"], f"SELECT id, {CONTEXT} AS adjustment, {total(CONTEXT)} AS lead_score FROM {JOINED}", XP)
def scr_18(t):
    scored = S.with_parts(with_campaign(t), AS_OF).withColumn("adjustment", S.context_adjustment())
    return scored.select("id", "adjustment", S.total_score(AS_OF, CFG, True).alias("lead_score"))


@query("scr_19", BASE, f"SELECT id, {AI} AS adjustment, {INTENT} AS high_intent, {SUCCESS} AS successful, {RISK} AS risky FROM parts", XP)
def scr_19(t):
    return parts(t).select("id", S.enhancement(F.col("part_email"), F.col("part_contact")).alias("adjustment"), S.high_intent().alias("high_intent"),
                           S.successful_pattern().alias("successful"), S.risk_factors().alias("risky"))


@query("scr_20", BASE, f"SELECT id, {TREND}::DOUBLE AS industry_bonus, 0.0::DOUBLE AS timing_bonus FROM w", XW)
def scr_20(t):
    return prepare(nested(t), AS_OF).select("id", S.industry_bonus().alias("industry_bonus"), F.lit(S.timing_bonus(AS_OF)).alias("timing_bonus"))


@query("scr_21")
def scr_21(t):
    return S.with_lead_score(nested(t), AS_OF, S.ScoringConfig(jitter_salt="salt")).select("id", "lead_score")


@query("scr_22", BASE, "SELECT id, lead_score FROM scored", X)
def scr_22(t):
    return S.with_lead_score(nested(t), AS_OF).select("id", "lead_score")


@query("scr_23", BASE, f"SELECT id, ({has('co_size', R.ENTERPRISE_SIZES)} OR {has('title', R.ENTERPRISE_TITLES)}) AS enterprise, {has('co_size', R.SMB_SIZES)} AS smb FROM w", XW)
def scr_23(t):
    return prepare(nested(t), AS_OF).select("id", S.is_enterprise().alias("enterprise"), S.is_smb().alias("smb"))


TIER = case([(f"lead_score >= {b}", lit(n)) for b, n in R.SCORE_TIERS], "'Poor'")


@query("scr_24", BASE, f"SELECT id, {TIER} AS quality_tier FROM scored", X)
def scr_24(t):
    return S.with_lead_score(nested(t), AS_OF).select("id", S.score_tier(F.col("lead_score")).alias("quality_tier"))


FACTORS = lines(
    when("email <> '' AND (contains(email, '.') OR contains(email, '_')) AND has_at", "✅ Professional email format"),
    "CASE WHEN methods >= 2 THEN '✅ Multiple contact methods available (' || methods || '/3)' END",
    case([(has("title", ["ceo", "cto", "founder", "president"]), lit("🌟 Executive-level contact")), (has("title", ["director", "vp", "head"]), lit("✅ Senior decision maker"))], "NULL"),
    when(has("co_industry", ["ai", "saas", "fintech", "technology"]), "🚀 High-value industry sector"),
    case([(has("co_size", ["51-200", "201-500", "501-1000"]), lit("🎯 Optimal company size for B2B")), ("contains(co_size, '1-10')", lit("⚡ Startup - potentially agile decision making"))], "NULL"),
    when(has("co_location", ["san francisco", "new york", "london", "seattle"]), "🌆 Located in major business hub"),
    "CASE WHEN complete > 80 THEN '📋 High data completeness (' || complete || '%)' END",
    "CASE WHEN raw_source IN ('linkedin', 'referral', 'event') THEN '✅ High-quality source: ' || raw_source END")
RECS = lines(
    case([("email = ''", lit("🔍 Find email address to increase engagement potential")), ("NOT ((contains(email, '.') OR contains(email, '_')) AND has_at)", lit("🎯 Verify email format and deliverability"))], "NULL"),
    when("methods < 2", "📞 Gather additional contact information"), when("title = ''", "💼 Identify job title for better targeting"),
    when("complete < 60", "📊 Enrich lead data for better insights"), when("raw_source IN ('purchased', 'import')", "🔍 Verify lead authenticity and interest"),
    when(INTENT, "🤖 AI detected high purchase intent - prioritize for immediate contact"), when(f"NOT {PROFILE}", "🤖 AI suggests data enrichment to improve lead quality"),
    lit("🤖 AI recommends contacting during business hours (9-17 UTC)"),
    case([(has("co_industry", ["ai", "machine learning"]), lit("🤖 AI industry lead - emphasize technical capabilities")), ("contains(co_industry, 'fintech')", lit("🤖 Fintech lead - highlight security and compliance features"))], "NULL"))


@query("scr_25", BASE, f"SELECT id, {FACTORS} AS factors, {RECS} AS recommendations FROM w", XW)
def scr_25(t):
    p = prepare(nested(t), AS_OF)
    return p.select("id", F.array_join(S.factors(), " | ").alias("factors"), F.array_join(S.recommendations(AS_OF, CFG), " | ").alias("recommendations"))


@query("scr_26", BASE, "SELECT id, complete AS completeness FROM w", XW)
def scr_26(t):
    return prepare(nested(t), AS_OF).select("id", S.completeness_percent().alias("completeness"))


IMPUTED_LEADS = ("SELECT * REPLACE (" + ", ".join(f"CASE WHEN coalesce({c}, '') = '' THEN {lit(v)} ELSE {c} END AS {c}" for c, v in S.IMPUTED.items()) + ") FROM leads")
X2 = {**X, "leads2": IMPUTED_LEADS, "w2": WORK.replace("FROM leads l", "FROM leads2 l"), "parts2": PARTS.replace("FROM w", "FROM w2"), "scored2": SCORED.replace("FROM parts", "FROM parts2")}


@query("scr_27", BASE, "SELECT a.id, a.lead_score, round(b.lead_score - a.lead_score, 1) AS improvement_potential FROM scored a JOIN scored2 b ON a.id = b.id", X2)
def scr_27(t):
    return S.with_improvement_potential(nested(t), AS_OF).select("id", "lead_score", "improvement_potential")


@query("scr_28", BASE, f"""SELECT a.id, a.lead_score AS total_score, {TIER.replace('lead_score', 'a.lead_score')} AS quality_tier, round(b.lead_score - a.lead_score, 1) AS improvement_potential,
 f.factors, f.recommendations, a.part_email, a.part_company FROM scored a JOIN scored2 b ON a.id = b.id JOIN (SELECT id, {FACTORS} AS factors, {RECS} AS recommendations FROM w) f ON f.id = a.id""", X2)
def scr_28(t):
    e = S.with_explanation(nested(t), AS_OF)
    x = F.col("score_explanation")
    return e.select("id", x.total_score.alias("total_score"), x.quality_tier.alias("quality_tier"), x.improvement_potential.alias("improvement_potential"),
                    F.array_join(x.factors, " | ").alias("factors"), F.array_join(x.recommendations, " | ").alias("recommendations"),
                    x.score_breakdown.email.alias("part_email"), x.score_breakdown.company.alias("part_company"))


@query("scr_29", BASE, """SELECT id, lead_score AS score, row_number() OVER (ORDER BY lead_score DESC, id) AS batch_rank,
 round((1 - (row_number() OVER (ORDER BY lead_score DESC, id) - 1)::DOUBLE / count(*) OVER ()) * 100, 1) AS percentile, lead_score >= 70 AS explained FROM scored""", X)
def scr_29(t):
    ranked = W.rank_scored(S.with_lead_score(nested(t), AS_OF, name="score"))
    return ranked.withColumn("explained", F.col("score") >= 70)


@query("agg_45", BASE, f"""
, c AS (SELECT avg(lead_score) AS m, count(*) FILTER (WHERE {has('title', R.EXECUTIVE_TITLES)}) / count(*)::DOUBLE AS execs, avg(methods) AS contacts FROM scored),
r AS (SELECT *, rank() OVER (ORDER BY lead_score) - 1 AS better_count, (rank() OVER (ORDER BY lead_score) - 1) * 100.0::DOUBLE / count(*) OVER () AS pr FROM scored)
SELECT id, lead_score, round(pr, 6) AS percentile_rank, CASE WHEN pr >= 95 THEN 'Top 5%' WHEN pr >= 90 THEN 'Top 10%' WHEN pr >= 75 THEN 'Top 25%' WHEN pr >= 50 THEN 'Top 50%' ELSE 'Bottom 50%' END AS ranking_tier,
 better_count, round(lead_score - m, 6) AS score_vs_average,
 {lines(f"CASE WHEN {has('title', R.EXECUTIVE_TITLES)} AND execs < 0.3 THEN 'Executive-level title (rare in comparison set)' END", when(has('co_industry', R.INDUSTRY_TIERS['tier_1']), 'High-value industry sector'), "CASE WHEN methods > contacts THEN 'Above-average contact information completeness' END")} AS advantages,
 {lines("CASE WHEN pr >= 90 THEN 'Excellent lead - prioritize for immediate outreach' WHEN pr >= 75 THEN 'High-quality lead - include in priority campaign' WHEN pr >= 50 THEN 'Good lead - suitable for standard outreach' ELSE 'Consider data enrichment before outreach' END", when('lead_score < 60', 'Below average score - verify lead quality before investment'))} AS recommendations
FROM r, c""", X)
def agg_45(t):
    from ..functions.exprs import any_in, compact, say, tiers
    from ..functions.record import w

    ex, tier1 = any_in(w("title"), R.EXECUTIVE_TITLES), any_in(w("co_industry"), R.INDUSTRY_TIERS["tier_1"])
    rows = cut_lineage(S.with_lead_score(nested(t), AS_OF, keep_parts=True).select("id", "lead_score", ex.alias("is_exec"), tier1.alias("hot"), w("methods").alias("methods")))
    means = rows.agg(F.avg("lead_score").alias("m"), (F.count(F.when(F.col("is_exec"), 1)) / F.count("*")).alias("execs"), F.avg("methods").alias("contacts"))
    r = W.percent_below(rows, "lead_score").crossJoin(means)
    p = F.col("percentile_rank")
    adv = compact(say(F.col("is_exec") & (F.col("execs") < 0.3), "Executive-level title (rare in comparison set)"), say(F.col("hot"), "High-value industry sector"),
                  say(F.col("methods") > F.col("contacts"), "Above-average contact information completeness"))
    rec = compact(tiers(p, [(90, "Excellent lead - prioritize for immediate outreach"), (75, "High-quality lead - include in priority campaign"), (50, "Good lead - suitable for standard outreach")],
                        "Consider data enrichment before outreach"), say(F.col("lead_score") < 60, "Below average score - verify lead quality before investment"))
    return r.select("id", "lead_score", "percentile_rank", tiers(p, [(95, "Top 5%"), (90, "Top 10%"), (75, "Top 25%"), (50, "Top 50%")], "Bottom 50%").alias("ranking_tier"),
                    "better_count", F.round(F.col("lead_score") - F.col("m"), 6).alias("score_vs_average"), F.array_join(adv, " | ").alias("advantages"), F.array_join(rec, " | ").alias("recommendations"))


# ---- priority ---------------------------------------------------------------------------------------------------

USABLE = "(has_at AND contains(domain, '.'))"
PERSONAL = f"({USABLE} AND NOT {has('email_l', ['info@', 'contact@', 'sales@'])})"
BUSINESS = f"({USABLE} AND lower(domain) NOT IN ('gmail.com', 'yahoo.com', 'hotmail.com'))"
BOTH, EITHER = "(fn <> '' AND ln <> '')", "(fn <> '' OR ln <> '')"
HV = has("co_industry", R.HIGH_VALUE_INDUSTRIES)
OPT = one_of("co_size", R.OPTIMAL_SIZES)
STRUCT = has("lower(co_name)", ["inc", "corp", "ltd", "llc"])


def role(values):
    return case([("title = ''", values[0]), (has("title", R.ROLE_EXECUTIVE), values[1]), (has("title", ["vp", "vice president", "svp"]), values[2]), (has("title", ["director", "head of"]), values[3]),
                 (has("title", ["manager", "lead", "principal"]), values[4]), (has("title", ["senior", "sr.", "architect", "specialist"]), values[5])], values[6])


def flist(*items):
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


PRI1 = f"""SELECT *, least(100, {pts(USABLE, 30)} + {pts(PERSONAL, 15)} + {pts(BUSINESS, 10)} + {pts("phone <> ''", 20)} + {case([(BOTH, 15), (EITHER, 5)], 0)})::DOUBLE AS contact_score,
 {flist(when(PERSONAL, 'Personal email address'), when(BUSINESS, 'Business email domain'), when("phone <> ''", 'Phone number available'), when(BOTH, 'Complete name information'))} AS contact_factors,
 {flist("CASE WHEN email = '' THEN 'No email address' WHEN NOT " + USABLE + " THEN 'Invalid email format' END", when("phone = ''", 'No phone number'), when(f"NOT {EITHER}", 'Incomplete name information'))} AS contact_issues,
 least(100, {pts("co_name <> ''", 20)} + {pts(STRUCT, 10)} + {pts("co_industry <> ''", 20)} + {pts(HV, 15)} + {pts("co_size <> ''", 15)} + {pts(OPT, 10)} + {pts("co_website <> ''", 10)})::DOUBLE AS company_score,
 {flist(when("co_name <> ''", 'Company identified'), when(STRUCT, 'Established business structure'), "CASE WHEN co_industry <> '' THEN 'Industry: ' || co_industry_raw END", when(HV, 'High-value industry'),
        "CASE WHEN co_size <> '' THEN 'Company size: ' || co_size END", when(OPT, 'Optimal company size'), when("co_website <> ''", 'Website available'))} AS company_factors,
 {role([20, 95, 85, 75, 60, 45, 30])}::DOUBLE AS role_score,
 {role(["'Role title not specified'", "'C-level executive'", "'VP-level executive'", "'Director-level role'", "'Management role'", "'Senior individual contributor'", "'Individual contributor role'"])} AS role_factor,
 least(100, 50 + {pts('created_at IS NOT NULL', 20)} + {case([(one_of('source', R.INTENT_SOURCES), 25), ("source IN ('linkedin', 'referral')", 10)], 0)})::DOUBLE AS timing_score,
 {flist(when('created_at IS NOT NULL', 'Fresh lead - optimal timing window'), case([(one_of('source', R.INTENT_SOURCES), "'High-intent source'"), ("source IN ('linkedin', 'referral')", "'Warm source'")], 'NULL'))} AS timing_factors FROM w"""
PRI2 = """SELECT *, round(raw, 1) AS priority_score, CASE WHEN raw >= 85 THEN 'critical' WHEN raw >= 70 THEN 'high' WHEN raw >= 50 THEN 'medium' ELSE 'low' END AS priority_level,
 round(0.3::DOUBLE + (len(contact_factors) / 4.0::DOUBLE + len(company_factors) / 5.0::DOUBLE + CASE WHEN role_score > 30 THEN 1.0::DOUBLE ELSE 0.5 END) / 3.0::DOUBLE * 0.65::DOUBLE, 2) AS confidence,
 (CASE WHEN role_score >= 75 THEN [role_factor] ELSE [] END) || (CASE WHEN company_score >= 70 THEN list_filter(company_factors, lambda x: contains(lower(x), 'high-value') OR contains(lower(x), 'optimal'))[1:1] ELSE [] END)
 || (CASE WHEN contact_score >= 70 THEN list_filter(contact_factors, lambda x: contains(lower(x), 'business') OR contains(lower(x), 'personal'))[1:1] ELSE [] END)
 || (CASE WHEN timing_score >= 70 THEN timing_factors[1:1] ELSE [] END) AS key_factors
FROM (SELECT *, contact_score * 0.25::DOUBLE + company_score * 0.35::DOUBLE + role_score * 0.25::DOUBLE + timing_score * 0.15::DOUBLE AS raw FROM pri1)"""
PRI3 = """SELECT *, CASE WHEN priority_score >= 85 THEN 'Exceptional lead quality with multiple strong indicators.' WHEN priority_score >= 70 THEN 'High-priority lead with strong conversion potential.'
 WHEN priority_score >= 50 THEN 'Solid lead with moderate conversion potential.' ELSE 'Lead requires qualification and data enrichment.' END
 || CASE WHEN len(key_factors) = 0 THEN ' Multiple factors contribute to this assessment.' ELSE ' Key strengths include ' || array_to_string(key_factors[1:2], ', ') || '.' ||
  CASE WHEN len(key_factors) > 2 THEN ' Additional positive indicators: ' || array_to_string(key_factors[3:4], ', ') || '.' ELSE '' END END AS reason,
 CASE WHEN priority_score >= 85 THEN 25.0::DOUBLE WHEN priority_score >= 70 THEN 18 WHEN priority_score >= 50 THEN 12 ELSE 6 END AS response_rate FROM pri2"""
ACT = ("((" + case([(f"priority_level = '{k}'", "[" + ", ".join(lit(x) for x in v) + "]") for k, v in PR.LEVEL_ACTIONS.items()], "[]") + ") || "
       + flist(case([("role_score >= 85", lit("Focus on strategic business impact")), ("role_score >= 60", lit("Highlight operational benefits"))], "NULL"),
               when("list_contains(company_factors, 'High-value industry')", "Emphasize industry-specific solutions"), when("len(contact_issues) > 0", "Enhance contact data quality before outreach")) + ")[1:5]")
XPRI = {"w": WORK, "pri1": PRI1, "pri2": PRI2, "pri3": PRI3}


def analyzed(t):
    return PR.with_priority(nested(t), AS_OF)


def joined(c):
    return F.array_join(c, " | ").alias(c)


def aj(c, name=None):
    return f"array_to_string({c}, ' | ') AS {name or c}"


for key, spark_cols, sql_cols in [
    ("pri_1", ["contact_score", "contact_factors", "contact_issues"], f"contact_score, {aj('contact_factors')}, {aj('contact_issues')}"),
    ("pri_2", ["company_score", "company_factors"], f"company_score, {aj('company_factors')}"),
    ("pri_4", ["timing_score", "timing_factors"], f"timing_score, {aj('timing_factors')}"),
    ("pri_5", ["priority_score", "priority_level"], "priority_score, priority_level"),
    ("pri_6", ["confidence"], "confidence"), ("pri_7", ["key_factors"], aj("key_factors")), ("pri_8", ["reason"], "reason"),
    ("pri_9", ["actions"], f"array_to_string({ACT}, ' | ') AS actions"), ("pri_10", ["response_rate"], "response_rate"),
    ("pri_11", ["priority_score", "priority_level", "confidence", "reason", "actions", "urgency_score", "response_rate", "optimal_timing"],
     f"priority_score, priority_level, confidence, reason, array_to_string({ACT}, ' | ') AS actions, timing_score AS urgency_score, response_rate, 'Business hours' AS optimal_timing"),
]:
    listy = {"contact_factors", "contact_issues", "company_factors", "timing_factors", "key_factors", "actions"}
    query(key, BASE, f"SELECT id, {sql_cols} FROM pri3", XPRI)(
        lambda t, cols=spark_cols, listy=listy: analyzed(t).select("id", *[joined(c) if c in listy else F.col(c) for c in cols]))


@query("pri_3", BASE, "SELECT id, role_score, role_factor FROM pri1", {"w": WORK, "pri1": PRI1})
def pri_3(t):
    return analyzed(t).select("id", "role_score", F.element_at("role_factors", 1).alias("role_factor"))


HVL = ("(" + has("title", ["ceo", "cto", "cmo", "vp", "director", "president", "founder", "head of", "chief"]) + " OR "
       + has("lower(co_name) || ' ' || co_industry", ["technology", "software", "ai", "fintech", "healthcare", "enterprise"]) + " OR (email <> '' AND phone <> ''))")
HPI = "(" + has("title", ["manager", "senior", "lead", "specialist", "analyst", "coordinator"]) + " OR (" + has("email", [".com", ".org", ".net", ".io", ".co"]) + " AND has_at) OR " + has("source", ["linkedin", "professional"]) + ")"
SCP = ("(contains(title || lower(co_name), 'strong conversion potential')::INT + contains(title || lower(co_name), 'high-quality')::INT + has_at::INT + (phone <> '')::INT + (title <> '')::INT + (co_name <> '')::INT >= 4)")


@query("pri_12", BASE, f"SELECT id, {HVL} AS high_value, {HPI} AS high_potential, {SCP} AS strong_conversion FROM w", XW)
def pri_12(t):
    return PR.with_overrides(nested(t), AS_OF).select("id", "high_value", "high_potential", "strong_conversion")


FINAL = f"CASE WHEN {SCP} THEN 'high' WHEN priority_score >= 85 OR {HVL} THEN 'critical' WHEN priority_score >= 70 OR {HPI} THEN 'high' WHEN priority_score >= 50 THEN 'medium' ELSE 'low' END"


@query("pri_13", BASE, f"SELECT id, {FINAL} AS final_level, CASE WHEN {SCP} THEN greatest(priority_score, 75) ELSE priority_score END AS final_score FROM pri3", XPRI)
def pri_13(t):
    return PR.with_overrides(nested(t), AS_OF).select("id", "final_level", "final_score")


@query("pri_14", BASE, f"""SELECT id, CASE final_level WHEN 'critical' THEN 'Critical priority lead: ' || nm || ' is a ' || ti || ' at ' || co_name || ' with exceptional conversion potential and immediate outreach opportunity'
 WHEN 'high' THEN 'High-quality lead with strong conversion potential: ' || nm || ' (' || ti || ') shows excellent fit and engagement indicators'
 WHEN 'medium' THEN 'Qualified prospect: ' || nm || ' at ' || co_name || ' demonstrates good potential with moderate priority for outreach'
 ELSE 'Standard lead requiring nurturing: ' || nm || ' shows basic qualification but needs further development' END AS insight_text,
 CASE final_level WHEN 'critical' THEN 4 ELSE 3 END AS n_actions
FROM (SELECT *, {FINAL} AS final_level, trim(fn || ' ' || ln) AS nm, coalesce(raw_title, '') AS ti FROM pri3)""", XPRI)
def pri_14(t):
    return PR.with_overrides(nested(t), AS_OF).select("id", "insight_text", F.size("insight_actions").alias("n_actions"))


@query("pri_15", BASE, "SELECT id, score, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level FROM leads")
def pri_15(t):
    return t.leads(dates=False).select("id", "score", PR.level(F.col("score")).alias("level"))


@query("pri_16", BASE, "SELECT id, least(100, 50 + " + case([("contains(co_size, '500+')", 20), ("contains(co_size, '200-500')", 15), ("contains(co_size, '50-200')", 10)], 0) + " + "
       + case([(has("title", ["ceo", "president", "founder"]), 25), (has("title", ["vp", "director", "head"]), 15), (has("title", ["manager", "lead"]), 10)], 0) + " + "
       + case([(has("co_industry", ["technology", "software", "ai", "tech"]), 15), (has("co_industry", ["finance", "healthcare", "consulting"]), 10)], 0) + ")::DOUBLE AS impact FROM w", XW)
def pri_16(t):
    return prepare(nested(t), AS_OF).select("id", PR.business_impact().alias("impact"))


__all__ = ["nested", "drop_work"]
