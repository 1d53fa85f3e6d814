"""Analyzer features, derived scores and recommendations (FEA-1..15, DRV-1..12, DRV-18, DRV-19, SIM-3..6)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .exprs import add, any_in, cases, clamp, compact, count_true, ends_any, lookup, points, say
from .record import drop_work, prepare, w

NULL = None


def _bands(c: Column, table, otherwise: float, blank: float) -> Column:
    return cases([(c == "", float(blank))] + [(any_in(c, words), float(v)) for v, words in table], float(otherwise))


def email_quality() -> Column:
    d, local = w("domain"), w("local")
    n = F.length(local)
    total = add(
        F.lit(50.0), cases([(w("email_l").rlike(r"^[a-z]+\.[a-z]+@"), 25.0), (w("email_l").rlike(r"^[a-z]+[a-z]+@"), 15.0)], 0.0),
        points(d.isin(R.FEATURE_FREE_DOMAINS), -10, 20), cases([(ends_any(d, [".ai", ".io", ".tech"]), 15.0), (d.endswith(".com"), 10.0)], 0.0),
        cases([(n < 3, -15.0), (n > 20, -10.0)], 0.0), points(any_in(local, R.FEATURE_GENERIC), -20))
    return points(w("has_at"), clamp(total, 0, 100))


def seniority() -> Column:
    return _bands(w("title"), R.FEATURE_SENIORITY, 30, 0)


def decision_power() -> Column:
    return _bands(w("title"), R.FEATURE_DECISION, 20, 0)


def industry_relevance() -> Column:
    return _bands(w("co_industry"), R.FEATURE_INDUSTRY, 50, 50)


def company_size() -> Column:
    return _bands(w("co_size"), R.FEATURE_SIZE, 50, 50)


def location() -> Column:
    return _bands(w("co_location"), R.FEATURE_LOCATION, 50, 50)


def engagement_potential() -> Column:
    return clamp(add(F.lit(50.0), w("methods") * 10.0, points(w("linkedin") != "", 15), points((w("first") != "") & (w("last") != ""), 10),
                     points(w("co_website") != "", 8), points(any_in(w("title"), ["manager", "director", "head", "lead"]), 12)), 0, 100)


def completeness() -> Column:
    core = count_true(w("first") != "", w("last") != "", w("email") != "", w("title") != "") * 2
    rest = count_true(w("phone") != "", w("linkedin") != "", w("co_name") != "", w("co_industry") != "", w("co_size") != "", w("co_location") != "")
    return (core + rest) * 100.0 / 14


def freshness() -> Column:
    a = w("age")
    return cases([(a.isNull(), 50.0), (a <= 7, 100.0), (a <= 30, 90.0), (a <= 90, 70.0), (a <= 180, 50.0)],
                 F.greatest(F.lit(20.0), 100.0 - a / 10.0))


def consistency() -> Column:
    d, cd = w("domain"), F.coalesce("company.domain", F.lit(""))
    f, l, local = F.lower(w("first")), F.lower(w("last")), F.lower(w("local"))
    return F.greatest(F.lit(0.0), add(
        F.lit(100.0), points(w("has_at") & (cd != "") & (d != cd) & ~cd.contains(d) & ~d.contains(cd), -20),
        points((w("email") != "") & (f != "") & ~local.contains(f) & ~local.contains(l), -15),
        points(any_in(w("title"), ["ceo", "cto", "cfo"]) & w("co_size").contains("1-10"), -5)))


def source_quality() -> Column:
    return lookup(w("source"), {k: float(v) for k, v in R.FEATURE_SOURCE.items()}, 50.0)


def response_likelihood() -> Column:
    return clamp(add(
        F.greatest(F.lit(30.0), 80.0 - F.col("seniority_score") * 0.3), points(F.col("has_email") & (F.col("email_quality_score") > 70), 15),
        points(F.col("has_linkedin"), 10), F.col("industry_relevance") * 0.2, points(F.col("company_size_score").between(60, 90), 10)), 10, 90)


VECTOR = ["has_email", "has_phone", "has_linkedin", "email_quality_score", "seniority_score", "title_decision_power", "industry_relevance",
          "company_size_score", "location_score", "engagement_potential", "completeness_score", "source_quality"]
FEATURES = VECTOR + ["response_likelihood", "freshness_score", "consistency_score"]


def with_features(df: DataFrame, as_of: str, keep_work: bool = False) -> DataFrame:
    """FEA-13: one column per feature plus the 12-element ``vector``. Narrow."""
    p = prepare(df, as_of).withColumns({
        "has_email": w("email") != "", "has_phone": w("phone") != "", "has_linkedin": w("linkedin") != "",
        "email_quality_score": email_quality(), "seniority_score": seniority(), "title_decision_power": decision_power(),
        "industry_relevance": industry_relevance(), "company_size_score": company_size(), "location_score": location(),
        "engagement_potential": engagement_potential(), "completeness_score": completeness(), "freshness_score": freshness(),
        "consistency_score": consistency(), "source_quality": source_quality()})
    p = p.withColumns({"response_likelihood": response_likelihood(),
                       "vector": F.array(*[F.col(c).cast("double") for c in VECTOR])})
    return p if keep_work else drop_work(p)


def c(name: str) -> Column:
    return F.col(name)


def rule_priority() -> Column:
    return clamp(add(
        F.lit(50.0), points(c("has_email"), 15), points(c("has_phone"), 10), points(c("has_linkedin"), 8), c("seniority_score") * 0.3,
        c("title_decision_power") * 0.25, c("industry_relevance") * 0.2, c("company_size_score") * 0.15, c("location_score") * 0.1,
        c("completeness_score") * 0.1, c("source_quality") * 0.1), 5, 95)


def rule_quality() -> Column:
    contact = (c("email_quality_score") + points(c("has_phone"), 50) + points(c("has_linkedin"), 30)) / 3
    return clamp(add(c("completeness_score") * 0.4, contact * 0.3, (c("seniority_score") + c("industry_relevance")) / 2 * 0.2,
                     (c("source_quality") + c("freshness_score")) / 2 * 0.1), 0, 100)


def confidence() -> Column:
    return clamp(c("completeness_score") / 100 * 0.4 + c("consistency_score") / 100 * 0.3 + c("freshness_score") / 100 * 0.2
                 + F.least(F.lit(1.0), c("source_quality") / 80) * 0.1, 0.1, 0.95)


# ---- derived recommendations (fixed wording) --------------------------------------------------------------------


def priority_explanation() -> Column:
    p = c("priority_score")
    top = compact(say(c("seniority_score") >= 80, "Executive-level contact with high decision-making authority"),
                  say(c("industry_relevance") >= 80, "operates in high-value target industry"),
                  say(c("has_email") & (c("email_quality_score") > 70), "high-quality professional contact information available"))
    mid = compact(say(c("title_decision_power") >= 60, "Senior professional with influence in decision-making"),
                  say(c("company_size_score") >= 70, "works at optimally-sized company for our solution"),
                  say(c("completeness_score") >= 70, "comprehensive lead profile with good data quality"))
    low = compact(say(c("completeness_score") < 50, "limited contact information available"),
                  say(c("seniority_score") < 40, "junior-level contact with limited decision authority"),
                  say(c("industry_relevance") < 50, "industry may not be ideal fit for our solution"))
    joined = F.array_join(cases([(p >= 80, top), (p >= 60, mid)], low), ", ")
    return F.when(joined == "", "Standard lead profile with moderate conversion potential").otherwise(
        F.concat(F.when(p >= 60, "High-priority lead: ").otherwise("Lower priority: "), joined))


def recommended_actions(as_of: str) -> Column:
    p, hour = c("priority_score"), datetime.fromisoformat(as_of).hour
    def texts(*v):
        return F.array(*[F.lit(x) for x in v])

    base = cases([(p >= 80, texts("Schedule immediate personalized outreach", "Research recent company news and funding", "Prepare executive-level value proposition")),
                  (p >= 60, texts("Add to priority campaign within 24 hours", "Customize messaging for their industry"))],
                 texts("Include in nurture campaign", "Consider data enrichment before outreach"))
    extra = compact(
        cases([(~c("has_email"), "🔍 Find email address using lead enrichment tools"), (c("email_quality_score") < 50, "⚠️ Verify email deliverability before sending")], NULL),
        say(~c("has_phone") & (c("seniority_score") > 70), "📞 Research phone number for executive outreach"),
        say(~c("has_linkedin"), "🔗 Find LinkedIn profile for social selling approach"),
        say(c("completeness_score") < 60, "📊 Enrich lead data before outreach"),
        say(F.lit(9 <= hour <= 17), "⏰ Optimal time for immediate contact (business hours)"))
    return F.slice(F.concat(base, extra), 1, 6)


def engagement_strategy() -> Column:
    senior, junior, fit = c("seniority_score") >= 80, c("seniority_score") < 40, c("industry_relevance") >= 80
    li_only = ~c("has_email") & c("has_linkedin")
    return F.struct(
        F.when(li_only, "linkedin").otherwise("email").alias("primary_channel"),
        F.when(~li_only & c("has_phone") & (c("seniority_score") >= 70), "phone").otherwise("linkedin").alias("secondary_channel"),
        F.when(senior, "executive").when(junior, "friendly").otherwise("professional").alias("message_tone"),
        F.when(fit | senior, "high").otherwise("medium").alias("personalization_level"),
        F.when(senior, "executive").otherwise("standard").alias("follow_up_sequence"),
        F.when(fit, "industry_specific_roi").when(senior, "strategic_outcomes").when(junior, "features_benefits").otherwise("value_proposition").alias("content_focus"))


def timing_analysis(urgent: Column | None = None) -> Column:
    senior, fit = c("seniority_score") >= 80, c("industry_relevance") >= 80
    reason = cases([(senior, "Executive contacts often check email early morning before meetings start"),
                    (fit, "Tech industry professionals often prefer mid-week, morning contacts")], "")
    if urgent is not None:
        reason = F.concat(reason, F.when(urgent, ". Urgent campaign - contact immediately during business hours").otherwise(""))
    return F.struct(
        F.when(fit, "wednesday").otherwise("tuesday").alias("best_day"),
        cases([(senior, 8), (fit, 9)], 10).alias("best_hour_start"), cases([(senior, 9), (fit, 11)], 12).alias("best_hour_end"),
        F.lit("UTC").alias("timezone"), cases([(senior, 0.8), (fit, 0.7)], 0.5).alias("confidence"), reason.alias("reasoning"),
        F.when(senior, F.array(F.lit("16:00-17:00"), F.lit("7:00-8:00"))).otherwise(F.array().cast("array<string>")).alias("alternatives"))


def timezone() -> Column:
    """DRV-6."""
    return cases([(any_in(w("co_location"), words), zone) for zone, words in R.TIMEZONES], "UTC")


def optimal_timing() -> Column:
    """DRV-5."""
    senior, fit = c("seniority_score") >= 80, c("industry_relevance") >= 80
    near = c("location_score") >= 80
    return F.struct(
        F.when(fit, "wednesday").otherwise("tuesday").alias("best_day"),
        cases([(senior, 8), (fit, 9)], 10).alias("best_hour_start"), cases([(senior, 9), (fit, 11)], 12).alias("best_hour_end"),
        F.when(near, timezone()).otherwise("UTC").alias("timezone"),
        F.round(cases([(senior, 0.8), (fit, 0.7)], 0.6) + points(near, 0.1), 6).alias("confidence"),
        cases([(senior, "Executive timing - early morning before meetings"), (fit, "Technology industry timing optimization")], "Standard business timing").alias("reasoning"),
        cases([(senior, 0.28), (fit, 0.22)], 0.15).alias("success_rate"),
        F.when(senior, F.array(F.lit("7-8"), F.lit("17-18"))).otherwise(F.array(F.lit("wednesday 9-11"), F.lit("thursday 14-16"))).alias("alternatives"))


def conversion_probability() -> Column:
    p = F.lit(0.05) * cases([(c("seniority_score") >= 80, 3.0), (c("seniority_score") >= 60, 2.0)], 1.0)
    p = p * (1 + c("industry_relevance") / 100) * points(c("company_size_score") >= 80, 1.5, 1.0)
    return F.least(F.lit(0.8), p * (0.5 + c("completeness_score") / 200) * (0.7 + c("engagement_potential") / 333))


def urgency(as_of: str, urgent: bool = False, competitor: bool = False) -> Column:
    t = datetime.fromisoformat(as_of)
    base = 50.0 + (20 if t.month in (3, 6, 9, 12) and t.day >= 25 else 0) + (15 if t.month == 12 else 10 if t.month == 1 else 0)
    base += (30 if urgent else 0) + (20 if competitor else 0)
    return F.least(F.lit(100.0), add(F.lit(base), points(c("seniority_score") >= 80, 10), points(c("freshness_score") >= 90, 15)))


def business_impact() -> Column:
    size, ind, sen = c("company_size_score"), c("industry_relevance"), c("seniority_score")
    return F.struct(
        F.when(size >= 85, "large").when(size <= 60, "small").otherwise("medium").alias("deal_size_potential"),
        F.when(ind >= 90, "high").when(ind <= 50, "low").otherwise("medium").alias("strategic_value"),
        F.when((size >= 85) & (sen >= 80), "$50K-$200K").when(size >= 70, "$20K-$75K").when(size >= 50, "$5K-$30K").otherwise("$1K-$15K").alias("estimated_deal_value"),
        F.when(size >= 85, "6-12 months").when(size >= 70, "3-6 months").when(sen >= 80, "2-4 months").otherwise("1-3 months").alias("sales_cycle_length"),
        compact(say(sen >= 80, "Decision-maker authority"), say(ind >= 80, "High industry fit"), say(c("completeness_score") >= 80, "Complete contact profile"),
                say(c("engagement_potential") >= 70, "High engagement potential"), say(c("source_quality") >= 80, "High-quality lead source")).alias("success_indicators"),
        compact(say(c("completeness_score") < 50, "Incomplete contact information"), say(c("response_likelihood") < 40, "Low response probability"),
                say(c("consistency_score") < 70, "Data quality concerns"), say(c("freshness_score") < 50, "Outdated lead information"),
                say(ind < 50, "Industry fit concerns")).alias("risk_factors"))


def insights() -> Column:
    """DRV-10: array of insight structs; ``explode`` gives insight rows."""
    def item(cond, kind, lv, title, text, conf, act):
        return F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(lv).alias("level"), F.lit(title).alias("title"), F.lit(text).alias("description"),
                                     conf.alias("confidence"), F.lit(act).alias("action_required")))

    return compact(
        item(c("priority_score") >= 80, "priority", "high", "High-Priority Lead Detected", "This lead shows strong indicators for immediate outreach", c("confidence"), True),
        item(c("quality_score") < 60, "warning", "medium", "Data Quality Enhancement Needed", "Lead data should be enriched before outreach", F.lit(0.8), True),
        item(c("urgency_score") >= 80, "timing", "high", "Time-Sensitive Opportunity", "Current timing factors suggest immediate action", F.lit(0.7), True),
        item(c("industry_relevance") >= 85, "opportunity", "high", "High-Value Industry Target", "Lead operates in prime target industry with strong fit", F.lit(0.9), False),
        item(c("engagement_potential") >= 80, "approach", "medium", "High Engagement Potential", "Multiple quality contact methods available for outreach", F.lit(0.8), False))


def profile_key() -> Column:
    """DRV-19: leads with equal e-mail, title, company name and size share a result."""
    def t(x):
        return F.coalesce(F.col(x), F.lit(""))

    return F.md5(F.to_json(F.struct(t("company.name").alias("company_name"), t("company.size").alias("company_size"), t("email").alias("email"), t("title").alias("title"))))


def analyze(df: DataFrame, as_of: str, model_priority: Column | None = None, model_quality: Column | None = None) -> DataFrame:
    """DRV-18, and ML-12 where model columns are given: the rule scores stand in for a missing model value."""
    p = with_features(df, as_of, keep_work=True)
    prio = rule_priority() if model_priority is None else F.coalesce(clamp(model_priority, 5, 95), rule_priority())
    qual = rule_quality() if model_quality is None else F.coalesce(clamp(model_quality, 0, 100), rule_quality())
    p = p.withColumns({"priority_score": prio, "quality_score": qual, "confidence": confidence(), "urgency_score": urgency(as_of)})
    return drop_work(p.withColumns({
        "priority_explanation": priority_explanation(), "recommended_actions": recommended_actions(as_of), "engagement_strategy": engagement_strategy(),
        "optimal_timing": optimal_timing(), "conversion_probability": conversion_probability(), "business_impact": business_impact(), "insights": insights()}))


def outcome_score(outcome: Column, rating: Column) -> Column:
    """DRV-11."""
    base = lookup(F.lower(outcome), {k: float(v) for k, v in R.OUTCOME_SCORES.items()}, 50.0)
    return clamp(base + F.when(rating > 0, (rating - 3) * 10.0).otherwise(0.0), 0, 100)


# ---- vector similarity ------------------------------------------------------------------------------------------


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """SIM-3."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(clamp(dot(a, b) / (na * nb), 0, 1))


def mean_difference(a, b) -> Column:
    """SIM-4."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(clamp(1 - total / F.size(a) / 100, 0, 1))


def matching_features(a: str, b: str) -> Column:
    """SIM-6 over two structs of features."""
    def near(name, f, tol):
        return say(F.abs(F.col(f"{a}.{f}") - F.col(f"{b}.{f}")) < tol, name)

    def methods(s):
        return count_true(*[F.col(f"{s}.{x}") for x in ("has_email", "has_phone", "has_linkedin")])

    return compact(near("email_quality", "email_quality_score", 20), near("seniority_level", "seniority_score", 25),
                   near("industry_sector", "industry_relevance", 20), near("company_size", "company_size_score", 20),
                   near("geographic_region", "location_score", 25), say(F.abs(methods(a) - methods(b)) <= 1, "contact_completeness"))
