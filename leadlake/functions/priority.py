"""Priority analysis of a lead: four sub-scores, factors, level, actions and the overrides (PRI-*)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .exprs import add, any_in, cases, compact, count_true, points, say, tiers
from .record import drop_work, prepare, w



def _usable_email() -> Column:
    return w("has_at") & w("domain").contains(".")


def _personal() -> Column:
    return _usable_email() & ~any_in(w("email_l"), ["info@", "contact@", "sales@"])


def _business() -> Column:
    return _usable_email() & ~F.lower(w("domain")).isin("gmail.com", "yahoo.com", "hotmail.com")


def contact_score() -> Column:
    both = (w("first") != "") & (w("last") != "")
    one = (w("first") != "") | (w("last") != "")
    return F.least(F.lit(100.0), add(points(_usable_email(), 30), points(_personal(), 15), points(_business(), 10),
                                     points(w("phone") != "", 20), cases([(both, 15.0), (one, 5.0)], 0.0)))


def contact_factors() -> Column:
    return compact(say(_personal(), "Personal email address"), say(_business(), "Business email domain"),
                   say(w("phone") != "", "Phone number available"),
                   say((w("first") != "") & (w("last") != ""), "Complete name information"))


def contact_issues() -> Column:
    return compact(cases([(w("email") == "", "No email address"), (~_usable_email(), "Invalid email format")], F.lit(None).cast("string")),
                   say(w("phone") == "", "No phone number"), say((w("first") == "") & (w("last") == ""), "Incomplete name information"))


def _structured() -> Column:
    return any_in(F.lower(w("co_name")), ["inc", "corp", "ltd", "llc"])


def company_score() -> Column:
    return F.least(F.lit(100.0), add(
        points(w("co_name") != "", 20), points(_structured(), 10), points(w("co_industry") != "", 20),
        points(any_in(w("co_industry"), R.HIGH_VALUE_INDUSTRIES), 15), points(w("co_size") != "", 15),
        points(w("co_size").isin(R.OPTIMAL_SIZES), 10), points(w("co_website") != "", 10)))


def company_factors() -> Column:
    return compact(
        say(w("co_name") != "", "Company identified"), say(_structured(), "Established business structure"),
        say(w("co_industry") != "", F.concat(F.lit("Industry: "), F.col("company.industry"))),
        say(any_in(w("co_industry"), R.HIGH_VALUE_INDUSTRIES), "High-value industry"),
        say(w("co_size") != "", F.concat(F.lit("Company size: "), w("co_size"))),
        say(w("co_size").isin(R.OPTIMAL_SIZES), "Optimal company size"), say(w("co_website") != "", "Website available"))


def _role(values) -> Column:
    """Pick by role: blank, executive, vice president, director, manager, senior, other."""
    t = w("title")
    blank, ex, vp, director, manager, senior, other = values
    return cases([(t == "", blank), (any_in(t, R.ROLE_EXECUTIVE), ex), (any_in(t, ["vp", "vice president", "svp"]), vp),
                  (any_in(t, ["director", "head of"]), director), (any_in(t, ["manager", "lead", "principal"]), manager),
                  (any_in(t, ["senior", "sr.", "architect", "specialist"]), senior)], other)


def role_score() -> Column:
    return _role([20.0, 95.0, 85.0, 75.0, 60.0, 45.0, 30.0])


def role_factors() -> Column:
    texts = [["Role title not specified"], ["C-level executive", "Ultimate decision-making authority"],
             ["VP-level executive", "High decision-making influence"], ["Director-level role", "Department decision-making authority"],
             ["Management role", "Team leadership position"], ["Senior individual contributor"], ["Individual contributor role"]]
    return _role([F.array(*[F.lit(x) for x in t]) for t in texts])


def _quarter_end(as_of: str) -> bool:
    return datetime.fromisoformat(as_of).month in (3, 6, 9, 12)


def timing_score(as_of: str) -> Column:
    s = w("source")
    return F.least(F.lit(100.0), add(
        F.lit(50.0 + (15 if _quarter_end(as_of) else 0)), points(F.col("created_at").isNotNull(), 20),
        cases([(s.isin(R.INTENT_SOURCES), 25.0), (s.isin("linkedin", "referral"), 10.0)], 0.0)))


def timing_factors(as_of: str) -> Column:
    s = w("source")
    return compact(say(F.col("created_at").isNotNull(), "Fresh lead - optimal timing window"),
                   cases([(s.isin(R.INTENT_SOURCES), "High-intent source"), (s.isin("linkedin", "referral"), "Warm source")], F.lit(None).cast("string")),
                   say(F.lit(_quarter_end(as_of)), "Quarter-end timing advantage"))


def level(score: Column) -> Column:
    """PRI-15."""
    return tiers(score, R.LEVELS, "low")


def key_factors() -> Column:
    """PRI-7: at most one factor per category, in the order role, company, contact, timing."""
    def first_matching(arr, *words):
        return F.slice(F.filter(arr, lambda f: any_in(F.lower(f), words)), 1, 1)

    none = F.array().cast("array<string>")
    return F.concat(
        F.when(F.col("role_score") >= 75, F.slice("role_factors", 1, 1)).otherwise(none),
        F.when(F.col("company_score") >= 70, first_matching(F.col("company_factors"), "high-value", "optimal")).otherwise(none),
        F.when(F.col("contact_score") >= 70, first_matching(F.col("contact_factors"), "business", "personal")).otherwise(none),
        F.when(F.col("timing_score") >= 70, F.slice("timing_factors", 1, 1)).otherwise(none))


def explanation() -> Column:
    """PRI-8."""
    s, k = F.col("priority_score"), F.col("key_factors")
    base = tiers(s, [(85, "Exceptional lead quality with multiple strong indicators."),
                     (70, "High-priority lead with strong conversion potential."),
                     (50, "Solid lead with moderate conversion potential.")], "Lead requires qualification and data enrichment.")
    more = F.when(F.size(k) > 2, F.concat(F.lit(" Additional positive indicators: "), F.array_join(F.slice(k, 3, 2), ", "), F.lit("."))).otherwise("")
    return F.concat(base, F.when(F.size(k) > 0, F.concat(F.lit(" Key strengths include "), F.array_join(F.slice(k, 1, 2), ", "), F.lit("."), more)).otherwise(
        " Multiple factors contribute to this assessment."))


# Fixed action texts per level.
LEVEL_ACTIONS = {
    "critical": ["Schedule immediate outreach within 2 hours", "Prepare executive-level value proposition", "Research company background thoroughly"],
    "high": ["Prioritize for outreach today", "Customize messaging based on role and industry", "Prepare relevant case studies"],
    "medium": ["Add to weekly outreach queue", "Research company and role context"],
    "low": ["Qualify and enrich lead data first", "Research company needs before outreach"],
}


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def actions() -> Column:
    """PRI-9."""
    lv = F.col("priority_level")
    base = cases([(lv == k, _texts(v)) for k, v in LEVEL_ACTIONS.items() if k != "low"], _texts(LEVEL_ACTIONS["low"]))
    extra = compact(
        cases([(F.col("role_score") >= 85, "Focus on strategic business impact"), (F.col("role_score") >= 60, "Highlight operational benefits")], F.lit(None).cast("string")),
        say(F.array_contains("company_factors", "High-value industry"), "Emphasize industry-specific solutions"),
        say(F.size("contact_issues") > 0, "Enhance contact data quality before outreach"))
    return F.slice(F.concat(base, extra), 1, 5)


def response_rate(score: Column) -> Column:
    return tiers(score, [(85, 25.0), (70, 18.0), (50, 12.0)], 6.0)


def confidence() -> Column:
    """PRI-6."""
    role = F.when(F.col("role_score") > 30, 1.0).otherwise(0.5)
    mean = (F.size("contact_factors") / 4.0 + F.size("company_factors") / 5.0 + role) / 3.0
    return F.round(F.lit(0.3) + mean * 0.65, 2)


def with_priority(df: DataFrame, as_of: str, keep_work: bool = False) -> DataFrame:
    """PRI-11: the full result row. Narrow."""
    p = prepare(df, as_of).withColumns({
        "contact_score": contact_score(), "contact_factors": contact_factors(), "contact_issues": contact_issues(),
        "company_score": company_score(), "company_factors": company_factors(), "role_score": role_score(),
        "role_factors": role_factors(), "timing_score": timing_score(as_of), "timing_factors": timing_factors(as_of)})
    k = R.PRIORITY_WEIGHTS
    raw = add(*[F.col(f"{n}_score") * v for n, v in k.items()])
    p = p.withColumn("_raw", raw).withColumns({
        "priority_score": F.round("_raw", 1), "priority_level": level(F.col("_raw")), "confidence": confidence(), "key_factors": key_factors()})
    p = p.withColumns({"reason": explanation(), "actions": actions(), "response_rate": response_rate(F.col("priority_score")),
                       "urgency_score": F.col("timing_score"), "optimal_timing": F.lit("Business hours")}).drop("_raw")
    return p if keep_work else drop_work(p)


def high_value() -> Column:
    """PRI-12; the company is its name and industry text."""
    return (any_in(w("title"), ["ceo", "cto", "cmo", "vp", "director", "president", "founder", "head of", "chief"])
            | any_in(F.concat_ws(" ", F.lower(w("co_name")), w("co_industry")), ["technology", "software", "ai", "fintech", "healthcare", "enterprise"])
            | ((w("email") != "") & (w("phone") != "")))


def high_potential() -> Column:
    return (any_in(w("title"), ["manager", "senior", "lead", "specialist", "analyst", "coordinator"])
            | (any_in(w("email"), [".com", ".org", ".net", ".io", ".co"]) & w("has_at"))
            | any_in(w("source"), ["linkedin", "professional"]))


def strong_conversion() -> Column:
    text = F.concat(w("title"), F.lower(w("co_name")))
    return count_true(text.contains("strong conversion potential"), text.contains("high-quality"),
                      w("has_at"), w("phone") != "", w("title") != "", w("co_name") != "") >= 4


def with_overrides(df: DataFrame, as_of: str) -> DataFrame:
    """PRI-13/14: level raised by the three flags, boosted score, insight text and actions."""
    p = with_priority(df, as_of, keep_work=True).withColumns({
        "high_value": high_value(), "high_potential": high_potential(), "strong_conversion": strong_conversion()})
    s = F.col("priority_score")
    lv = cases([(F.col("strong_conversion"), "high"), ((s >= 85) | F.col("high_value"), "critical"),
                ((s >= 70) | F.col("high_potential"), "high"), (s >= 50, "medium")], "low")
    p = p.withColumns({"final_level": lv, "final_score": F.when(F.col("strong_conversion"), F.greatest(s, F.lit(75.0))).otherwise(s)})
    name = F.trim(F.concat_ws(" ", w("first"), w("last")))
    title, company = F.coalesce(F.col("title"), F.lit("")), w("co_name")
    lvl = F.col("final_level")
    insight = cases([
        (lvl == "critical", F.concat(F.lit("Critical priority lead: "), name, F.lit(" is a "), title, F.lit(" at "), company, F.lit(" with exceptional conversion potential and immediate outreach opportunity"))),
        (lvl == "high", F.concat(F.lit("High-quality lead with strong conversion potential: "), name, F.lit(" ("), title, F.lit(") shows excellent fit and engagement indicators"))),
        (lvl == "medium", F.concat(F.lit("Qualified prospect: "), name, F.lit(" at "), company, F.lit(" demonstrates good potential with moderate priority for outreach")))],
        F.concat(F.lit("Standard lead requiring nurturing: "), name, F.lit(" shows basic qualification but needs further development")))
    acts = cases([
        (lvl == "critical", _texts(["Contact immediately", "Prepare executive proposal", "Schedule priority follow-up", "Research company background"])),
        (lvl == "high", _texts(["Contact immediately", "Prepare proposal", "Schedule follow-up call"])),
        (lvl == "medium", _texts(["Add to weekly outreach", "Research background", "Prepare standard proposal"]))],
        _texts(["Add to nurture campaign", "Collect more information", "Monitor for engagement"]))
    return drop_work(p.withColumns({"insight_text": insight, "insight_actions": acts}))


def business_impact() -> Column:
    """PRI-16."""
    s, t, i = w("co_size"), w("title"), w("co_industry")
    return F.least(F.lit(100.0), add(
        F.lit(50.0), cases([(s.contains("500+"), 20.0), (s.contains("200-500"), 15.0), (s.contains("50-200"), 10.0)], 0.0),
        cases([(any_in(t, ["ceo", "president", "founder"]), 25.0), (any_in(t, ["vp", "director", "head"]), 15.0), (any_in(t, ["manager", "lead"]), 10.0)], 0.0),
        cases([(any_in(i, ["technology", "software", "ai", "tech"]), 15.0), (any_in(i, ["finance", "healthcare", "consulting"]), 10.0)], 0.0)))


__all__ = [n for n in dir() if not n.startswith("_")]
