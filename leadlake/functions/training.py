"""Model features and rule labels (FEA-16..18, DRV-12..17, FN-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import add, any_in, cases, compact, count_true, lookup, points, tiers
from .record import drop_work, prepare, w

CLASSIFIER_FREE = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "protonmail.com"]
SIZE_CODES = {"1-10": 0.2, "11-50": 0.4, "51-200": 0.8, "201-500": 1.0, "501-1000": 0.9, "1001-5000": 0.7, "5000+": 0.5}
SOURCE_CODES = {"referral": 1.0, "linkedin": 0.9, "website": 0.8, "event": 0.8, "webinar": 0.7, "directory": 0.6, "purchased": 0.3, "unknown": 0.4}
KEY_FEATURES = ["title_seniority", "email_quality_score", "data_completeness", "industry_relevance", "company_size_score"]


def flag(cond: Column) -> Column:
    return cond.cast("double")


def _first(c: Column, table, otherwise: float, blank: float) -> Column:
    return cases([(c == "", blank)] + [(any_in(c, ws), v) for v, ws in table], otherwise)


def classifier_features(df: DataFrame, as_of: str) -> DataFrame:
    """FEA-16: 26 numeric columns on the 0-1 scale. Narrow."""
    p = prepare(df, as_of)
    t = w("title")
    # The last part after @ counts as the domain; an address without @ has none and so is not a free one.
    last = F.when(w("has_at"), F.lower(F.element_at(F.split(w("email"), "@"), -1))).otherwise("")
    corporate = (w("email") != "") & ~last.isin(CLASSIFIER_FREE)
    mail = F.least(F.lit(1.0), add(F.lit(0.5), points(corporate, 0.3), points(w("local").contains("."), 0.15), points(w("has_at") & w("domain").contains("."), 0.05)))
    fields = [w("first"), w("last"), w("email"), w("title")]
    optional = count_true(w("phone") != "", w("linkedin") != "", w("has_company"))
    rich = count_true(*[c != "" for c in [*fields, w("phone"), w("linkedin"), w("notes")]], w("has_company"))
    src = F.when(w("source") == "", "").otherwise(w("source"))
    ts = F.col("created_at")
    day, hour = F.weekday(ts), F.hour(ts)
    cols = {
        "has_email": flag(w("email") != ""), "has_phone": flag(w("phone") != ""), "has_linkedin": flag(w("linkedin") != ""),
        "email_is_corporate": flag(corporate), "email_quality_score": points(w("email") != "", mail),
        "name_completeness": count_true(w("first") != "", w("last") != "").cast("double"), "name_length": (F.length(w("first")) + F.length(w("last"))).cast("double"),
        "title_seniority": _first(t, [(1.0, ["ceo", "president", "founder", "chief"]), (0.8, ["vp", "vice president", "director"]), (0.6, ["manager", "head of", "lead"]), (0.4, ["senior"])], 0.2, 0.0),
        "title_decision_power": _first(t, [(1.0, ["ceo", "president", "founder", "owner"]), (0.8, ["cto", "cfo", "vp", "director"]), (0.6, ["manager", "head"]), (0.4, ["senior", "lead", "principal"])], 0.2, 0.0),
        "title_length": F.length(t).cast("double"), "title_word_count": w("title_words").cast("double"),
        "company_size_score": lookup(w("co_size"), SIZE_CODES, 0.5),
        "industry_relevance": _first(w("co_industry"), [(1.0, ["technology", "software", "ai", "fintech", "saas"]), (0.7, ["finance", "healthcare", "consulting", "manufacturing"])], 0.5, 0.5),
        "location_score": _first(w("co_location"), [(1.0, ["san francisco", "new york", "seattle", "boston", "austin", "london"]), (0.7, ["chicago", "denver", "atlanta", "toronto", "berlin"])], 0.5, 0.5),
        "has_company_website": flag(w("co_website") != ""),
        "data_completeness": count_true(*[c != "" for c in fields]) / 4.0 * 0.7 + optional / 3.0 * 0.3,
        "data_freshness": cases([(w("age").isNull(), 0.5), (w("age") <= 7, 1.0), (w("age") <= 30, 0.8), (w("age") <= 90, 0.6)], 0.3),
        "source_quality": lookup(src, SOURCE_CODES, 0.5), "source_is_referral": flag(w("source").contains("referral")), "source_is_organic": flag(w("source").isin("website", "organic", "search")),
        "contact_methods_count": w("methods").cast("double"), "profile_richness": rich / 8.0,
        "day_of_week": F.coalesce(day, F.lit(0)).cast("double"), "hour_of_day": F.coalesce(hour, F.lit(12)).cast("double"),
        "is_weekend": F.coalesce(flag(day >= 5), F.lit(0.0)), "is_business_hours": F.coalesce(flag(hour.between(9, 17)), F.lit(1.0)),
    }
    return drop_work(p.withColumns(cols))


CLASSIFIER_COLUMNS = [
    "has_email", "has_phone", "has_linkedin", "email_is_corporate", "email_quality_score", "name_completeness", "name_length", "title_seniority", "title_decision_power", "title_length",
    "title_word_count", "company_size_score", "industry_relevance", "location_score", "has_company_website", "data_completeness", "data_freshness", "source_quality", "source_is_referral",
    "source_is_organic", "contact_methods_count", "profile_richness", "day_of_week", "hour_of_day", "is_weekend", "is_business_hours"]


def quality_features(df: DataFrame, as_of: str) -> DataFrame:
    """FEA-17: 26 numeric columns for the quality regressors."""
    p = prepare(df, as_of)
    free = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com"]
    t, n = w("title"), F.length(w("phone_d"))
    cols = {
        "has_email": flag(w("email") != ""), "has_phone": flag(w("phone") != ""), "has_linkedin": flag(w("linkedin") != ""), "has_title": flag(t != ""), "has_company": flag(w("co_name") != ""),
        "email_length": F.length(w("email")).cast("double"), "email_has_dot": flag(w("email").contains(".")), "email_domain_length": F.length(w("domain")).cast("double"), "is_free_email": flag(any_in(w("email"), free)),
        "phone_length": n.cast("double"), "phone_has_country_code": flag(w("phone").startswith("+") | (n > 10)), "first_name_length": F.length(w("first")).cast("double"), "last_name_length": F.length(w("last")).cast("double"),
        "name_has_special_chars": flag(F.concat(w("first"), w("last")).rlike(r"[^a-zA-Z\s]")), "company_has_domain": flag(w("co_domain") != ""), "company_has_industry": flag(w("co_industry") != ""),
        "company_has_size": flag(w("co_size") != ""), "title_length": F.length(t).cast("double"), "is_executive": flag(any_in(t, ["ceo", "cto", "cfo", "president", "founder"])),
        "is_manager": flag(any_in(t, ["manager", "director", "head", "lead"])), "is_senior": flag(any_in(t, ["senior", "sr."])), "days_old": F.least(F.coalesce(w("age"), F.lit(365)), F.lit(1000)).cast("double"),
        "is_recent": F.coalesce(flag(w("age") <= 30), F.lit(0.0)), "source_is_referral": flag(w("source").contains("referral")), "source_is_linkedin": flag(w("source").contains("linkedin")),
        "source_is_organic": flag(any_in(w("source"), ["organic", "website"])),
    }
    return drop_work(p.withColumns(cols))


QUALITY_COLUMNS = ["has_email", "has_phone", "has_linkedin", "has_title", "has_company", "email_length", "email_has_dot", "email_domain_length", "is_free_email", "phone_length", "phone_has_country_code",
                   "first_name_length", "last_name_length", "name_has_special_chars", "company_has_domain", "company_has_industry", "company_has_size", "title_length", "is_executive", "is_manager",
                   "is_senior", "days_old", "is_recent", "source_is_referral", "source_is_linkedin", "source_is_organic"]

TRAINING_FREE = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com"]


def seniority_from_title() -> Column:
    t = w("title")
    return cases([(any_in(t, ["ceo", "cto", "cfo", "president", "founder", "executive"]), "executive"), (any_in(t, ["senior", "director", "head", "principal"]), "senior"), (any_in(t, ["manager", "lead"]), "manager")], "individual")


def employee_range() -> Column:
    """FN-7."""
    # Fixed bounds per size text.
    table = {"1-10": (1, 10), "11-50": (11, 50), "51-200": (51, 200), "201-500": (201, 500), "501-1000": (501, 1000), "1001-5000": (1001, 5000), "5000+": (5000, 20000)}
    pair = lambda v: F.struct(F.lit(v[0]).alias("min"), F.lit(v[1]).alias("max"))
    return cases([(w("co_size") == k, pair(v)) for k, v in table.items()], pair((10, 100)))


def training_features(df: DataFrame, as_of: str) -> DataFrame:
    """FEA-18: the priority and quality sample columns."""
    p = prepare(df, as_of)
    filled = count_true(*[w(c) != "" for c in ("first", "last", "email", "phone", "title", "linkedin", "co_name", "co_industry", "co_size", "co_location")])
    digits = F.regexp_replace(w("phone"), r"[-() +.]", "")
    range_ = employee_range()
    mismatch = w("has_at") & (F.coalesce("company.domain", F.lit("")) != "") & (w("domain") != F.coalesce("company.domain", F.lit("")))
    numbers = F.concat(w("first"), w("last")).rlike("[0-9]")
    cols = {
        "seniority_level": seniority_from_title(), "industry": w("co_industry"), "company_size": w("co_size"), "lead_source": w("source"),
        "email_domain_type": cases([(~w("has_at"), "unknown"), (w("domain").isin(TRAINING_FREE), "free")], "corporate"), "has_phone": flag(w("phone") != ""), "has_linkedin": flag(w("linkedin") != ""),
        "company_employee_count": ((range_["min"] + range_["max"]) / 2.0), "data_completeness_score": filled / 10.0, "email_format_valid": flag(w("has_at") & w("domain").contains(".")),
        "phone_format_valid": flag((F.length(digits) >= 10) & digits.rlike("^[0-9]+$")), "name_format_valid": flag(F.replace(w("first"), F.lit(" "), F.lit("")).rlike(r"^\p{L}+$") & F.replace(w("last"), F.lit(" "), F.lit("")).rlike(r"^\p{L}+$")),
        "linkedin_url_valid": flag(w("linkedin").contains("linkedin.com/in/")), "company_data_complete": count_true(*[w(c) != "" for c in ("co_name", "co_industry", "co_size", "co_location")]) / 4.0,
        "data_consistency_score": F.greatest(F.lit(0.0), add(F.lit(1.0), points(mismatch, -0.2), points(numbers, -0.3))), "has_corporate_email": flag(w("has_at") & ~w("domain").isin(TRAINING_FREE)),
    }
    return drop_work(p.withColumns(cols))


PRIORITY_SET = ["seniority_level", "industry", "company_size", "lead_source", "email_domain_type", "has_phone", "has_linkedin", "company_employee_count", "data_completeness_score"]
QUALITY_SET = ["email_format_valid", "phone_format_valid", "name_format_valid", "linkedin_url_valid", "company_data_complete", "data_completeness_score", "data_consistency_score", "has_corporate_email"]

# ---- rule labels (fixed tables) -----------------------------------------------------------------------------------

OUTCOME_CLASS = {"converted": "high", "qualified": "high", "interested": "medium", "responded": "medium", "no_response": "low", "rejected": "low"}


def outcome_class(outcome: Column) -> Column:
    """DRV-12."""
    return lookup(outcome, OUTCOME_CLASS, "medium")


def synthetic_target() -> Column:
    """DRV-13."""
    c = F.col
    s = c("title_seniority") * 0.3 + c("email_quality_score") * 0.2 + c("data_completeness") * 0.2 + c("industry_relevance") * 0.15 + c("company_size_score") * 0.15
    return tiers(s, [(0.8, "high"), (0.6, "medium")], "low")


def label_rules(df: DataFrame, as_of: str) -> DataFrame:
    """DRV-14: priority, quality, conversion likelihood and score without jitter."""
    p = prepare(df, as_of).withColumn("seniority", seniority_from_title())
    k = F.col("seniority")
    sen = lookup(k, {"executive": 0.4, "senior": 0.3, "manager": 0.2}, 0.1)
    ind = lookup(w("co_industry"), {"technology": 0.3, "finance": 0.25, "healthcare": 0.2, "consulting": 0.15, "manufacturing": 0.1}, 0.05)
    siz = lookup(w("co_size"), {"201-500": 0.2, "501-1000": 0.15, "51-200": 0.15, "1001-5000": 0.1, "11-50": 0.1, "1-10": 0.05, "5000+": 0.05}, 0.05)
    src = lookup(w("source"), {"referral": 0.1, "linkedin": 0.08, "event": 0.08, "website": 0.06, "webinar": 0.05, "directory": 0.03, "purchased": 0.01}, 0.02)
    dom = F.coalesce("company.domain", F.lit(""))
    # Employee counts come from the size range and so are positive whenever there is a company.
    qual = add(F.lit(0.0), points(w("email") != "", 0.3), points(w("has_at") & w("email").contains("."), 0.1), points(w("phone") != "", 0.2), points(w("linkedin") != "", 0.1), points(dom != "", 0.1),
               points(w("has_company"), 0.1), points((w("email") != "") & (dom != "") & (w("domain") == dom), 0.1))
    p = p.withColumns({"priority": tiers(F.round(sen + ind + siz + src, 6), [(0.7, "high"), (0.4, "medium")], "low"), "quality": tiers(F.round(qual, 6), [(0.8, "excellent"), (0.6, "good"), (0.4, "fair")], "poor")})
    pr, q = F.col("priority"), F.col("quality")
    like = F.round(lookup(pr, {"high": 0.6, "medium": 0.4}, 0.2) + lookup(q, {"excellent": 0.4, "good": 0.3, "fair": 0.2}, 0.1), 6)
    score = lookup(pr, {"high": 40, "medium": 25}, 10) + lookup(q, {"excellent": 30, "good": 20, "fair": 15}, 5) + lookup(k, {"executive": 30, "senior": 20, "manager": 15}, 10)
    return drop_work(p.withColumns({"conversion_likely": tiers(like, [(0.8, "high"), (0.5, "medium")], "low"), "label_score": score}))


def tags() -> Column:
    """DRV-15 over prepared columns."""
    s = seniority_from_title()
    return compact(F.when(w("co_industry") != "", F.replace(w("co_industry"), F.lit("_"), F.lit("-"))), F.when(s == "executive", "decision-maker").when(s == "senior", "influencer"),
                   F.when(w("source").isin("referral", "event", "webinar"), "warm-lead").when(w("source") == "linkedin", "social"))


def contributions() -> Column:
    """DRV-16."""
    total = add(*[F.col(c) for c in KEY_FEATURES])
    return F.map_from_arrays(F.array(*[F.lit(c) for c in KEY_FEATURES]), F.array(*[F.when(total > 0, F.col(c) / total).otherwise(0.0) for c in KEY_FEATURES]))


def reasoning() -> Column:
    """DRV-17."""
    rules = [("title_seniority", 0.3, "High seniority title indicates decision-making authority", "Junior-level title may have limited decision authority"),
             ("email_quality_score", 0.5, "High-quality professional email address", "Email quality concerns may affect deliverability"),
             ("data_completeness", 0.5, "Complete profile with all essential information", "Incomplete profile missing key information"),
             ("industry_relevance", 0.5, "Industry is highly relevant to our solution", "Industry may not be ideal fit for our solution"),
             ("company_size_score", 0.4, "Company size is in our optimal target range", "Company size may not align with our typical customers")]
    return compact(*[F.when(F.col(c) > 0.8, good).when(F.col(c) < low, bad) for c, low, good, bad in rules])


