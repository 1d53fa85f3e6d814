"""Data-quality assessment: e-mail, phone, completeness, accuracy, consistency, freshness, the six-dimension scorer and
the reports over them (DQ-*). Syntax rules only; issues are arrays of structs built next to the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .exprs import add, any_in, cases, clamp, compact, count_true, points, say, tiers
from .record import drop_work, prepare, w
from .similarity import ratio

NULL = None
ISSUE = "struct<issue_type:string,severity:string,field_name:string,description:string,suggested_fix:string,confidence:double,impact_score:double>"


def issue(cond: Column, kind: str, severity: str, field: str, text, fix: str, confidence: float, impact: float) -> Column:
    text = text if isinstance(text, Column) else F.lit(text)
    return F.when(cond, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(field).alias("field_name"), text.alias("description"),
                                 F.lit(fix).alias("suggested_fix"), F.lit(float(confidence)).alias("confidence"), F.lit(float(impact)).alias("impact_score")))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def suspicious_pattern() -> Column:
    return cases([(F.col("q_email_l").rlike(p), p) for p in R.SUSPICIOUS_EMAILS], NULL)


def with_quality_columns(df: DataFrame, as_of: str) -> DataFrame:
    """Prepared frame plus trimmed values and the decisions several rules share."""
    p = prepare(df, as_of).withColumns({"q_email": trimmed(w("email")), "q_phone": trimmed(w("phone")), "q_first": trimmed(w("first")),
                                        "q_last": trimmed(w("last")), "q_linkedin": trimmed(w("linkedin")), "q_website": trimmed(w("website")), "q_title": F.lower(trimmed(w("title")))})
    p = p.withColumns({"q_email_l": F.lower("q_email"), "q_domain": F.split_part("q_email", F.lit("@"), F.lit(2)), "q_local": F.split_part("q_email", F.lit("@"), F.lit(1))})
    return p.withColumns({"q_email_ok": F.col("q_email").rlike(R.EMAIL_PATTERN), "q_suspicious": suspicious_pattern(),
                          "q_generic": any_in(F.lower("q_local"), R.QUALITY_GENERIC),
                          "q_related": domains_related(F.split_part(w("email_l"), F.lit("@"), F.lit(2)), w("co_domain"))})


def email_quality() -> Column:
    d, n = F.col("q_domain"), F.length("q_local")
    total = add(
        F.lit(50.0), points(F.col("q_suspicious").isNotNull(), -25),
        cases([(F.col("q_email_l").rlike(r"^[a-z]+\.[a-z]+@"), 20.0), (F.col("q_email_l").rlike(r"^[a-z]+@"), 10.0)], 0.0),
        points(F.lower(d).isin(R.QUALITY_FREE_DOMAINS), -15, 15), cases([(d.rlike(r"\.(ai|io|tech|dev)$"), 10.0), (d.endswith(".com"), 5.0)], 0.0),
        cases([(n < 2, -20.0), (n > 30, -10.0)], 0.0), points(F.col("q_generic"), -20))
    return points(F.col("q_email_ok"), clamp(total, 0, 100))


def email_issues() -> Column:
    ok = F.col("q_email_ok")
    return compact(
        issue(F.col("q_email") == "", "missing_data", "high", "email", "Email address is missing", "Find and add a valid email address", 1.0, 30),
        issue((F.col("q_email") != "") & ~ok, "invalid_format", "critical", "email", "Email format is invalid", "Correct the email format", 0.95, 40),
        issue(ok & F.col("q_suspicious").isNotNull(), "suspicious_pattern", "medium", "email", F.concat(F.lit("Email matches suspicious pattern: "), F.col("q_suspicious")), "Verify this is a real professional email", 0.7, 20),
        issue(ok & F.col("q_generic"), "low_confidence", "medium", "email", "Email appears to be a generic/role-based address", "Find the specific person's direct email", 0.8, 15))


def phone_quality() -> Column:
    c = w("phone_d")
    total = add(F.lit(50.0), cases([(F.length(c) < 10, -30.0), (F.length(c) > 15, -20.0)], 0.0),
                cases([(F.col("q_phone").rlike(R.US_PHONE), 20.0), (c.rlike(R.INTERNATIONAL_PHONE), 15.0)], -20.0), points(c.rlike(R.FAKE_PHONE), -40))
    return points(F.col("q_phone") != "", clamp(total, 0, 100))


def phone_issues() -> Column:
    c, given = w("phone_d"), F.col("q_phone") != ""
    return compact(
        issue(given & (F.length(c) < 10), "invalid_format", "high", "phone", "Phone number appears too short", "Verify and complete the phone number", 0.9, 25),
        issue(given & (F.length(c) > 15), "invalid_format", "medium", "phone", "Phone number appears too long", "Verify the phone number format", 0.8, 15),
        issue(given & c.rlike(R.FAKE_PHONE), "suspicious_pattern", "high", "phone", "Phone number appears to be fake or placeholder", "Verify and replace with real phone number", 0.9, 35))


def has_company() -> Column:
    return w("has_company")


def company_points() -> Column:
    return count_true(*[w(c) != "" for c in ("co_name", "co_industry", "co_size", "co_location")]) * 2


def completeness() -> Column:
    """Always out of 26: a missing company counts as an empty one."""
    three = count_true(w("first") != "", w("last") != "", w("email") != "") * 3
    two = count_true(w("title") != "", w("phone") != "", has_company()) * 2
    one = count_true(w("linkedin") != "", w("website") != "", w("notes") != "")
    return (three + two + one + company_points()) * 100.0 / 26


def completeness_issues() -> Column:
    def miss(cond, f, kind):
        sev, fix, conf, imp = ("high", f"Add {f} information", 1.0, 25) if kind == "Required" else ("medium", f"Consider adding {f} information", 0.8, 15)
        return issue(cond, "missing_data", sev, f, f"{kind} field {f} is missing", fix, conf, imp)

    return compact(miss(w("first") == "", "first_name", "Required"), miss(w("last") == "", "last_name", "Required"), miss(w("email") == "", "email", "Required"),
                   miss(w("title") == "", "title", "Important"), miss(w("phone") == "", "phone", "Important"), miss(~has_company(), "company", "Important"))


NAME_OK = r"^[a-zA-Z\s'-]+$"


def _accuracy_flags() -> dict:
    bad = lambda c, p: (F.col(c) != "") & ~F.col(c).rlike(p)
    return {"first": bad("q_first", NAME_OK), "last": bad("q_last", NAME_OK), "linkedin": bad("q_linkedin", R.LINKEDIN_PATTERN),
            "website": bad("q_website", R.WEBSITE_PATTERN), "title": (F.col("q_title") != "") & F.col("q_title").rlike(R.FAKE_TITLE)}


def accuracy() -> Column:
    b = _accuracy_flags()
    return F.greatest(F.lit(0.0), add(F.lit(100.0), points(b["first"], -15), points(b["last"], -15), points(b["linkedin"], -10), points(b["website"], -5), points(b["title"], -25)))


def accuracy_issues() -> Column:
    b = _accuracy_flags()
    return compact(
        issue(b["first"], "invalid_format", "medium", "first_name", "First name contains invalid characters", "Remove invalid characters from first name", 0.9, 10),
        issue(b["last"], "invalid_format", "medium", "last_name", "Last name contains invalid characters", "Remove invalid characters from last name", 0.9, 10),
        issue(b["linkedin"], "invalid_format", "medium", "linkedin_url", "LinkedIn URL format is invalid", "Correct the LinkedIn URL format", 0.85, 10),
        issue(b["website"], "invalid_format", "low", "website", "Website URL format may be invalid", "Verify and correct the website URL", 0.7, 5),
        issue(b["title"], "suspicious_pattern", "high", "title", "Job title appears to be fake or placeholder", "Replace with actual job title", 0.8, 20))


def domains_related(a: Column, b: Column) -> Column:
    """DQ-7: one contains the other once a mail prefix is dropped, or the first labels are alike.

    The Arrow ratio runs only on rows the text tests leave open.
    """
    ca, cb = (F.regexp_replace(x, r"^(www\.|mail\.|email\.)", "") for x in (a, b))
    inside = ca.contains(cb) | cb.contains(ca)
    la, lb = (F.split_part(x, F.lit("."), F.lit(1)) for x in (ca, cb))
    # A ratio above .8 needs lengths within 2/3 of each other and a bounded edit distance, both tested natively.
    longest = F.greatest(F.length(la), F.length(lb))
    possible = (F.least(F.length(la), F.length(lb)) * 3 >= longest * 2) & (F.levenshtein(la, lb) * 5 <= (F.length(la) + F.length(lb)) + 1)
    # Null arguments keep decided rows out of the Arrow ratio.
    ask = ~inside & possible
    near = ratio(F.when(ask, la), F.when(ask, lb)) > 80
    return inside | F.coalesce(near, F.lit(False))


def _consistency_flags() -> dict:
    f, l, local = F.lower(w("first")), F.lower(w("last")), F.split_part(w("email_l"), F.lit("@"), F.lit(1))
    d = F.split_part(w("email_l"), F.lit("@"), F.lit(2))
    named = w("has_at") & (f != "") & ~local.contains(f) & ~local.contains(l)
    # An empty last initial is contained in everything.
    name = named & ~(local.contains(F.substring(f, 1, 1)) | local.contains(F.substring(l, 1, 1)))
    cd = w("co_domain")
    dom = w("has_at") & (cd != "") & ~d.contains(cd) & ~cd.contains(d) & ~F.col("q_related") & ~d.isin(R.FEATURE_FREE_DOMAINS)
    t, s = w("title"), w("co_size")
    excused = (any_in(t, ["ceo", "president", "founder"]) & s.contains("1-10")) | (any_in(t, ["ceo", "president"]) & s.isin("11-50", "51-200"))
    return {"name": name, "domain": dom, "title": (t != "") & (s != "") & ~excused & t.contains("director") & s.contains("1-10")}


def consistency() -> Column:
    b = _consistency_flags()
    return F.greatest(F.lit(0.0), add(F.lit(100.0), points(b["name"], -20), points(b["domain"], -10), points(b["title"], -5)))


def consistency_issues() -> Column:
    b = _consistency_flags()
    return compact(
        issue(b["name"], "inconsistent_data", "medium", "email", "Email doesn't match the person's name", "Verify email belongs to this person", 0.6, 15),
        issue(b["domain"], "inconsistent_data", "low", "email", "Email domain doesn't match company domain", "Verify email and company information", 0.5, 10),
        issue(b["title"], "inconsistent_data", "low", "title", "Director-level title in very small company", "Verify title accuracy", 0.4, 5))


def freshness() -> Column:
    a = w("age")
    return cases([(a.isNull(), 100.0), (a <= 7, 100.0), (a <= 30, 90.0), (a <= 90, 75.0), (a <= 180, 50.0), (a <= 365, 25.0)], 10.0)


def freshness_issues() -> Column:
    a = w("age")
    return compact(issue(a > 365, "outdated_data", "medium", "created_at", F.concat(F.lit("Lead data is "), a.cast("string"), F.lit(" days old")), "Verify and update lead information", 0.9, 15))


def suggestions() -> Column:
    return compact(
        say(F.col("q_email") == "", "Use email enrichment tools to find contact email"),
        say(F.col("q_email_ok") & F.lower("q_domain").isin(R.QUALITY_FREE_DOMAINS), "Consider finding a professional/corporate email address"),
        say(F.col("q_phone") == "", "Add phone number for better contact options"),
        say(company_points() < 4, "Enrich company information for better lead quality"),
        say(F.col("completeness_score") < 60, "Consider using data enrichment tools to complete missing fields"),
        say(w("age") > 365, "Consider refreshing this lead data - it's over a year old"))


SCORES = ["overall_score", "completeness_score", "accuracy_score", "consistency_score", "freshness_score", "email_quality", "phone_quality"]


def fallback_columns() -> dict:
    """DQ-28: row that cannot be assessed."""
    out = {c: F.lit(50.0) for c in SCORES}
    out["issues"] = F.array(F.struct(
        F.lit("low_confidence").alias("issue_type"), F.lit("info").alias("severity"), F.lit("system").alias("field_name"),
        F.lit("Quality assessment failed, using fallback scoring").alias("description"), F.lit("Manual review recommended").alias("suggested_fix"),
        F.lit(0.3).alias("confidence"), F.lit(0.0).alias("impact_score")))
    return {**out, "suggestions": F.array(F.lit("Manual quality review recommended")), "validation_passed": F.lit(False), "confidence": F.lit(0.3)}


def assess(df: DataFrame, as_of: str, depth: str = "standard", unreadable: Column | None = None) -> DataFrame:
    """DQ-8/11: one row per lead with scores, issues, suggestions, pass flag and confidence. Narrow.

    ``depth`` is basic, standard or comprehensive; ``unreadable`` marks rows that get the fallback report.
    """
    p = with_quality_columns(df, as_of)
    if depth == "basic":
        done = count_true(w("email") != "", w("first") != "", w("last") != "") * 100.0 / 3
        mail = cases([(w("email") == "", 50.0), (w("email").rlike(R.EMAIL_PATTERN), 80.0)], 20.0)
        p = p.withColumns({"completeness_score": done, "email_quality": mail, "accuracy_score": F.lit(75.0), "consistency_score": F.lit(75.0),
                           "freshness_score": F.lit(75.0), "phone_quality": F.lit(50.0), "issues": F.array().cast(f"array<{ISSUE}>"),
                           "suggestions": F.array().cast("array<string>"), "confidence": F.lit(0.6)})
        p = p.withColumn("overall_score", F.col("completeness_score") * 0.6 + F.col("email_quality") * 0.4)
        p = p.withColumn("validation_passed", F.col("overall_score") >= 60)
    else:
        p = p.withColumns({"email_quality": email_quality(), "phone_quality": phone_quality(), "completeness_score": completeness(),
                           "accuracy_score": accuracy(), "consistency_score": consistency(), "freshness_score": freshness()})
        issues = F.concat(email_issues(), phone_issues(), completeness_issues(), accuracy_issues(), consistency_issues(), freshness_issues())
        sug = suggestions()
        p = p.withColumns({"issues": issues, "suggestions": sug})
        k = R.QUALITY_WEIGHTS
        total = add(F.col("completeness_score") * k["completeness"], F.col("accuracy_score") * k["accuracy"], F.col("consistency_score") * k["consistency"],
                    F.col("email_quality") * k["email"], F.col("phone_quality") * k["phone"], F.col("freshness_score") * k["freshness"])
        p = p.withColumn("overall_score", clamp(total, 0, 100))
        critical = (F.col("q_email") != "") & ~F.col("q_email_ok")
        fields = count_true(w("email") != "", w("first") != "", w("last") != "", w("title") != "", has_company()) / 5.0
        conf = clamp(fields * points(critical, 0.7, 1.0) * 0.9, 0.1, 0.95)
        p = p.withColumns({"validation_passed": (F.col("overall_score") >= 60) & ~critical, "confidence": conf})
        if depth == "comprehensive":
            p = p.withColumns({"issues": F.concat("issues", advanced_issues()), "suggestions": F.concat("suggestions", industry_suggestions())})
    if unreadable is not None:
        p = p.withColumns({c: F.when(unreadable, v).otherwise(F.col(c)) for c, v in fallback_columns().items()})
    return drop_work(p).drop(*[c for c in p.columns if c.startswith("q_")])


def advanced_issues() -> Column:
    """DQ-10."""
    name = F.concat_ws(" ", w("first"), w("last"))
    seq = r"abc|123|xyz"
    rep = r"(.)\1{3,}"
    prof = F.lower(F.regexp_extract(w("linkedin"), r"linkedin\.com/in/([a-zA-Z0-9_-]+)", 1))
    f, l = F.lower(w("first")), F.lower(w("last"))
    return compact(
        issue(w("email_l").rlike(seq) | F.lower(name).rlike(seq), "suspicious_pattern", "high", "email", "Data contains suspicious sequential patterns", "Verify this is real contact information", 0.8, 25),
        issue(w("email").rlike(rep) | trimmed(name).rlike(rep), "suspicious_pattern", "medium", "name", "Repeated character patterns detected", "Verify data accuracy", 0.7, 15),
        issue((w("linkedin") != "") & ~w("linkedin").rlike(R.LINKEDIN_PATTERN), "invalid_format", "medium", "linkedin_url", "LinkedIn URL format appears invalid", "Verify and correct LinkedIn URL", 0.8, 10),
        issue((prof != "") & (f != "") & (l != "") & ~prof.contains(f) & ~prof.contains(l), "inconsistent_data", "low", "linkedin_url", "LinkedIn profile doesn't match contact name", "Verify LinkedIn profile belongs to this person", 0.6, 5))


def industry_suggestions() -> Column:
    i, t = w("co_industry"), w("title")
    return compact(
        say(any_in(i, ["tech", "software"]) & (t != "") & ~any_in(t, ["engineer", "developer", "manager", "director", "ceo", "cto", "product", "design"]), "Verify job title is accurate for technology industry"),
        say(any_in(i, ["financ", "bank"]) & (t != "") & ~any_in(t, ["analyst", "manager", "director", "advisor", "consultant", "executive"]), "Verify job title is accurate for finance industry"))


# ---- simple scorers and single-field engines ---------------------------------------------------------------------


def simple_scores() -> dict:
    """DQ-12."""
    e = w("email_l")
    mail = clamp(add(F.lit(50.0), cases([(e.rlike(r"^[a-z]+\.[a-z]+@"), 25.0), (e.rlike(r"^[a-z]+@"), 15.0)], 0.0), points(w("domain").isin(R.FEATURE_FREE_DOMAINS), -10, 20),
                     points(e.rlike("|".join(R.SUSPICIOUS_EMAILS)), -30)), 0, 100)
    n = F.length(w("phone_d"))
    return {
        "email_simple": points(w("has_at"), mail),
        "phone_simple": cases([(w("phone") == "", 0.0), (n.between(10, 15), 80.0), (n < 10, 30.0)], 50.0),
        "completeness_simple": count_true(w("first") != "", w("last") != "", w("email") != "", w("title") != "") * 25.0,
        "consistency_simple": F.when(w("has_at") & (w("first") != ""), points(F.split_part(e, F.lit("@"), F.lit(1)).contains(F.lower(w("first"))), 90, 70)).otherwise(75.0)}


def deliverability(email: Column) -> Column:
    """DQ-13."""
    e = F.coalesce(email, F.lit(""))
    ok = e.rlike(r"^[^@]+@[^@]+\.[^@]+$")
    local, domain = F.split_part(e, F.lit("@"), F.lit(1)), F.split_part(e, F.lit("@"), F.lit(2))
    disposable, role = F.lower(domain).isin(R.DISPOSABLE_DOMAINS), any_in(F.lower(local), R.ROLE_MAILBOXES)
    bad_local, dots = (F.length(local) < 1) | (F.length(local) > 64), e.contains("..")
    score = F.greatest(F.lit(0), F.lit(80) - F.when(disposable, 40).otherwise(0) - F.when(role, 20).otherwise(0) - F.when(bad_local, 20).otherwise(0) - F.when(dots, 25).otherwise(0))
    issues = compact(say(disposable, "Disposable email domain"), say(role, "Role-based email address"), say(bad_local, "Invalid local part length"), say(dots, "Consecutive dots in email"))
    return F.struct(
        (ok & (score >= 60) & ~disposable & ~role & ~bad_local & ~dots).alias("deliverable"), F.when(ok, score).otherwise(0).alias("score"),
        cases([(e == "", F.array(F.lit("Email is empty"))), (~ok, F.array(F.lit("Invalid email format")))], issues).alias("issues"),
        F.when(ok, domain).alias("domain"), F.when(ok, local).alias("local"), F.when(ok, role).alias("is_role_based"), F.when(ok, disposable).alias("is_disposable"))


def format_phone(cleaned: Column, country: Column) -> Column:
    """DQ-15."""
    n = F.length(cleaned)
    s = lambda a, k: F.substring(cleaned, a, k)
    us = country == "US/Canada"
    return cases([
        (us & (n == 11) & cleaned.startswith("1"), F.concat(F.lit("+1 ("), s(2, 3), F.lit(") "), s(5, 3), F.lit("-"), s(8, 99))),
        (us & (n == 10), F.concat(F.lit("("), s(1, 3), F.lit(") "), s(4, 3), F.lit("-"), s(7, 99))),
        (cleaned.startswith("+"), cleaned)], F.concat(F.lit("+"), cleaned))


def phone_report(phone: Column) -> Column:
    """DQ-14."""
    p = F.coalesce(phone, F.lit(""))
    c = F.regexp_replace(p, "[^0-9+]", "")
    n = F.length(c)
    country = cases([(c.startswith(k), v) for k, v in R.COUNTRY_CODES.items()], "Unknown")
    us = country.isin("US/Canada", "Unknown") & n.isin(10, 11)
    area = us & F.substring(c, -10, 1).isin("0", "1")
    fake = F.size(F.array_distinct(F.split(c, ""))) <= F.when(c == "", 99).otherwise(2)
    fake = fake | (c == "")
    seq = c.rlike("123456|234567|345678|456789|567890")
    score = (F.lit(70) + cases([(n < 7, -40), (n > 15, -30)], 0) + F.when(country != "Unknown", 10).otherwise(0)
             + F.when(us & (n == 11) & c.startswith("1"), 15).when(us & (n == 10), 10).otherwise(0) + F.when(area, -20).otherwise(0)
             + F.when(fake, -50).otherwise(0) + F.when(seq, -30).otherwise(0))
    issues = compact(cases([(n < 7, "Phone number too short"), (n > 15, "Phone number too long")], NULL), say(area, "Invalid US area code"),
                     say(fake, "Appears to be fake number"), say(seq, "Sequential number pattern"))
    empty = p == ""
    return F.struct((~empty & (score >= 50)).alias("valid"), F.when(empty, 0).otherwise(F.greatest(F.lit(0), score)).alias("score"),
                    F.when(empty, F.array(F.lit("Phone number is empty"))).otherwise(issues).alias("issues"),
                    F.when(~empty, country).alias("country"), F.when(~empty, c).alias("cleaned"), F.when(~empty, format_phone(c, country)).alias("formatted"))


# ---- six-dimension scorer ----------------------------------------------------------------------------------------

DIM_WEIGHTS = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "validity": 0.15, "freshness": 0.10, "uniqueness": 0.05}
SIX_FREE = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com"]
SIX_FAKE = r"(?i)test@test\.|example@example\.|noreply@|donotreply@|admin@|info@.*\.test"


def validators() -> dict:
    """DQ-22: valid, invalid, unknown or suspicious."""
    e, c, f, l = w("email"), w("phone_d"), w("first"), w("last")
    name = r"^[a-zA-Z\s'.-]+$"
    return {
        "email": cases([(e == "", "unknown"), (~e.rlike(R.EMAIL_PATTERN), "invalid"), (e.rlike(r"\.{2,}|^\.|\.$|@.*@"), "suspicious")], "valid"),
        "phone": cases([(w("phone") == "", "unknown"), (~F.length(c).between(10, 15), "invalid"), (c.rlike(r"^([0-9])\1+$"), "suspicious")], "valid"),
        "name": cases([((f == "") | (l == ""), "unknown"), (~f.rlike(name) | ~l.rlike(name), "invalid"), ((F.length(f) < 2) | (F.length(l) < 2), "suspicious")], "valid"),
        "linkedin": cases([(w("linkedin") == "", "unknown"), (w("linkedin").rlike(r"^https?://(www\.)?linkedin\.com/in/[a-zA-Z0-9-]+/?$"), "valid")], "invalid")}


def _filled(c: Column) -> Column:
    return trimmed(c) != ""


def six_dimensions(df: DataFrame, as_of: str, duplicates: bool = False) -> DataFrame:
    """DQ-16..23: the six scores, weighted overall, statuses, issues and improvement. Narrow.

    ``duplicates`` also lowers uniqueness for e-mails used more than once, counted by a partial aggregate and joined back.
    """
    p = prepare(df, as_of).withColumns({f"v_{k}": v for k, v in validators().items()})
    comp = (count_true(*[_filled(w(c)) for c in ("first", "last", "email")]) * 3 + count_true(_filled(w("phone")), _filled(w("title")), has_company()) * 2
            + count_true(*[_filled(w(c)) for c in ("linkedin", "source", "notes")]) + count_true(*[_filled(w(c)) for c in ("co_name", "co_industry", "co_size", "co_location")]) * 2) * 100.0 / 26
    v = lambda k, s: F.col(f"v_{k}") == s
    acc = add(F.lit(100.0), cases([(v("email", "invalid"), -25.0), (v("email", "suspicious"), -10.0)], 0.0), points((w("phone") != "") & v("phone", "invalid"), -15),
              points(v("name", "invalid"), -15), points((w("linkedin") != "") & v("linkedin", "invalid"), -10))
    d = F.lower(w("domain"))
    mism = w("has_at") & (w("co_domain") != "") & (d != w("co_domain"))
    free = w("has_at") & d.isin(SIX_FREE) & (w("co_name") != "")
    low_first, low_last = (w("first") != "") & ~w("first").rlike(r"^\p{Lu}"), (w("last") != "") & ~w("last").rlike(r"^\p{Lu}")
    cons = add(F.lit(100.0), points(mism, -15), points(free, -10), points(low_first, -5), points(low_last, -5))
    fake_mail, words = w("email").rlike(SIX_FAKE), ["test", "example", "sample", "demo", "placeholder"]
    fake_name = F.lower(w("first")).isin(words) | F.lower(w("last")).isin(words)
    short = (w("phone") != "") & (F.length(w("phone_d")) < 10)
    val = add(F.lit(100.0), points(fake_mail, -30), points(fake_name, -20), points(short, -15))
    a = w("age")
    fresh = cases([(a.isNull(), 80.0), (a > 365, 70.0), (a > 180, 85.0), (a > 90, 95.0)], 100.0)
    uniq = F.lit(95.0) + points((w("email") == "") & (w("phone") == ""), -15)
    p = p.withColumns({"completeness": comp, "accuracy": F.greatest(F.lit(0.0), acc), "consistency": F.greatest(F.lit(0.0), cons), "validity": F.greatest(F.lit(0.0), val), "freshness": fresh, "uniqueness": uniq})
    texts = compact(
        *[say(~_filled(w(c)), f"Critical field {n} is missing") for c, n in (("first", "first_name"), ("last", "last_name"), ("email", "email"))],
        *[say(~cond, f"Important field {n} is missing") for cond, n in ((_filled(w("phone")), "phone"), (_filled(w("title")), "title"), (has_company(), "company"))],
        cases([(v("email", "invalid"), "Email format is invalid"), (v("email", "suspicious"), "Email format appears suspicious")], NULL),
        say((w("phone") != "") & v("phone", "invalid"), "Phone number format is invalid"),
        say(v("name", "invalid"), "Name format appears invalid (contains numbers or special characters)"),
        say((w("linkedin") != "") & v("linkedin", "invalid"), "LinkedIn URL format is invalid"),
        say(mism, "Email domain does not match company domain"), say(fake_mail, "Email appears to be test or placeholder data"),
        say(fake_name, "Name appears to be placeholder or test data"), say(short, "Phone number appears too short"))
    execs = any_in(w("title"), ["ceo", "cto", "cfo", "president", "founder", "vice president"])
    sug = F.array_distinct(compact(
        say(F.col("completeness") < 60, "Use data enrichment tools to complete missing fields"), say(free, "Consider finding corporate email address for better lead quality"),
        say(execs & (w("co_size") == ""), "Verify company size for executive-level contacts"), say(low_first, "Standardize name capitalization"),
        cases([(a.isNull(), "Add timestamp tracking for better lead management"), (a > 365, "Consider updating lead information - data is over 1 year old"), (a > 180, "Lead data is aging - consider refreshing contact information")], NULL),
        say((w("email") == "") & (w("phone") == ""), "Add email or phone to enable duplicate detection")))
    p = p.withColumns({"issue_texts": texts, "suggestion_texts": sug})
    if duplicates:
        counts = df.where(F.col("email") != "").groupBy(F.lower("email").alias("_e")).agg(F.count("*").alias("same_email"))
        p = p.join(counts, w("email_l") == F.col("_e"), "left").drop("_e").withColumn("same_email", F.coalesce("same_email", F.lit(1)))
        p = p.withColumn("uniqueness", F.when(F.col("same_email") > 1, F.col("uniqueness") - 50).otherwise(F.col("uniqueness")))
    total = add(*[F.col(k) * x for k, x in DIM_WEIGHTS.items()])
    p = p.withColumn("_total", total).withColumns({"overall_score": F.round("_total", 2), "improvement_potential": F.round(F.greatest(F.lit(0.0), 100 - F.col("_total")), 2)})
    return drop_work(p.drop("_total"))


def ensemble(scores: dict, weights: dict) -> Column:
    """DQ-25: weighted mean of scorer columns, weights normalised to 1."""
    total = sum(weights[k] for k in scores)
    return F.round(add(*[c * (weights[k] / total) for k, c in scores.items()]), 2)


# Fixed weights of the scorers in the ensemble.
ENSEMBLE_WEIGHTS = {"rule_based": 0.4, "gradient_boosting": 0.35, "random_forest": 0.25}


def enrichment_opportunities() -> Column:
    """DQ-26: one struct per blank field; impact is the field's share of the completeness weights."""
    fields = [("first_name", w("first"), 3), ("last_name", w("last"), 3), ("email", w("email"), 3), ("title", w("title"), 2), ("phone", w("phone"), 2),
              ("linkedin_url", w("linkedin"), 1), ("website", w("website"), 1), ("company_industry", w("co_industry"), 2), ("company_size", w("co_size"), 2), ("company_location", w("co_location"), 2)]
    return compact(*[F.when(c == "", F.struct(F.lit(n).alias("field"), F.lit({3: "high", 2: "medium", 1: "low"}[k]).alias("priority"),
                                              F.lit(round(k * 100 / 26, 6)).alias("impact"), F.lit("medium" if k == 3 else "low").alias("effort"))) for n, c, k in fields])


def band(c: Column) -> Column:
    return tiers(c, [(85, "excellent"), (70, "good"), (50, "fair")], "poor")
