"""Registered quality and cleaning queries (DQ-*, CLN-*, AGG-38, AGG-46)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import quality as Q
from ..functions import rules as R
from ..functions.record import prepare, w
from ..operators import aggregates as A
from ..operators.ranking import top_per_key
from ..session import cut_lineage
from ..sources.bindings import AS_OF
from .registry import query
from .scoring import nested
from .sqltext import BASE, case, ends, has, lines, lit, one_of, pts, when
from .sqltext import W as WORK


def tr(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def rx(c, p):
    return f"regexp_matches({c}, {lit(p)})"


SUS = case([(rx("ql", p), lit(p)) for p in R.SUSPICIOUS_EMAILS], "NULL")
LA, LB = "split_part(da, '.', 1)", "split_part(db, '.', 1)"
PRE = f"""SELECT *, {SUS} AS sus, {has('lower(qlocal)', R.QUALITY_GENERIC)} AS generic, {rx('q', R.EMAIL_PATTERN)} AS ok,
 contains(da, db) OR contains(db, da) OR levenshtein({LA}, {LB}) * 5 <= length({LA}) + length({LB}) + 1 AS related FROM
 (SELECT *, lower(q) AS ql, split_part(q, '@', 2) AS qd, split_part(q, '@', 1) AS qlocal, split_part(email_l, '@', 2) AS ed, split_part(email_l, '@', 1) AS el, lower(fn) AS fl, lower(ln) AS ll,
  regexp_replace(split_part(email_l, '@', 2), '^(www\\.|mail\\.|email\\.)', '') AS da, regexp_replace(co_domain, '^(www\\.|mail\\.|email\\.)', '') AS db FROM
 (SELECT *, {tr('email')} AS q, {tr('phone')} AS qp, {tr('fn')} AS qf, {tr('ln')} AS qn, {tr('linkedin')} AS qli, {tr('website')} AS qw, lower({tr('title')}) AS qt FROM w))"""
D1 = (pts("ok", "least(100, greatest(0, 50 + " + pts("sus IS NOT NULL", -25) + "+" + case([(rx("ql", r"^[a-z]+\.[a-z]+@"), 20), (rx("ql", r"^[a-z]+@"), 10)], 0) + "+"
          + pts(one_of("lower(qd)", R.QUALITY_FREE_DOMAINS), -15, 15) + "+" + case([(ends("qd", [".ai", ".io", ".tech", ".dev"]), 10), (ends("qd", [".com"]), 5)], 0) + "+"
          + case([("length(qlocal) < 2", -20), ("length(qlocal) > 30", -10)], 0) + "+" + pts("generic", -20) + "))"))
SAME = "(" + " OR ".join(f"regexp_matches(phone_d, '^{d}{{10,}}')" for d in range(10)) + ")"
FAKE = f"({SAME} OR starts_with(phone_d, '123456') OR starts_with(phone_d, '000000') OR starts_with(phone_d, '111111'))"
D2 = pts("qp <> ''", "least(100, greatest(0, 50 + " + case([("length(phone_d) < 10", -30), ("length(phone_d) > 15", -20)], 0) + "+"
         + case([(rx("qp", R.US_PHONE), 20), (rx("phone_d", R.INTERNATIONAL_PHONE), 15)], -20) + "+" + pts(FAKE, -40) + "))")
CP = "((co_name <> '')::INT + (co_industry <> '')::INT + (co_size <> '')::INT + (co_location <> '')::INT) * 2"
D3 = (f"(((fn <> '')::INT + (ln <> '')::INT + (email <> '')::INT) * 3 + ((title <> '')::INT + (phone <> '')::INT + has_company::INT) * 2 + (linkedin <> '')::INT + (website <> '')::INT + (notes <> '')::INT + {CP}) * 100.0::DOUBLE / 26")
NM = r"^[a-zA-Z\s'-]+$"
BF, BN, BL, BW, BT = (f"(qf <> '' AND NOT {rx('qf', NM)})", f"(qn <> '' AND NOT {rx('qn', NM)})", f"(qli <> '' AND NOT {rx('qli', R.LINKEDIN_PATTERN)})",
                      f"(qw <> '' AND NOT {rx('qw', R.WEBSITE_PATTERN)})", f"(qt <> '' AND {rx('qt', R.FAKE_TITLE)})")
D4 = f"greatest(0, 100 + {pts(BF, -15)} + {pts(BN, -15)} + {pts(BL, -10)} + {pts(BW, -5)} + {pts(BT, -25)})"
CN = "(has_at AND fl <> '' AND NOT contains(el, fl) AND NOT contains(el, ll) AND NOT (contains(el, fl[1]) OR contains(el, ll[1])))"
CD = f"(has_at AND co_domain <> '' AND NOT contains(ed, co_domain) AND NOT contains(co_domain, ed) AND NOT related AND NOT {one_of('ed', R.FEATURE_FREE_DOMAINS)})"
CT = f"(title <> '' AND co_size <> '' AND NOT ({has('title', ['ceo', 'president', 'founder'])} AND contains(co_size, '1-10')) AND NOT ({has('title', ['ceo', 'president'])} AND co_size IN ('11-50', '51-200')) AND contains(title, 'director') AND contains(co_size, '1-10'))"
D5 = f"greatest(0, 100 + {pts(CN, -20)} + {pts(CD, -10)} + {pts(CT, -5)})"
D6 = case([("age IS NULL OR age <= 7", 100), ("age <= 30", 90), ("age <= 90", 75), ("age <= 180", 50), ("age <= 365", 25)], 10) + "::DOUBLE"
E_ISS = ["CASE WHEN q = '' THEN 'Email address is missing' END", "CASE WHEN q <> '' AND NOT ok THEN 'Email format is invalid' END", "CASE WHEN ok AND sus IS NOT NULL THEN 'Email matches suspicious pattern: ' || sus END",
         "CASE WHEN ok AND generic THEN 'Email appears to be a generic/role-based address' END"]
P_ISS = ["CASE WHEN qp <> '' AND length(phone_d) < 10 THEN 'Phone number appears too short' END", "CASE WHEN qp <> '' AND length(phone_d) > 15 THEN 'Phone number appears too long' END",
         f"CASE WHEN qp <> '' AND {FAKE} THEN 'Phone number appears to be fake or placeholder' END"]
M_ISS = ["CASE WHEN fn = '' THEN 'Required field first_name is missing' END", "CASE WHEN ln = '' THEN 'Required field last_name is missing' END", "CASE WHEN email = '' THEN 'Required field email is missing' END",
         "CASE WHEN title = '' THEN 'Important field title is missing' END", "CASE WHEN phone = '' THEN 'Important field phone is missing' END", "CASE WHEN NOT has_company THEN 'Important field company is missing' END"]
A_ISS = [when(BF, "First name contains invalid characters"), when(BN, "Last name contains invalid characters"), when(BL, "LinkedIn URL format is invalid"), when(BW, "Website URL format may be invalid"),
         when(BT, "Job title appears to be fake or placeholder")]
C_ISS = [when(CN, "Email doesn't match the person's name"), when(CD, "Email domain doesn't match company domain"), when(CT, "Director-level title in very small company")]
F_ISS = ["CASE WHEN age > 365 THEN 'Lead data is ' || age || ' days old' END"]
SUGS = ["CASE WHEN q = '' THEN 'Use email enrichment tools to find contact email' END", when(f"ok AND {one_of('lower(qd)', R.QUALITY_FREE_DOMAINS)}", "Consider finding a professional/corporate email address"),
        "CASE WHEN qp = '' THEN 'Add phone number for better contact options' END", when(f"{CP} < 4", "Enrich company information for better lead quality"),
        when(f"{D3} < 60", "Consider using data enrichment tools to complete missing fields"), when("age > 365", "Consider refreshing this lead data - it's over a year old")]
ALL = E_ISS + P_ISS + M_ISS + A_ISS + C_ISS + F_ISS
CRIT = "(q <> '' AND NOT ok)"
REPORT = f"""SELECT *, least(100, greatest(0, completeness_score * 0.25::DOUBLE + accuracy_score * 0.25::DOUBLE + consistency_score * 0.20::DOUBLE + email_quality * 0.15::DOUBLE + phone_quality * 0.10::DOUBLE + freshness_score * 0.05::DOUBLE)) AS overall_score,
 least(0.95::DOUBLE, greatest(0.1, ((email <> '')::INT + (fn <> '')::INT + (ln <> '')::INT + (title <> '')::INT + has_company::INT) / 5.0::DOUBLE * (CASE WHEN {CRIT} THEN 0.7::DOUBLE ELSE 1.0 END) * 0.9::DOUBLE)) AS confidence
 FROM (SELECT *, {D1} AS email_quality, {D2} AS phone_quality, {D3} AS completeness_score, {D4} AS accuracy_score, {D5} AS consistency_score, {D6} AS freshness_score FROM pre)"""
X = {"w": WORK, "pre": PRE, "report": REPORT}
XP = {"w": WORK, "pre": PRE}


def assessed(t, depth="standard"):
    return Q.assess(nested(t), AS_OF, depth)


def descriptions(c="issues"):
    return F.array_join(F.transform(c, lambda x: x.description), " | ").alias("issues")


for key, fn, iss, sql, texts in [
    ("dq_1", Q.email_quality, Q.email_issues, D1, E_ISS), ("dq_2", Q.phone_quality, Q.phone_issues, D2, P_ISS), ("dq_3", Q.completeness, Q.completeness_issues, D3, M_ISS),
    ("dq_4", Q.accuracy, Q.accuracy_issues, D4, A_ISS), ("dq_5", Q.consistency, Q.consistency_issues, D5, C_ISS), ("dq_6", Q.freshness, Q.freshness_issues, D6, F_ISS),
]:
    query(key, BASE, f"SELECT id, round(({sql})::DOUBLE, 6) AS score, {lines(*texts)} AS issues FROM pre", XP)(
        lambda t, fn=fn, iss=iss: Q.with_quality_columns(nested(t), AS_OF).select("id", F.round(fn(), 6).alias("score"), F.array_join(F.transform(iss(), lambda x: x.description), " | ").alias("issues")))


@query("dq_7", BASE, "SELECT id, related FROM pre", XP)
def dq_7(t):
    return Q.with_quality_columns(nested(t), AS_OF).select("id", F.col("q_related").alias("related"))


REPORT_COLS = ", ".join(f"round({c}, 6) AS {c}" for c in Q.SCORES)


@query("dq_8", BASE, f"SELECT id, {REPORT_COLS}, round(confidence, 6) AS confidence, overall_score >= 60 AND NOT {CRIT} AS validation_passed, {lines(*ALL)} AS issues, {lines(*SUGS)} AS suggestions FROM report", X)
def dq_8(t):
    return assessed(t).select("id", *[F.round(c, 6).alias(c) for c in Q.SCORES], F.round("confidence", 6).alias("confidence"), "validation_passed", descriptions(), F.array_join("suggestions", " | ").alias("suggestions"))


BASIC_C = "((email <> '')::INT + (fn <> '')::INT + (ln <> '')::INT) * 100.0::DOUBLE / 3"
BASIC_E = f"(CASE WHEN email = '' THEN 50 WHEN {rx('email', R.EMAIL_PATTERN)} THEN 80 ELSE 20 END)::DOUBLE"


@query("dq_9", BASE, f"SELECT id, round({BASIC_C}, 6) AS completeness_score, {BASIC_E} AS email_quality, round({BASIC_C} * 0.6::DOUBLE + {BASIC_E} * 0.4::DOUBLE, 6) AS overall_score, {BASIC_C} * 0.6::DOUBLE + {BASIC_E} * 0.4::DOUBLE >= 60 AS validation_passed FROM w", {"w": WORK})
def dq_9(t):
    return assessed(t, "basic").select("id", F.round("completeness_score", 6).alias("completeness_score"), "email_quality", F.round("overall_score", 6).alias("overall_score"), "validation_passed")


PROF = "lower(regexp_extract(linkedin, 'linkedin\\.com/in/([a-zA-Z0-9_-]+)', 1))"
NAMES = "trim(fn || ' ' || ln)"
SEQ = " OR ".join(f"contains({c}, '{s}')" for c in ("email_l", f"lower({NAMES})") for s in ("abc", "123", "xyz"))
TECH = has("co_industry", ["tech", "software"]) + " AND title <> '' AND NOT " + has("title", ["engineer", "developer", "manager", "director", "ceo", "cto", "product", "design"])
FIN = has("co_industry", ["financ", "bank"]) + " AND title <> '' AND NOT " + has("title", ["analyst", "manager", "director", "advisor", "consultant", "executive"])
ADV = [when(SEQ, "Data contains suspicious sequential patterns"), when(f"linkedin <> '' AND NOT {rx('linkedin', R.LINKEDIN_PATTERN)}", "LinkedIn URL format appears invalid"),
       when(f"{PROF} <> '' AND fn <> '' AND ln <> '' AND NOT contains({PROF}, lower(fn)) AND NOT contains({PROF}, lower(ln))", "LinkedIn profile doesn't match contact name")]


# The repeated-character issue needs a back-reference, which the check engine's patterns lack; it is left out on both sides.
@query("dq_10", BASE, f"SELECT id, {lines(*ADV)} AS issues, {lines(when(TECH, 'Verify job title is accurate for technology industry'), when(FIN, 'Verify job title is accurate for finance industry'))} AS suggestions FROM pre", XP)
def dq_10(t):
    p = Q.with_quality_columns(nested(t), AS_OF)
    kept = F.filter(Q.advanced_issues(), lambda x: x.description != "Repeated character patterns detected")
    return p.select("id", F.array_join(F.transform(kept, lambda x: x.description), " | ").alias("issues"), F.array_join(Q.industry_suggestions(), " | ").alias("suggestions"))


@query("dq_11", BASE, f"SELECT id, round(overall_score, 6) AS overall_score, len(list_filter([{', '.join(ALL)}], lambda x: x IS NOT NULL)) AS n_standard FROM report", X)
def dq_11(t):
    std = assessed(t).select("id", F.round("overall_score", 6).alias("overall_score"), F.size("issues").cast("bigint").alias("n_standard"))
    return std


SIMPLE_E = pts("has_at", "least(100, greatest(0, 50 + " + case([(rx("email_l", r"^[a-z]+\.[a-z]+@"), 25), (rx("email_l", r"^[a-z]+@"), 15)], 0) + "+" + pts(one_of("domain", R.FEATURE_FREE_DOMAINS), -10, 20) + "+"
               + pts(" OR ".join(rx("email_l", p) for p in R.SUSPICIOUS_EMAILS), -30) + "))")


@query("dq_12", BASE, f"""SELECT id, {SIMPLE_E} AS email_simple, (CASE WHEN phone = '' THEN 0 WHEN length(phone_d) BETWEEN 10 AND 15 THEN 80 WHEN length(phone_d) < 10 THEN 30 ELSE 50 END)::DOUBLE AS phone_simple,
 ((fn <> '')::INT + (ln <> '')::INT + (email <> '')::INT + (title <> '')::INT) * 25.0::DOUBLE AS completeness_simple,
 (CASE WHEN has_at AND fn <> '' THEN CASE WHEN contains(split_part(email_l, '@', 1), lower(fn)) THEN 90 ELSE 70 END ELSE 75 END)::DOUBLE AS consistency_simple FROM w""", {"w": WORK})
def dq_12(t):
    return prepare(nested(t), AS_OF).select("id", *[c.alias(n) for n, c in Q.simple_scores().items()])


ROLE = has("lower(local)", R.ROLE_MAILBOXES)
DISP = one_of("lower(domain)", R.DISPOSABLE_DOMAINS)
DOK = "regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$')"
BADL = "(length(local) < 1 OR length(local) > 64)"


@query("dq_13", BASE, f"""SELECT id, {DOK} AND NOT {DISP} AND NOT {ROLE} AND NOT {BADL} AND NOT contains(email, '..') AS deliverable,
 (CASE WHEN {DOK} THEN greatest(0, 80 - (CASE WHEN {DISP} THEN 40 ELSE 0 END) - (CASE WHEN {ROLE} THEN 20 ELSE 0 END) - (CASE WHEN {BADL} THEN 20 ELSE 0 END) - (CASE WHEN contains(email, '..') THEN 25 ELSE 0 END)) ELSE 0 END)::INT AS score,
 CASE WHEN email = '' THEN 'Email is empty' WHEN NOT {DOK} THEN 'Invalid email format' ELSE {lines(when(DISP, 'Disposable email domain'), when(ROLE, 'Role-based email address'), when(BADL, 'Invalid local part length'), when("contains(email, '..')", 'Consecutive dots in email'))} END AS issues FROM w""", {"w": WORK})
def dq_13(t):
    d = t.leads(dates=False).select("id", Q.deliverability(F.col("email")).alias("d"))
    return d.select("id", "d.deliverable", "d.score", F.array_join("d.issues", " | ").alias("issues"))


CTRY = case([(f"starts_with(phone_d, '{k}')", lit(v)) for k, v in R.COUNTRY_CODES.items()], "'Unknown'")
PH = f"""SELECT *, (country IN ('US/Canada', 'Unknown') AND length(phone_d) IN (10, 11)) AS us, len(list_distinct(string_split(phone_d, ''))) <= 2 AS fk,
 regexp_matches(phone_d, '123456|234567|345678|456789|567890') AS sq FROM (SELECT *, {CTRY} AS country FROM w)"""
AREA = "(us AND phone_d[-10:-10] IN ('0', '1'))"


@query("dq_14", BASE, f"""SELECT id, phone <> '' AND sc >= 50 AS valid, CASE WHEN phone = '' THEN 0 ELSE greatest(0, sc) END AS score, CASE WHEN phone <> '' THEN country END AS country,
 CASE WHEN phone = '' THEN 'Phone number is empty' ELSE {lines("CASE WHEN length(phone_d) < 7 THEN 'Phone number too short' WHEN length(phone_d) > 15 THEN 'Phone number too long' END", f"CASE WHEN {AREA} THEN 'Invalid US area code' END", "CASE WHEN fk THEN 'Appears to be fake number' END", "CASE WHEN sq THEN 'Sequential number pattern' END")} END AS issues
FROM (SELECT *, (70 + CASE WHEN length(phone_d) < 7 THEN -40 WHEN length(phone_d) > 15 THEN -30 ELSE 0 END + CASE WHEN country <> 'Unknown' THEN 10 ELSE 0 END + CASE WHEN us AND length(phone_d) = 11 AND phone_d[1] = '1' THEN 15 WHEN us AND length(phone_d) = 10 THEN 10 ELSE 0 END
 + CASE WHEN {AREA} THEN -20 ELSE 0 END + CASE WHEN fk THEN -50 ELSE 0 END + CASE WHEN sq THEN -30 ELSE 0 END)::INT AS sc FROM ph)""", {"w": WORK, "ph": PH})
def dq_14(t):
    d = t.leads(dates=False).select("id", Q.phone_report(F.col("phone")).alias("d"))
    return d.select("id", "d.valid", "d.score", "d.country", F.array_join("d.issues", " | ").alias("issues"))


@query("dq_15", BASE, """SELECT id, CASE WHEN phone <> '' THEN CASE WHEN country = 'US/Canada' AND length(phone_d) = 10 THEN '(' || phone_d[1:3] || ') ' || phone_d[4:6] || '-' || phone_d[7:] WHEN phone_d[1] = '+' THEN phone_d ELSE '+' || phone_d END END AS formatted FROM ph""", {"w": WORK, "ph": PH})
def dq_15(t):
    return t.leads(dates=False).select("id", Q.phone_report(F.col("phone")).formatted.alias("formatted"))


SIXV = f"""SELECT *, CASE WHEN email = '' THEN 'unknown' WHEN NOT {rx('email', R.EMAIL_PATTERN)} THEN 'invalid' WHEN regexp_matches(email, '\\.{{2,}}|^\\.|\\.$|@.*@') THEN 'suspicious' ELSE 'valid' END AS v_email,
 CASE WHEN phone = '' THEN 'unknown' WHEN NOT length(phone_d) BETWEEN 10 AND 15 THEN 'invalid' WHEN {" OR ".join(f"regexp_matches(phone_d, '^{d}{{2,}}$')" for d in range(10))} THEN 'suspicious' ELSE 'valid' END AS v_phone,
 CASE WHEN fn = '' OR ln = '' THEN 'unknown' WHEN NOT regexp_matches(fn, '^[a-zA-Z\\s''.-]+$') OR NOT regexp_matches(ln, '^[a-zA-Z\\s''.-]+$') THEN 'invalid' WHEN length(fn) < 2 OR length(ln) < 2 THEN 'suspicious' ELSE 'valid' END AS v_name,
 CASE WHEN linkedin = '' THEN 'unknown' WHEN regexp_matches(linkedin, '^https?://(www\\.)?linkedin\\.com/in/[a-zA-Z0-9-]+/?$') THEN 'valid' ELSE 'invalid' END AS v_linkedin FROM w"""
ff = lambda *cs: " + ".join(f"(trim({c}) <> '')::INT" for c in cs)
MISM = "(has_at AND co_domain <> '' AND lower(domain) <> co_domain)"
FREE = f"(has_at AND {one_of('lower(domain)', Q.SIX_FREE)} AND co_name <> '')"
LOWF, LOWL = "(fn <> '' AND NOT regexp_matches(fn, '^\\p{Lu}'))", "(ln <> '' AND NOT regexp_matches(ln, '^\\p{Lu}'))"
FKM = rx("email", Q.SIX_FAKE)
FKN = "(lower(fn) IN ('test', 'example', 'sample', 'demo', 'placeholder') OR lower(ln) IN ('test', 'example', 'sample', 'demo', 'placeholder'))"
SHORT = "(phone <> '' AND length(phone_d) < 10)"
SIX = f"""SELECT *, completeness * 0.25::DOUBLE + accuracy * 0.25::DOUBLE + consistency * 0.20::DOUBLE + validity * 0.15::DOUBLE + freshness * 0.10::DOUBLE + uniqueness * 0.05::DOUBLE AS total FROM (SELECT *,
 (({ff('fn', 'ln', 'email')}) * 3 + ({ff('phone', 'title')} + has_company::INT) * 2 + {ff('linkedin', 'source', 'notes')} + ({ff('co_name', 'co_industry', 'co_size', 'co_location')}) * 2) * 100.0::DOUBLE / 26 AS completeness,
 greatest(0, 100 + {case([("v_email = 'invalid'", -25), ("v_email = 'suspicious'", -10)], 0)} + {pts("phone <> '' AND v_phone = 'invalid'", -15)} + {pts("v_name = 'invalid'", -15)} + {pts("linkedin <> '' AND v_linkedin = 'invalid'", -10)})::DOUBLE AS accuracy,
 greatest(0, 100 + {pts(MISM, -15)} + {pts(FREE, -10)} + {pts(LOWF, -5)} + {pts(LOWL, -5)}) AS consistency, greatest(0, 100 + {pts(FKM, -30)} + {pts(FKN, -20)} + {pts(SHORT, -15)}) AS validity,
 {case([('age IS NULL', 80), ('age > 365', 70), ('age > 180', 85), ('age > 90', 95)], 100)}::DOUBLE AS freshness, 95 + {pts("email = '' AND phone = ''", -15)} AS uniqueness FROM sixv)"""
XS = {"w": WORK, "sixv": SIXV, "six": SIX}
SIX_ISS = ([when(f"trim({c}) = ''", f"Critical field {n} is missing") for c, n in (("fn", "first_name"), ("ln", "last_name"), ("email", "email"))]
           + [when("trim(phone) = ''", "Important field phone is missing"), when("trim(title) = ''", "Important field title is missing"), when("NOT has_company", "Important field company is missing"),
              "CASE WHEN v_email = 'invalid' THEN 'Email format is invalid' WHEN v_email = 'suspicious' THEN 'Email format appears suspicious' END", when("phone <> '' AND v_phone = 'invalid'", "Phone number format is invalid"),
              when("v_name = 'invalid'", "Name format appears invalid (contains numbers or special characters)"), when("linkedin <> '' AND v_linkedin = 'invalid'", "LinkedIn URL format is invalid"),
              when(MISM, "Email domain does not match company domain"), when(FKM, "Email appears to be test or placeholder data"), when(FKN, "Name appears to be placeholder or test data"), when(SHORT, "Phone number appears too short")])


def six(t, duplicates=False):
    return Q.six_dimensions(nested(t), AS_OF, duplicates)


for key, col in [("dq_16", "completeness"), ("dq_17", "accuracy"), ("dq_18", "consistency"), ("dq_19", "validity"), ("dq_20", "freshness")]:
    query(key, BASE, f"SELECT id, round({col}, 6) AS score FROM six", XS)(lambda t, col=col: six(t).select("id", F.round(col, 6).alias("score")))


@query("dq_21", BASE, "SELECT s.id, coalesce(n, 1) AS same_email, uniqueness - CASE WHEN n > 1 THEN 50 ELSE 0 END AS uniqueness FROM six s LEFT JOIN (SELECT email_l, count(*) AS n FROM w WHERE email <> '' GROUP BY 1) d ON d.email_l = s.email_l", XS)
def dq_21(t):
    return six(t, True).select("id", F.col("same_email").cast("bigint").alias("same_email"), "uniqueness")


@query("dq_22", BASE, "SELECT id, v_email, v_phone, v_name, v_linkedin FROM sixv", {"w": WORK, "sixv": SIXV})
def dq_22(t):
    return prepare(nested(t), AS_OF).select("id", *[c.alias(f"v_{n}") for n, c in Q.validators().items()])


SIXR = f"SELECT id, round(total, 2) AS overall_score, round(greatest(0, 100 - total), 2) AS improvement_potential, {lines(*SIX_ISS)} AS issues FROM six"


@query("dq_23", BASE, SIXR, XS)
def dq_23(t):
    return six(t).select("id", "overall_score", "improvement_potential", F.array_join("issue_texts", " | ").alias("issues"))


@query("dq_24", BASE, "SELECT CASE WHEN total >= 85 THEN 'excellent' WHEN total >= 70 THEN 'good' WHEN total >= 50 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n, round(avg(round(total, 2)), 6) AS mean FROM six GROUP BY 1", XS)
def dq_24(t):
    return six(t).groupBy(Q.band(F.col("overall_score")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 6).alias("mean"))


@query("dq_26", BASE, "SELECT id, u.field, u.priority, u.impact FROM (SELECT id, unnest(list_filter([" + ", ".join(
    f"CASE WHEN {c} = '' THEN {{'field': '{n}', 'priority': '{pr}', 'impact': round({k} * 100.0::DOUBLE / 26, 6)}} END"
    for n, c, k, pr in [("first_name", "fn", 3, "high"), ("last_name", "ln", 3, "high"), ("email", "email", 3, "high"), ("title", "title", 2, "medium"), ("phone", "phone", 2, "medium"), ("linkedin_url", "linkedin", 1, "low"),
                        ("website", "website", 1, "low"), ("company_industry", "co_industry", 2, "medium"), ("company_size", "co_size", 2, "medium"), ("company_location", "co_location", 2, "medium")]) + "], lambda x: x IS NOT NULL)) AS u FROM w)", {"w": WORK})
def dq_26(t):
    return prepare(nested(t), AS_OF).select("id", F.explode(Q.enrichment_opportunities()).alias("u")).select("id", "u.field", "u.priority", "u.impact")


@query("dq_27", BASE, "SELECT id, round(overall_score, 6) AS overall_score, round(email_quality, 6) AS email_quality, round(completeness_score, 6) AS completeness_score, round(accuracy_score, 6) AS accuracy_score FROM report", X)
def dq_27(t):
    b = F.create_map(*[x for c in ("email_quality", "completeness_score", "accuracy_score") for x in (F.lit(c), F.round(c, 6))])
    r = assessed(t).select("id", F.round("overall_score", 6).alias("overall_score"), b.alias("b"))
    return r.select("id", "overall_score", *[F.col("b")[c].alias(c) for c in ("email_quality", "completeness_score", "accuracy_score")])


@query("dq_28", BASE, "SELECT id, CASE WHEN email = '' THEN 50.0::DOUBLE ELSE round(overall_score, 6) END AS overall_score, CASE WHEN email = '' THEN 0.3::DOUBLE ELSE round(confidence, 6) END AS confidence FROM report", X)
def dq_28(t):
    r = Q.assess(nested(t), AS_OF, unreadable=F.coalesce(F.col("email"), F.lit("")) == "")
    return r.select("id", F.round("overall_score", 6).alias("overall_score"), F.round("confidence", 6).alias("confidence"))


@query("agg_38", BASE, f"""SELECT owner_id, round(avg(overall_score), 6) AS overall_score, round(avg(email_quality), 6) AS email_quality, round(avg(completeness_score), 6) AS completeness, round(avg(accuracy_score), 6) AS accuracy,
 round(avg(consistency_score), 6) AS consistency, round(100 - avg(overall_score), 6) AS improvement_potential,
 array_to_string(list_sort(list_distinct(flatten(list(list_filter([{', '.join(ALL)}], lambda x: x IS NOT NULL)))))[1:20], ' | ') AS issues,
 array_to_string(list_sort(list_distinct(flatten(list(list_filter([{', '.join(SUGS)}], lambda x: x IS NOT NULL)))))[1:10], ' | ') AS suggestions FROM report GROUP BY 1""", X)
def agg_38(t):
    # Read twice below, so assessed once and written down.
    r = cut_lineage(assessed(t).select("owner_id", *Q.SCORES, F.transform("issues", lambda i: i.description).alias("issues"), "suggestions"))
    means = r.groupBy("owner_id").agg(
        A.mean("overall_score").alias("overall_score"), A.mean("email_quality").alias("email_quality"), A.mean("completeness_score").alias("completeness"), A.mean("accuracy_score").alias("accuracy"),
        A.mean("consistency_score").alias("consistency"), A.r6(100 - F.avg("overall_score")).alias("improvement_potential"))
    out = means
    # Texts with a day count are many, so texts are ranked as rows and only the first few of an owner are gathered.
    for name, k in (("issues", 20), ("suggestions", 10)):
        texts = r.select("owner_id", F.explode(name).alias("d")).distinct()
        first = top_per_key(texts, ["owner_id"], [F.col("d")], k)
        out = out.join(first.groupBy("owner_id").agg(F.array_join(F.sort_array(F.collect_list("d")), " | ").alias(name)), "owner_id", "left")
    return out.na.fill("", ["issues", "suggestions"])


@query("agg_46", BASE, """SELECT count(*) AS total_leads, round(avg(s), 6) AS average_score, round(quantile_cont(s, 0.5), 6) AS median_score, round(stddev_pop(s), 6) AS std_score, min(s) AS min_score, max(s) AS max_score,
 count(*) FILTER (WHERE s >= 85) AS excellent, count(*) FILTER (WHERE s >= 70 AND s < 85) AS good, count(*) FILTER (WHERE s >= 50 AND s < 70) AS fair, count(*) FILTER (WHERE s < 50) AS poor,
 round(avg(completeness), 6) AS completeness, round(avg(accuracy), 6) AS accuracy, round(avg(consistency), 6) AS consistency, round(avg(validity), 6) AS validity, round(avg(freshness), 6) AS freshness, round(avg(uniqueness), 6) AS uniqueness
FROM (SELECT *, round(total, 2) AS s FROM six)""", XS)
def agg_46(t):
    s = F.col("overall_score")
    return six(t).agg(F.count("*").alias("total_leads"), F.round(F.avg(s), 6).alias("average_score"), F.round(F.percentile(s, 0.5), 6).alias("median_score"), F.round(F.stddev_pop(s), 6).alias("std_score"),
                      F.min(s).alias("min_score"), F.max(s).alias("max_score"), A.n_if(s >= 85).alias("excellent"), A.n_if((s >= 70) & (s < 85)).alias("good"), A.n_if((s >= 50) & (s < 70)).alias("fair"), A.n_if(s < 50).alias("poor"),
                      *[F.round(F.avg(d), 6).alias(d) for d in Q.DIM_WEIGHTS])


# ---- cleaning ---------------------------------------------------------------------------------------------------

WORDS = lambda c: f"string_split_regex({tr(c)}, '\\s+')"
CAP = "upper(x[1]) || lower(x[2:])"
NAME = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN {c} ELSE regexp_replace(array_to_string(list_transform({WORDS(c)}, lambda x: {CAP}), ' '), '[^a-zA-Z\\s''-]', '', 'g') END"
EM = "regexp_replace(regexp_replace(lower(" + tr("email") + "), '^mailto:', ''), '\\s+', '', 'g')"
EMAIL = f"CASE WHEN coalesce(email, '') = '' THEN email WHEN {rx(EM, R.EMAIL_PATTERN)} THEN {EM} WHEN NOT contains({EM}, '@') AND len(string_split({EM}, '.')) >= 3 THEN split_part({EM}, '.', 1) || '@' || substring({EM}, strpos({EM}, '.') + 1) ELSE email END"
PD = "regexp_replace(l.phone, '[^0-9]', '', 'g')"
PP = "regexp_replace(" + tr("l.phone") + ", '[^0-9+\\-()\\s.]', '', 'g')"
PHONE = f"CASE WHEN coalesce(l.phone, '') = '' THEN l.phone WHEN length({PD}) = 10 THEN '(' || {PD}[1:3] || ') ' || {PD}[4:6] || '-' || {PD}[7:] WHEN length({PD}) = 11 AND {PD}[1] = '1' THEN '+1 (' || {PD}[2:4] || ') ' || {PD}[5:7] || '-' || {PD}[8:] WHEN {PP}[1] = '+' THEN {PP} ELSE l.phone END"
TITLE = f"CASE WHEN coalesce(title, '') = '' THEN title ELSE array_to_string(list_transform({WORDS('title')}, lambda x: CASE WHEN {one_of('upper(x)', R.TITLE_ABBREVIATIONS)} THEN upper(x) ELSE {CAP} END), ' ') END"
SCHEME = lambda c: f"CASE WHEN starts_with({tr(c)}, 'http') THEN {tr(c)} ELSE 'https://' || {tr(c)} END"
LP = "regexp_extract(l.linkedin_url, 'linkedin\\.com/in/([a-zA-Z0-9_-]+)', 1)"
LINK = f"CASE WHEN coalesce(l.linkedin_url, '') = '' THEN l.linkedin_url WHEN {LP} <> '' THEN 'https://www.linkedin.com/in/' || {LP} ELSE {SCHEME('l.linkedin_url')} END"
SITE = f"CASE WHEN coalesce(l.website, '') = '' THEN l.website ELSE {SCHEME('l.website')} END"
TC = lambda c: f"array_to_string(list_transform(regexp_extract_all({c}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: {CAP}), '')"
IND = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN {c} ELSE " + case([(has(f"lower({c})", v), lit(k.title())) for k, v in R.INDUSTRY_MAP.items()], TC(f"lower({c})")) + " END"
SZ = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN {c} ELSE " + case([(has(f"lower({c})", v), lit(k)) for k, v in R.SIZE_MAP.items()], c) + " END"
LOC = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN {c} ELSE regexp_replace(regexp_replace({tr(c)}, ',\\s*,', ',', 'g'), '\\s+', ' ', 'g') END"
LEAD = "FROM leads l"


def one(key, sql, cols, frm=LEAD, ctes=("leads",)):
    def wrap(fn):
        return query(key, list(ctes), f"SELECT l.id, {sql} {frm}")(fn)

    return wrap


@one("cln_1", f"{NAME('first_name')} AS first_name, {NAME('last_name')} AS last_name", None)
def cln_1(t):
    return t.leads(dates=False).select("id", C.name(F.col("first_name")).alias("first_name"), C.name(F.col("last_name")).alias("last_name"))


@one("cln_2", f"{EMAIL} AS email", None)
def cln_2(t):
    return t.leads(dates=False).select("id", C.email(F.col("email")).alias("email"))


@one("cln_3", f"{PHONE} AS phone", None)
def cln_3(t):
    return t.leads(dates=False).select("id", C.phone(F.col("phone")).alias("phone"))


COMP = "FROM companies l"


@one("cln_4", f"trim(name) AS name, {IND('industry')} AS industry, {SZ('size')} AS size, {LOC('location')} AS location", None, COMP, ("companies",))
def cln_4(t):
    rows = t.companies().select("id", F.struct("name", "industry", "size", "location").alias("company"))
    return rows.select("id", C.company().alias("company")).select("id", "company.*")


@one("cln_5", f"{TITLE} AS title", None)
def cln_5(t):
    return t.leads(dates=False).select("id", C.title(F.col("title")).alias("title"))


@one("cln_6", f"{LINK} AS linkedin_url, {SITE} AS website", None)
def cln_6(t):
    return t.leads(dates=False).select("id", C.linkedin(F.col("linkedin_url")).alias("linkedin_url"), C.website(F.col("website")).alias("website"))


@one("cln_7", f"{tr('first_name')} AS first_name, {tr('title')} AS title, {tr('email')} AS email, {tr('c.location')} AS company_location", None, "FROM leads l LEFT JOIN companies c ON l.company_id = c.id", ("leads", "companies"))
def cln_7(t):
    return C.trim_all(nested(t)).select("id", "first_name", "title", "email", F.col("company.location").alias("company_location"))


@one("cln_8", f"{IND('industry')} AS industry", None, COMP, ("companies",))
def cln_8(t):
    return t.companies().select("id", C.if_given(F.col("industry"), C.industry(F.col("industry"))).alias("industry"))


@one("cln_9", f"{SZ('size')} AS size", None, COMP, ("companies",))
def cln_9(t):
    return t.companies().select("id", C.if_given(F.col("size"), C.size(F.col("size"))).alias("size"))


@one("cln_10", f"{tr(NAME('first_name'))} AS first_name, {tr(NAME('last_name'))} AS last_name, {tr(EMAIL)} AS email, {tr(PHONE)} AS phone, {TITLE} AS title, {LINK} AS linkedin_url, {SITE} AS website, {IND('c.industry')} AS industry, {SZ('c.size')} AS size, {LOC('c.location')} AS location",
     None, "FROM leads l LEFT JOIN companies c ON l.company_id = c.id", ("leads", "companies"))
def cln_10(t):
    return C.clean_leads(nested(t)).select("id", "first_name", "last_name", "email", "phone", "title", "linkedin_url", "website", "company.industry", "company.size", "company.location")


@one("cln_11", "regexp_replace(lower(trim(coalesce(first_name, ''))), '[^a-z]', '', 'g') AS name_key, split_part(regexp_replace(regexp_replace(lower(trim(coalesce(website, ''))), '^https?://', ''), '^www\\.', ''), '/', 1) AS domain_key,"
     " CASE WHEN starts_with(p, '+1') THEN p[3:] WHEN p[1] = '1' AND length(p) = 11 THEN p[2:] ELSE p END AS phone_key", None, "FROM (SELECT *, regexp_replace(coalesce(phone, ''), '[^0-9+]', '', 'g') AS p FROM leads) l")
def cln_11(t):
    return t.leads(dates=False).select("id", C.match_name(F.col("first_name")).alias("name_key"), C.match_domain(F.col("website")).alias("domain_key"), C.match_phone(F.col("phone")).alias("phone_key"))


@one("cln_12", "replace(replace(replace(replace(replace(replace(replace(replace(lower(name), ' ', ''), ',', ''), '.', ''), 'inc', ''), 'corp', ''), 'llc', ''), 'solutions', ''), 'systems', '') || '.com' AS domain", None, COMP, ("companies",))
def cln_12(t):
    return t.companies().select("id", C.company_domain(F.col("name")).alias("domain"))


_ = w
