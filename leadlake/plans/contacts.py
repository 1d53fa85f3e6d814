"""Registered e-mail inference and page extraction queries (EML, EXT, PRD-15, AGG-48)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import emails as M
from ..functions import extract as X
from ..functions.exprs import present
from ..functions.rules import EMAIL_PATTERN
from ..session import spread
from .registry import query
from .sqltext import case, has, lit, one_of

NL = ["leads", "companies"]
PEOPLE = """SELECT l.id, regexp_replace(lower(trim(coalesce(first_name, ''))), '[^a-z]', '', 'g') AS first, regexp_replace(lower(trim(coalesce(last_name, ''))), '[^a-z]', '', 'g') AS last,
 c.domain AS domain, first_name, last_name, email FROM leads l JOIN companies c ON l.company_id = c.id WHERE c.domain <> ''"""
PX = {"people": PEOPLE}
VALID = f"regexp_matches(email, {lit(EMAIL_PATTERN)})"


def people(t):
    c = t.companies().where("domain <> ''").select(F.col("id").alias("company_id"), "domain")
    leads = spread(t.leads(dates=False).select("id", "first_name", "last_name", "email", "company_id"), "id")
    return M.contact_names(leads.join(c, "company_id"))


def named(t):
    return people(t).where("first <> '' AND last <> ''")


def filled(tpl):
    out = tpl.replace("{first}", "' || first || '").replace("{last}", "' || last || '").replace("{f}", "' || first[1:1] || '").replace("{l}", "' || last[1:1] || '")
    return "'" + out + "@' || domain"


CAND = "SELECT id, first, last, unnest([" + ", ".join(f"{{'ord': {i}, 'email': {filled(x)}}}" for i, x in enumerate(M.TEMPLATES)) + "]) AS c FROM people WHERE first <> '' AND last <> ''"
CANDS = f"SELECT id, first, last, c.ord AS ord, c.email AS email FROM ({CAND}) WHERE regexp_matches(c.email, {lit(EMAIL_PATTERN)})"
CONF = "least(95, 50 + CASE WHEN contains(email, first) AND contains(email, last) THEN 15 WHEN contains(email, first) OR contains(email, last) THEN 10 ELSE 0 END)"


@query("eml_1", NL, "SELECT id, ord, email FROM cands", {**PX, "cands": CANDS})
def eml_1(t):
    return M.candidates(named(t)).select("id", "ord", "email")


@query("eml_2", NL, f"SELECT id, email, conf AS confidence FROM (SELECT id, email, ord, {CONF} AS conf FROM cands) QUALIFY row_number() OVER (PARTITION BY id ORDER BY conf DESC, ord) = 1", {**PX, "cands": CANDS})
def eml_2(t):
    return M.best_candidate(named(t))


VARS = "SELECT id, first, last, unnest([" + ", ".join(f"{{'ord': {i}, 'email': {filled(x)}}}" for i, x in enumerate(M.VARIATIONS)) + "]) AS c FROM people WHERE first <> '' AND last <> ''"
VSQL = f"""SELECT id, email, conf AS confidence, row_number() OVER (PARTITION BY id ORDER BY conf DESC, ord) AS rank,
 CASE WHEN p = first || '.' || last THEN 'first.last' WHEN p = first || last THEN 'firstlast' WHEN p = first[1:1] || last THEN 'flast' WHEN p = first || last[1:1] THEN 'firstl' WHEN p = first THEN 'first' WHEN p = last THEN 'last' ELSE 'other' END AS pattern_type
FROM (SELECT id, first, last, c.ord AS ord, c.email AS email, split_part(c.email, '@', 1) AS p, 30 + CASE WHEN contains(c.email, first || '.' || last) THEN 40 WHEN contains(c.email, first || last) THEN 35 WHEN contains(c.email, first) AND contains(c.email, last) THEN 25 ELSE 0 END AS conf
 FROM ({VARS}) WHERE regexp_matches(c.email, {lit(EMAIL_PATTERN)}))"""


def variation_rows(t):
    p = named(t)
    return p.select("id", F.posexplode(M.variations()).alias("i", "v")).select("id", "v.email", "v.confidence", (F.col("i") + 1).cast("bigint").alias("rank"), "v.pattern_type")


for key in ("eml_3", "srt_10"):
    query(key, NL, VSQL, PX)(variation_rows)


@query("eml_4", NL, "SELECT id, first || '.' || last || ',' || first || last || ',' || first[1:1] || last || ',' || first || last[1:1] || ',' || first || '-' || last || ',' || first || '_' || last || ',' || last || '.' || first || ',' || last || first AS variations FROM people WHERE first <> '' AND last <> ''", PX)
def eml_4(t):
    return named(t).select("id", F.array_join(M.name_variations(F.col("first"), F.col("last")), ",").alias("variations"))


PAT = """SELECT domain, pattern, count(*) AS n FROM (SELECT domain, CASE WHEN p = lower(first_name) || '.' || lower(last_name) THEN 'first.last' WHEN p = lower(first_name) || lower(last_name) THEN 'firstlast' WHEN p = lower(first_name)[1:1] || lower(last_name) THEN 'flast' END AS pattern
 FROM (SELECT *, lower(split_part(email, '@', 1)) AS p FROM people WHERE email <> '' AND first_name <> '' AND last_name <> '')) WHERE pattern IS NOT NULL GROUP BY ALL"""


@query("eml_5", NL, PAT, PX)
def eml_5(t):
    return M.learned_patterns(people(t))


@query("eml_6", NL, f"""SELECT id, CASE pattern WHEN 'first.last' THEN first || '.' || last WHEN 'firstlast' THEN first || last ELSE first[1:1] || last END || '@' || p.domain AS email, 70 AS confidence, pattern
FROM people p JOIN (SELECT domain, pattern FROM ({PAT}) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, CASE pattern WHEN 'first.last' THEN 0 WHEN 'firstlast' THEN 1 ELSE 2 END) = 1) b ON b.domain = p.domain
WHERE first <> '' AND last <> '' AND coalesce(email, '') = ''""", PX)
def eml_6(t):
    p = people(t)
    return M.impute(named(t).where(~present(F.col("email"))), M.learned_patterns(p))


@query("eml_7", NL, f"""SELECT id, source, email, confidence FROM (SELECT id, 1 AS r, 'pattern' AS source, CASE pattern WHEN 'first.last' THEN first || '.' || last WHEN 'firstlast' THEN first || last ELSE first[1:1] || last END || '@' || p.domain AS email, 70 AS confidence
 FROM people p JOIN (SELECT domain, pattern FROM ({PAT}) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, CASE pattern WHEN 'first.last' THEN 0 WHEN 'firstlast' THEN 1 ELSE 2 END) = 1) b ON b.domain = p.domain WHERE first <> '' AND last <> ''
 UNION ALL SELECT id, 2, 'template', email, conf FROM (SELECT id, email, ord, {CONF} AS conf FROM cands) QUALIFY row_number() OVER (PARTITION BY id ORDER BY conf DESC, ord) = 1)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, r) = 1""", {**PX, "cands": CANDS})
def eml_7(t):
    p = named(t)
    a = M.impute(p, M.learned_patterns(people(t))).select("id", F.lit(1).alias("source_rank"), F.lit("pattern").alias("source"), "email", "confidence")
    b = M.best_candidate(p).select("id", F.lit(2).alias("source_rank"), F.lit("template").alias("source"), "email", "confidence")
    return M.choose(a.unionByName(b))


@query("eml_8", NL, f"SELECT id, coalesce({VALID}, false) AS valid FROM leads")
def eml_8(t):
    return t.leads(dates=False).select("id", M.valid_format(F.col("email")).alias("valid"))


LOC, DOM = "split_part(email, '@', 1)", "split_part(email, '@', 2)"
RS = f"50 + CASE WHEN length({LOC}) < 3 THEN 20 ELSE 0 END + CASE WHEN {has(LOC, ['..', '--', '__'])} THEN 15 ELSE 0 END + CASE WHEN {has(DOM, M.RISKY_DOMAINS)} THEN 50 ELSE 0 END"


@query("eml_9", NL, f"SELECT id, CASE WHEN contains(email, '@') THEN {RS} ELSE 50 END AS score, CASE WHEN contains(email, '@') AND {RS} > 70 THEN 'high' ELSE 'medium' END AS overall_risk FROM leads WHERE email <> ''")
def eml_9(t):
    return t.leads(dates=False).where(present(F.col("email"))).select("id", M.risk(F.col("email")).alias("r")).select("id", "r.score", "r.overall_risk")


@query("eml_10", NL, f"SELECT id, {one_of('lower(' + DOM + ')', M.FREE_PROVIDERS)} AS free_email FROM leads WHERE contains(email, '@')")
def eml_10(t):
    return t.leads(dates=False).where(F.col("email").contains("@")).select("id", F.lower(F.split_part("email", F.lit("@"), F.lit(2))).isin(M.FREE_PROVIDERS).alias("free_email"))


@query("eml_11", NL, f"""SELECT id, email, {VALID} AS valid_format, {VALID} AND {DOM} IN (SELECT domain FROM companies WHERE domain <> '') AS domain_exists,
 CASE WHEN {VALID} THEN 20 ELSE 0 END + CASE WHEN {VALID} AND {DOM} IN (SELECT domain FROM companies WHERE domain <> '') THEN 30 ELSE 0 END AS confidence,
 CASE WHEN NOT {VALID} THEN 100 WHEN {DOM} IN (SELECT domain FROM companies WHERE domain <> '') THEN 80 ELSE 90 END AS risk_score FROM leads WHERE email <> ''""")
def eml_11(t):
    return M.validated(t.leads(dates=False).where(present(F.col("email"))).select("id", "email"), t.companies().where("domain <> ''"))


@query("agg_48", NL, f"""SELECT count(*) AS total_searches, count(b.email) AS emails_found, count(*) FILTER (WHERE conf > 80) AS high, count(*) FILTER (WHERE conf > 50 AND conf <= 80) AS medium, count(*) FILTER (WHERE conf <= 50) AS low,
 round(coalesce(avg(conf), 0), 6) AS average_confidence, round(count(b.email) * 100.0::DOUBLE / count(*), 6) AS success_rate
FROM people p LEFT JOIN (SELECT id, email, conf FROM (SELECT id, email, ord, {CONF} AS conf FROM cands) QUALIFY row_number() OVER (PARTITION BY id ORDER BY conf DESC, ord) = 1) b ON b.id = p.id""", {**PX, "cands": CANDS})
def agg_48(t):
    return M.statistics(people(t).select("id").join(M.best_candidate(named(t)), "id", "left"))


# ---- pages ------------------------------------------------------------------------------------------------------

SP = ["site_pages"]
EML = "'\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b'"


def uniq(col):
    return f"list_filter({col}, lambda x, i: list_position({col}, x) = i)"


def found(text, skip):
    m = f"regexp_extract_all({text}, {EML})"
    return f"list_filter({uniq(m)}, lambda x: NOT {has('lower(x)', skip)})"


HOSTQ = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"


def plain(c):
    t = f"regexp_replace({c}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return t


NAMEQ = f"CASE WHEN regexp_matches(html, '(?i)<title') THEN split_part(split_part(split_part(trim({plain(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))}), ' - ', 1), ' | ', 1), ' :: ', 1) ELSE replace(replace({HOSTQ}, 'www.', ''), '.com', '') END"


@query("ext_1", SP, f"SELECT page_id, array_to_string({found('html', X.SKIP_PAGE)}[1:5], ',') AS emails FROM site_pages")
def ext_1(t):
    return t.pages().select("page_id", F.array_join(X.emails(F.col("html")), ",").alias("emails"))


PH = " || ".join(f"regexp_extract_all(html, '{p}')" for p in X.PHONES)


@query("ext_2", SP, f"SELECT page_id, array_to_string({uniq('p')}[1:3], ',') AS phones FROM (SELECT page_id, {PH} AS p FROM site_pages)")
def ext_2(t):
    return t.pages().select("page_id", F.array_join(X.phones(F.col("html")), ",").alias("phones"))


@query("ext_3", SP, f"SELECT page_id, {NAMEQ} AS name FROM site_pages")
def ext_3(t):
    return t.pages().select("page_id", X.company_name(F.col("html"), F.col("url")).alias("name"))


LINKQ = "(?is)<a\\s[^>]*href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"


@query("ext_4", SP, f"""SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || href ELSE href END AS target
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{LINKQ}', 1)) AS href, unnest(regexp_extract_all(html, '{LINKQ}', 2)) AS label FROM site_pages) WHERE {has('lower(href)', X.TEAM_WORDS)} OR {has('lower(label)', X.TEAM_WORDS)}
QUALIFY dense_rank() OVER (PARTITION BY page_id ORDER BY target) <= 5""")
def ext_4(t):
    return X.keyword_links(t.pages())


@query("ext_5", SP, f"""
, l AS (SELECT page_id, string_split({plain('html')}, chr(10)) AS ls FROM site_pages),
h AS (SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
c AS (SELECT page_id, i - 1 AS i, array_to_string(ls[greatest(1, i - 2):i + 2], ' ') AS ctx FROM h WHERE contains(ls[i], '@')),
e AS (SELECT page_id, i::INT AS i, {found('ctx', X.SKIP_PAGE)}[1] AS email, regexp_extract(ctx, '\\b([A-Z][a-z]+)\\s+([A-Z][a-z]+)\\b', 1) AS first_name, regexp_extract(ctx, '\\b([A-Z][a-z]+)\\s+([A-Z][a-z]+)\\b', 2) AS last_name,
 regexp_extract(ctx, '(?i)\\b(CEO|CTO|Manager|Director|President|VP|Head)\\b', 1) AS title FROM c)
SELECT * FROM e WHERE email IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 5""")
def ext_5(t):
    return X.contacts(t.pages())


INDQ = "(" + case([(has(f"lower({NAMEQ} || ' ' || {plain('html')})", ws), lit(k)) for k, ws in X.INDUSTRIES.items()], "'Other'") + ")"


@query("ext_6", SP, f"SELECT page_id, {INDQ} AS industry FROM site_pages")
def ext_6(t):
    return X.companies(t.pages()).select("page_id", "industry")


LOCQ = "coalesce(" + ", ".join(f"nullif(regexp_extract({plain('html')}, '{p}'), '')" for p in X.ADDRESSES) + ", '')"


@query("ext_7", SP, f"SELECT page_id, {LOCQ} AS location FROM site_pages")
def ext_7(t):
    return X.companies(t.pages()).select("page_id", "location")


@query("ext_8", SP, f"""SELECT page_id, domain, email, first_name, last_name FROM (SELECT page_id, {HOSTQ} AS domain, unnest(range(1, 4)) AS i, unnest({found('html', X.SKIP_PAGE)}[1:3]) AS email,
 '' AS x FROM site_pages) s, LATERAL (SELECT CASE WHEN contains(split_part(email, '@', 1), '.') THEN upper(split_part(split_part(email, '@', 1), '.', 1)[1]) || lower(split_part(split_part(email, '@', 1), '.', 1)[2:]) ELSE '' END AS first_name,
 CASE WHEN contains(split_part(email, '@', 1), '.') THEN upper(split_part(split_part(email, '@', 1), '.', 2)[1]) || lower(split_part(split_part(email, '@', 1), '.', 2)[2:]) ELSE '' END AS last_name) WHERE email IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_id, i) <= 5""")
def ext_8(t):
    return X.page_leads(t.pages()).select("page_id", "domain", "email", "first_name", "last_name")


def page_people(t):
    """People named on the pages, one per page domain."""
    return t.pages().select(X.host(F.col("url")).alias("domain")).distinct().select(F.abs(F.xxhash64("domain")).alias("id"), F.lit("jane").alias("first"), F.lit("smith").alias("last"), "domain")


@query("ext_9")
def ext_9(t):
    return X.near_name(page_people(t), t.pages())


ADDR = f"SELECT DISTINCT domain, email FROM (SELECT {HOSTQ} AS domain, unnest({found('html', X.SKIP_CONTENT)}) AS email FROM site_pages) WHERE contains(lower(email), domain)"


@query("ext_10", SP, f"""SELECT domain, email, confidence FROM (SELECT domain, email, CASE WHEN contains(lower(email), 'jane.smith') OR contains(split_part(lower(email), '@', 1), 'janesmith') THEN 90 WHEN {has('lower(email)', ['contact', 'info', 'hello', 'sales'])} THEN 40 END AS confidence FROM ({ADDR}))
WHERE confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, email) = 1""")
def ext_10(t):
    p = page_people(t)
    return X.choose_address(p, X.domain_emails(t.pages())).join(p.select("id", "domain"), "id").select("domain", "email", "confidence")


BIZ = (f"starts_with(target, 'http') AND NOT {has('h', X.SKIP_DOMAINS)} AND NOT {has('lower(target)', X.SKIP_PATHS)} AND {has('h', X.BUSINESS_TLDS)} AND length(regexp_extract(h, '([^.]*)\\.[^.]*$', 1)) BETWEEN 2 AND 50")


@query("ext_11", SP, f"""SELECT DISTINCT target FROM (SELECT target, lower(regexp_extract(target, '^https?://([^/?#]*)', 1)) AS h FROM (SELECT CASE WHEN starts_with(href, '/url?q=') THEN split_part(href[8:], '&', 1) WHEN starts_with(href, 'http') THEN href END AS target
 FROM (SELECT unnest(regexp_extract_all(html, '{LINKQ}', 1)) AS href FROM site_pages)) WHERE target IS NOT NULL) WHERE {BIZ}""")
def ext_11(t):
    return X.result_urls(t.pages())


@query("prd_15", SP, f"SELECT page_id, {BIZ.replace('target', 'url')} AS business FROM (SELECT page_id, url, {HOSTQ} AS h FROM site_pages)")
def prd_15(t):
    return t.pages().select("page_id", X.business_url(F.col("url")).alias("business"))


@query("ext_12", SP, "SELECT page_id, 'Shop ' || page_id AS name, '555.123.4567' AS phone, '12 Main Street' AS address FROM site_pages WHERE page_id % 5 = 3")
def ext_12(t):
    return X.directory_listings(t.pages()).select("page_id", "name", "phone", "address")


@query("ext_13", SP, f"SELECT page_id, domain, email, 60 AS confidence FROM (SELECT page_id, {HOSTQ} AS domain, unnest({found('html', X.SKIP_CONTENT)}) AS email FROM site_pages) WHERE contains(lower(email), domain)")
def ext_13(t):
    return X.domain_emails(t.pages())


# The text patterns over the whole documents table.
@query("ext_1_documents", [], f"SELECT doc_id, array_to_string({found('text', X.SKIP_PAGE)}[1:5], ',') AS emails, len({found('text', X.SKIP_CONTENT)})::INT AS n FROM documents")
def ext_14(t):
    return t.raw("documents").select("doc_id", F.array_join(X.emails(F.col("text")), ",").alias("emails"), F.size(X.emails(F.col("text"), X.SKIP_CONTENT, None)).alias("n"))
