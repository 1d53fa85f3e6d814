"""Contact-shaped views over the driver's parquet tables.

Each view is a list of ``(column, expression)`` pairs in the SQL subset Spark and DuckDB share, so that the
same definition feeds the Spark query and, as a CTE, its check query. Nothing is generated: every column is a
function of the given tables, and the views grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def _cases(key: str, values: list) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values)
    )
    return f"CASE {key} % {len(values)} {arms} END"


def _q(*values) -> list:
    return [None if v is None else "'" + v.replace("'", "''") + "'" for v in values]


# Copies of one person: rows 20k+1 and 20k+2 repeat the person of row 20k.
_PERSON = "(c_custkey - CASE WHEN c_custkey % 20 IN (1, 2) THEN c_custkey % 20 ELSE 0 END)"

_FIRST = _cases("pk", _q("Anna", "john", "MARIA", "Jean-Luc", "", "Wei", "Test", "Olga", " Sam ", "Chris", "Li", "Zoë"))
_LAST = _cases("(pk + pk % 7)", _q("Smith", "O'Neil", "doe", "Garcia", None, "Chen", "Example", "Müller", "Novak", "Kim"))
_TITLE = _cases(
    "pk",
    _q(
        "CEO", "Chief Technology Officer", "director of sales", "VP Engineering", "Senior Software Engineer",
        "Product Manager", "Head of Data", "Analyst", "", None, "test  engineer", "12345", "Founder & President",
        "Marketing Lead", "Retail Associate", "Vice President of Growth Strategy", "Owner", "Consultant", "hr specialist",
    ),
)
_HOST = _cases(
    "c_nationkey",
    _q("acme.com", "novalabs.ai", "data-works.io", "bigbank24.net", "orbit.org", "mail.greenfield.co", "shopz.de"),
)
_MAILBOX = "lower(replace(trim(coalesce(first_name, '')), '-', '')) || '.' || lower(replace(coalesce(last_name, 'x'), '''', ''))"

PERSON_STAGE = [
    ("id", "c_custkey"),
    ("pk", _PERSON),
    ("owner_id", "CAST(n_regionkey AS BIGINT)"),
    ("company_id", "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END"),
    ("campaign_id", "c_custkey % 10"),
    ("c_nationkey", "c_nationkey"),
    ("c_acctbal", "c_acctbal"),
    ("c_mktsegment", "c_mktsegment"),
]
NAME_STAGE = [("*", None), ("first_name", _FIRST), ("last_name", _LAST), ("title", _TITLE), ("host", _HOST)]
LEAD_COLUMNS = [
    ("id", "id"),
    ("first_name", "first_name"),
    ("last_name", "last_name"),
    (
        "email",
        "CASE pk % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'info@' || host"
        " WHEN 3 THEN 'contact.' || host"
        " WHEN 4 THEN 'test' || pk || '@10minutemail.com'"
        " WHEN 5 THEN 'u' || pk || '@gmail.com'"
        " WHEN 6 THEN upper(last_name) || '@' || host"
        " WHEN 7 THEN 'jo@@' || host"
        " WHEN 8 THEN 'a..b' || pk || '@' || host"
        f" ELSE {_MAILBOX} || '@' || host END",
    ),
    (
        "phone",
        "CASE pk % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '+1 (555) 123-' || (1000 + pk % 9000)"
        " WHEN 3 THEN '555987' || (1000 + pk % 9000) WHEN 4 THEN '123-456-7890'"
        " WHEN 5 THEN '+44 20 7946 ' || (1000 + pk % 9000) WHEN 6 THEN '123' WHEN 7 THEN '1111111111'"
        " ELSE '+49 30 ' || (100000 + pk % 900000) END",
    ),
    ("title", "title"),
    (
        "linkedin_url",
        "CASE pk % 7 WHEN 0 THEN NULL WHEN 1 THEN ''"
        f" WHEN 2 THEN 'https://www.linkedin.com/in/' || {_MAILBOX}"
        " WHEN 3 THEN 'linkedin.com/in/user-' || pk WHEN 4 THEN 'https://linkedin.com/company/acme'"
        " WHEN 5 THEN 'http://example.com/profile' ELSE 'https://linkedin.com/in/john-smith-1a2b3c4d' END",
    ),
    ("twitter_url", "CASE WHEN id % 5 = 0 THEN 'https://twitter.com/u' || id END"),
    ("github_url", "CASE WHEN id % 6 = 0 THEN 'https://github.com/u' || id END"),
    ("facebook_url", "CASE WHEN id % 8 = 0 THEN 'https://facebook.com/u' || id END"),
    ("website", _cases("id", _q("https://www.acme.com", "acme.com", "", None, "ftp://x", "https://novalabs.ai/about"))),
    (
        "source",
        "CASE WHEN id % 7 = 0 THEN NULL ELSE "
        + _cases("id", _q("linkedin", "referral", "website", "event", "purchased"))
        + " END",
    ),
    (
        "status",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'converted' WHEN 'AUTOMOBILE' THEN 'qualified'"
        " WHEN 'MACHINERY' THEN 'contacted' WHEN 'HOUSEHOLD' THEN 'new' ELSE 'rejected' END",
    ),
    ("score", "CAST(floor((c_acctbal + 1000) / CAST(11 AS DOUBLE)) AS DOUBLE) / CAST(10 AS DOUBLE)"),
    ("notes", "CASE WHEN id % 4 = 0 THEN 'met at event' END"),
    ("owner_id", "owner_id"),
    ("campaign_id", "campaign_id"),
    ("company_id", "company_id"),
]
DATE_COLUMNS = [("created_at", "created_at"), ("updated_at", "updated_at")]

COMPANY_COLUMNS = [
    ("id", "CAST(n_nationkey AS BIGINT)"),
    (
        "name",
        _cases("n_nationkey", _q("Acme Corp", "Nova Labs Inc", "Data Works", "Big Bank", "Orbit LLC", "Greenfield", "Shopz GmbH"))
        + " || CASE WHEN n_nationkey < 7 THEN '' ELSE ' ' || n_nationkey END",
    ),
    (
        "domain",
        _cases("n_nationkey", _q("acme.com", "novalabs.ai", "data-works.io", "bigbank24.net", "", "greenfield.co", "shopz.de")),
    ),
    (
        "industry",
        _cases(
            "n_nationkey",
            _q("Artificial Intelligence", "SaaS", "Fintech", "Retail", "Hospitality", "Technology", "Healthcare", "Banking",
               "e-commerce", "", "Manufacturing", "Clean Energy", "legal services"),
        ),
    ),
    (
        "size",
        _cases("n_nationkey", _q("1-10", "11-50", "51-200", "201-500", "501-1000", "1000+", "", "startup", "5000+", "very large")),
    ),
    (
        "location",
        _cases(
            "n_nationkey",
            _q("San Francisco, CA", "London, UK", "Berlin, Germany", "Paris, France", "New York, USA", "Remote - Canada",
               "Warsaw, Poland", "Nowhere", "", "Chicago,, IL", "Stockholm,  Sweden"),
        ),
    ),
    ("website", _cases("n_nationkey", _q("https://acme.com", "http://novalabs.ai", "", "https://bigbank24.net"))),
    (
        "description",
        _cases(
            "n_nationkey",
            _q("Leading provider of innovative services, series b funded and hiring across all regions", "short text",
               "Established in 1990 with expertise in banking and long lasting customer relationships", "", "growing venture"),
        ),
    ),
    ("linkedin_url", _cases("n_nationkey", _q("https://linkedin.com/company/acme", "", None))),
    ("phone", _cases("n_nationkey", _q("+1 555 000 1111", None, ""))),
    ("revenue", _cases("n_nationkey", _q("$5 Million", "", "$10M+", "unknown"))),
    ("technologies", _cases("n_nationkey", _q('["spark","sql"]', "[]", '["java","python","spark","kafka","sql","go","rust","c","r","scala","php","perl"]'))),
    ("social_media", _cases("n_nationkey", _q('{"twitter":"a","github":"b"}', "{}", '{"facebook":"c"}', '{"twitter":"a","github":"b","facebook":"c"}'))),
]

CAMPAIGN_COLUMNS = [
    ("id", "CAST(n_nationkey AS BIGINT)"),
    ("name", "'campaign ' || n_nationkey"),
    ("status", _cases("n_nationkey", _q("active", "paused", "draft"))),
    ("campaign_type", _cases("n_nationkey", _q("enterprise", "smb", None))),
    ("target_region", _cases("n_nationkey", _q("USA", "Germany", None, "UK"))),
    ("target_industry", _cases("n_nationkey", _q("SaaS", None, "Retail", "Technology", "Fintech"))),
    ("urgent", "n_nationkey % 2 = 0"),
    ("owner_id", "CAST(n_regionkey AS BIGINT)"),
]

PREDICTION_COLUMNS = [
    ("id", "event_id"),
    ("lead_id", "user_id"),
    ("model_type", "event_type"),
    ("model_version", "'v' || (event_id % 3)"),
    ("prediction_score", "least(CAST(100 AS DOUBLE), value / CAST(4.9 AS DOUBLE))"),
    ("confidence", "CAST(event_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE)"),
    ("processing_time_ms", "value"),
    ("created_at", "ts"),
]

LOG_COLUMNS = [
    ("id", "event_id"),
    ("user_id", "user_id"),
    ("operation_type", "event_type"),
    ("model_name", "event_type || '_model'"),
    ("processing_status", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'started' ELSE 'completed' END"),
    ("start_time", "ts"),
    ("processing_duration_ms", "value"),
    ("cpu_usage_percent", "CAST(event_id % 90 AS DOUBLE)"),
    ("memory_usage_mb", "CAST(event_id % 500 AS DOUBLE)"),
]

FEEDBACK_COLUMNS = [
    ("id", "event_id"),
    ("prediction_id", "event_id"),
    ("user_id", "user_id"),
    ("rating", "CAST(1 + event_id % 5 AS INT)"),
    ("is_helpful", "event_id % 2 = 0"),
    ("is_accurate", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 3 = 0 END"),
    (
        "actual_outcome",
        _cases(
            "event_id",
            _q("converted", "qualified", "interested", "responded", "contacted", "no_response", "rejected", "unqualified", "other"),
        ),
    ),
    ("created_at", "ts"),
]

QUALITY_COLUMNS = [
    ("id", "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey % 100000) * 1000 + l_suppkey % 1000"),
    ("lead_id", "o_custkey"),
    ("overall_score", "l_quantity * 2"),
    ("email_quality_score", "l_discount * 1000"),
    ("completeness_score", "100 - l_tax * 1000"),
    ("accuracy_score", "l_quantity + 50"),
    ("consistency_score", "100 - l_quantity"),
    ("freshness_score", "100 - l_discount * 500"),
    (
        "issues_found",
        "CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN '[broken' WHEN (l_orderkey + l_linenumber) % 89 = 0 THEN NULL"
        " ELSE '[\"flag ' || l_returnflag || '\",\"status ' || l_linestatus || '\"]' END",
    ),
    ("created_at", "l_shipdate"),
]

INSIGHT_COLUMNS = [
    ("id", "o_orderkey"),
    ("lead_id", "o_custkey"),
    ("insight_type", "CASE WHEN o_orderkey % 3 = 0 THEN 'timing' ELSE 'priority' END"),
    ("insight_text", "'insight ' || o_orderkey"),
    (
        "priority_level",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium'"
        " WHEN '5' THEN 'low' END",
    ),
    ("confidence_score", "CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE)"),
    ("impact_score", "o_totalprice / 5000"),
    ("status", "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'resolved' ELSE 'dismissed' END"),
    ("created_at", "o_orderdate"),
]

MODEL_COLUMNS = [
    ("id", "CAST(p_partkey AS BIGINT)"),
    ("model_name", _cases("p_partkey", _q("click_classifier", "view_ranker", "purchase_forest", "signup_boost", "error_net"))
     + " || '_' || (p_partkey % 50)"),
    ("purpose", _cases("p_partkey", _q("priority", "quality", "conversion", "similarity", "timing"))),
    ("model_type", _cases("p_partkey", _q("classifier", "ranker", "forest", "boost", "net"))),
    ("version", "'1.' || (p_partkey % 7)"),
    ("accuracy", "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) END"),
    ("f1_score", "CAST((p_size * 7) % 50 AS DOUBLE) / CAST(50 AS DOUBLE)"),
    ("r2_score", "CAST((p_size * 3) % 50 AS DOUBLE) / CAST(50 AS DOUBLE)"),
    ("is_active", "p_partkey % 20 < 3"),
    ("predictions_made", "p_partkey % 1000"),
]

# Runs of model evaluation, one per conversation turn.
RUN_COLUMNS = [
    ("run_id", "conv_id * 1000 + turn"),
    ("purpose", "CASE conv_id % 3 WHEN 0 THEN 'priority' WHEN 1 THEN 'quality' ELSE 'conversion' END"),
    ("accuracy", "CAST((conv_id * 7 + turn * 3) % 40 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.6 AS DOUBLE)"),
    ("f1_score", "CAST((conv_id * 5 + turn) % 40 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.55 AS DOUBLE)"),
    ("mae", "CAST((conv_id * 3 + turn) % 20 AS DOUBLE)"),
    ("r2_score", "CAST((conv_id * 11 + turn) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)"),
    ("auc", "CAST((conv_id * 13 + turn) % 35 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.65 AS DOUBLE)"),
]


# Pages with a contact block appended whose form depends on the page.
_HOSTNAME = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
PAGE_COLUMNS = [
    ("page_id", "page_id"),
    ("url", "url"),
    (
        "html",
        "html || CASE page_id % 5"
        " WHEN 0 THEN chr(10) || 'Jane Smith' || chr(10) || 'Sales Manager' || chr(10) || 'jane.smith@' || " + _HOSTNAME + " || chr(10) || 'call 555-123-4567'"
        " WHEN 1 THEN '<p>Reach us: info@' || " + _HOSTNAME + " || ' or noreply@' || " + _HOSTNAME + " || ' (555) 987-6543, +1 555 000 1111</p><a href=\"/about/team\">Our Team</a>'"
        " WHEN 2 THEN chr(10) || 'Springfield, IL 62704' || chr(10) || '<a href=\"https://www.acme' || page_id || '.com/x\">partner</a><a href=\"/url?q=https://shop' || page_id || '.io/a&amp;s=1\">r</a>'"
        " WHEN 3 THEN '<div class=\"result\"><a class=\"business-name\" href=\"#\">Shop ' || page_id || '</a><div class=\"phones\">555.123.4567</div><div class=\"street-address\">12 Main Street</div></div><!--end-->'"
        " ELSE '<p>no contact, software and data</p>' END",
    ),
]


def _exprs(columns) -> list:
    return ["*" if e is None else f"{e} AS {n}" for n, e in columns]


def _sql(columns) -> str:
    return ", ".join(_exprs(columns))


class Tables:
    """The driver tables of one scale directory seen as contact tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def leads(self, dates: bool = True) -> DataFrame:
        """``dates=False`` leaves out created/updated and with them the pass over orders."""
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        base = self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        staged = base.selectExpr(*_exprs(PERSON_STAGE)).selectExpr(*_exprs(NAME_STAGE))
        if not dates:
            return staged.selectExpr(*_exprs(LEAD_COLUMNS))
        span = (
            self.raw("orders")
            .groupBy(F.col("o_custkey").alias("k"))
            .agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"))
        )
        staged = staged.join(span, F.col("id") == F.col("k"), "left")
        return staged.selectExpr(*_exprs(LEAD_COLUMNS + DATE_COLUMNS))

    def companies(self) -> DataFrame:
        return self.raw("nation").selectExpr(*_exprs(COMPANY_COLUMNS))

    def campaigns(self) -> DataFrame:
        return self.raw("nation").selectExpr(*_exprs(CAMPAIGN_COLUMNS))

    def predictions(self) -> DataFrame:
        return self.raw("events").selectExpr(*_exprs(PREDICTION_COLUMNS))

    def processing_log(self) -> DataFrame:
        return self.raw("events").selectExpr(*_exprs(LOG_COLUMNS))

    def feedback(self) -> DataFrame:
        return self.raw("events").selectExpr(*_exprs(FEEDBACK_COLUMNS))

    def quality_scores(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        joined = self.raw("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.selectExpr(*_exprs(QUALITY_COLUMNS))

    def insights(self) -> DataFrame:
        return self.raw("orders").selectExpr(*_exprs(INSIGHT_COLUMNS))

    def models(self) -> DataFrame:
        return self.raw("part").selectExpr(*_exprs(MODEL_COLUMNS))

    def pages(self) -> DataFrame:
        return self.raw("pages").selectExpr(*_exprs(PAGE_COLUMNS))

    def runs(self) -> DataFrame:
        return self.raw("conversations").selectExpr(*_exprs(RUN_COLUMNS))


# The same views as CTE text for the check queries.
CTE = {
    "leads": (
        f"SELECT {_sql(LEAD_COLUMNS + DATE_COLUMNS)} FROM (SELECT {_sql(NAME_STAGE)} FROM (SELECT {_sql(PERSON_STAGE)}"
        " FROM customer JOIN nation ON c_nationkey = n_nationkey)) s LEFT JOIN (SELECT o_custkey AS k,"
        " min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at FROM orders GROUP BY o_custkey) d ON s.id = d.k"
    ),
    "companies": f"SELECT {_sql(COMPANY_COLUMNS)} FROM nation",
    "campaigns": f"SELECT {_sql(CAMPAIGN_COLUMNS)} FROM nation",
    "predictions": f"SELECT {_sql(PREDICTION_COLUMNS)} FROM events",
    "processing_log": f"SELECT {_sql(LOG_COLUMNS)} FROM events",
    "feedback": f"SELECT {_sql(FEEDBACK_COLUMNS)} FROM events",
    "quality_scores": f"SELECT {_sql(QUALITY_COLUMNS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "insights": f"SELECT {_sql(INSIGHT_COLUMNS)} FROM orders",
    "models": f"SELECT {_sql(MODEL_COLUMNS)} FROM part",
    "site_pages": f"SELECT {_sql(PAGE_COLUMNS)} FROM pages",
    "runs": f"SELECT {_sql(RUN_COLUMNS)} FROM conversations",
}


def with_ctes(names: list[str], sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` may open with a comma to add CTEs of its own."""
    parts = [f"{n} AS ({CTE[n]})" for n in names] + [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {sql.strip()}" if parts else sql.strip()
