"""The nested lead record and the working columns every rule family reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exprs import age_days, count_true, text, words_in

LEAD_TEXT = ["first_name", "last_name", "email", "phone", "title", "linkedin_url", "twitter_url", "github_url",
             "facebook_url", "website", "source", "status", "notes"]
COMPANY_TEXT = ["name", "domain", "industry", "size", "location", "website", "description", "linkedin_url", "phone", "revenue"]
WORK = "w_"


def with_company(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """JN-3: left join leads to their company as a struct; null where there is none.

    No broadcast hint: the planner broadcasts the company side only below its size threshold and sorts otherwise.
    """
    packed = companies.select(
        F.col("id").alias("_company_id"),
        F.struct(
            F.col("id"),
            *[F.col(c) for c in COMPANY_TEXT],
            F.from_json("technologies", "array<string>").alias("technologies"),
            F.from_json("social_media", "map<string,string>").alias("social_media"),
        ).alias("company"),
    )
    return leads.join(packed, F.col("company_id") == F.col("_company_id"), "left").drop("_company_id")


def normalize(leads: DataFrame) -> DataFrame:
    """PRD-11: null text to '', null score to 0, null company to an empty company."""
    company = F.struct(
        F.col("company.id").alias("id"),
        *[text(F.col(f"company.{c}")).alias(c) for c in COMPANY_TEXT],
        F.coalesce("company.technologies", F.array().cast("array<string>")).alias("technologies"),
        F.coalesce("company.social_media", F.create_map().cast("map<string,string>")).alias("social_media"),
    )
    cols = {c: text(F.col(c)) for c in LEAD_TEXT if c in leads.columns}
    cols["score"] = F.coalesce("score", F.lit(0.0))
    cols["company"] = company
    return leads.withColumns({k: v for k, v in cols.items() if k in leads.columns})


def prepare(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Add ``w_*`` columns, each computed once and read by many rules."""
    have = set(df.columns)

    def lead(c):
        return text(F.col(c)) if c in have else F.lit("")

    def company(c):
        return text(F.col(f"company.{c}"))

    work = {
        "first": lead("first_name"),
        "last": lead("last_name"),
        "email": lead("email"),
        "email_l": F.lower(lead("email")),
        "local": F.split_part(lead("email"), F.lit("@"), F.lit(1)),
        "domain": F.split_part(lead("email"), F.lit("@"), F.lit(2)),
        "has_at": lead("email").contains("@"),
        "phone": lead("phone"),
        "phone_d": F.regexp_replace(lead("phone"), "[^0-9+]", ""),
        "title": F.lower(lead("title")),
        "title_words": words_in(lead("title")),
        "linkedin": lead("linkedin_url"),
        "linkedin_l": F.lower(lead("linkedin_url")),
        "twitter": lead("twitter_url"),
        "github": lead("github_url"),
        "facebook": lead("facebook_url"),
        "website": lead("website"),
        "notes": lead("notes"),
        "source": F.lower(lead("source")),
        # A company without any value counts as none.
        "has_company": F.coalesce("company.id", *[F.when(F.col(f"company.{c}").isNotNull(), 1) for c in COMPANY_TEXT]).isNotNull(),
        "co_name": company("name"),
        "co_domain": F.lower(company("domain")),
        "co_industry": F.lower(company("industry")),
        "co_size": company("size"),
        "co_location": F.lower(company("location")),
        "co_website": company("website"),
        "co_description": F.lower(company("description")),
        "co_revenue": F.lower(company("revenue")),
        "co_tech": F.coalesce(F.size(F.coalesce("company.technologies", F.array().cast("array<string>"))), F.lit(0)),
        "co_social": F.coalesce(F.size(F.map_keys(F.coalesce("company.social_media", F.create_map().cast("map<string,string>")))), F.lit(0)),
    }
    filled = [work[k] for k in ("first", "last", "email", "phone", "title", "linkedin", "co_name", "co_domain",
                                "co_industry", "co_size", "co_location")]
    work["methods"] = count_true(work["email"] != "", work["phone"] != "", work["linkedin"] != "")
    work["complete"] = F.round(count_true(*[c != "" for c in filled]) * 100.0 / 11, 1)
    if as_of is not None and "created_at" in have:
        work["age"] = age_days(F.col("created_at"), as_of)
    return df.withColumns({WORK + k: v for k, v in work.items()})


def w(name: str):
    return F.col(WORK + name)


def drop_work(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(WORK)])
