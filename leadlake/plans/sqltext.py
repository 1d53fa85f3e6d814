"""Pieces of check SQL shared by the rule families."""

from __future__ import annotations

from ..sources.bindings import AS_OF


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def one_of(col: str, words) -> str:
    return f"{col} IN ({', '.join(lit(w) for w in words)})"


def ends(col: str, tails) -> str:
    return "(" + " OR ".join(f"suffix({col}, {lit(t)})" for t in tails) + ")"


def case(arms, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + f" ELSE {otherwise} END"


def pts(cond: str, yes, no=0) -> str:
    return f"(CASE WHEN {cond} THEN {yes}::DOUBLE ELSE {no}::DOUBLE END)"


def lines(*items: str, sep: str = " | ") -> str:
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), '{sep}')"


def when(cond: str, message: str) -> str:
    return f"CASE WHEN {cond} THEN {lit(message)} END"


W = f"""
SELECT *, (email <> '')::INT + (phone <> '')::INT + (linkedin <> '')::INT AS methods,
 round(((fn <> '')::INT + (ln <> '')::INT + (email <> '')::INT + (phone <> '')::INT + (title <> '')::INT + (linkedin <> '')::INT + (co_name <> '')::INT + (co_domain <> '')::INT
  + (co_industry <> '')::INT + (co_size <> '')::INT + (co_location <> '')::INT) * 100.0::DOUBLE / 11, 1) AS complete
FROM (SELECT l.id, l.owner_id, l.campaign_id, l.title AS raw_title, l.source AS raw_source, l.created_at, l.status, l.score, c.id IS NOT NULL AS has_company,
 coalesce(first_name, '') AS fn, coalesce(last_name, '') AS ln, coalesce(email, '') AS email, lower(coalesce(email, '')) AS email_l,
 split_part(coalesce(email, ''), '@', 1) AS local, split_part(coalesce(email, ''), '@', 2) AS domain, contains(coalesce(email, ''), '@') AS has_at,
 coalesce(l.phone, '') AS phone, regexp_replace(coalesce(l.phone, ''), '[^0-9+]', '', 'g') AS phone_d, lower(coalesce(title, '')) AS title,
 CASE WHEN trim(coalesce(title, '')) = '' THEN 0 ELSE len(string_split_regex(trim(title), '\\s+')) END AS title_words,
 coalesce(l.linkedin_url, '') AS linkedin, lower(coalesce(l.linkedin_url, '')) AS linkedin_l, coalesce(twitter_url, '') AS twitter, coalesce(github_url, '') AS github,
 coalesce(facebook_url, '') AS facebook, coalesce(l.website, '') AS website, coalesce(notes, '') AS notes, lower(coalesce(source, '')) AS source,
 coalesce(c.name, '') AS co_name, lower(coalesce(c.domain, '')) AS co_domain, lower(coalesce(c.industry, '')) AS co_industry, coalesce(c.industry, '') AS co_industry_raw,
 coalesce(c.size, '') AS co_size, lower(coalesce(c.location, '')) AS co_location, coalesce(c.location, '') AS co_location_raw, coalesce(c.website, '') AS co_website, lower(coalesce(c.description, '')) AS co_description,
 lower(coalesce(c.revenue, '')) AS co_revenue, coalesce(json_array_length(c.technologies), 0)::INT AS co_tech, coalesce(len(json_keys(c.social_media)), 0)::INT AS co_social,
 floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(l.created_at))) / 86400)::INT AS age
 FROM leads l LEFT JOIN companies c ON l.company_id = c.id)"""
BASE = ["leads", "companies"]
