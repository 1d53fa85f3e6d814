"""Cleaning and standardisation of lead and company fields (CLN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules as R
from .exprs import any_in, cases, present

TRIM = r"^\s+|\s+$"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def if_given(c: Column, value: Column) -> Column:
    return F.when(present(c), value).otherwise(c)


def name(c: Column) -> Column:
    """CLN-1."""
    spaced = F.regexp_replace(trim(c), r"\s+", " ")
    return if_given(c, F.regexp_replace(F.initcap(F.lower(spaced)), r"[^a-zA-Z\s'-]", ""))


def email(c: Column) -> Column:
    """CLN-2: input that cannot be repaired stays as it was."""
    e = F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "^mailto:", ""), r"\s+", "")
    first = F.split_part(e, F.lit("."), F.lit(1))
    fixable = ~e.contains("@") & (F.size(F.split(e, r"\.")) >= 3)
    repaired = F.concat(first, F.lit("@"), F.regexp_replace(e, r"^[^.]*\.", ""))
    return if_given(c, cases([(e.rlike(R.EMAIL_PATTERN), e), (fixable, repaired)], c))


def phone(c: Column) -> Column:
    """CLN-3."""
    p = F.regexp_replace(trim(c), r"[^0-9+\-()\s.]", "")
    d = F.regexp_replace(p, "[^0-9]", "")
    s = lambda a, k: F.substring(d, a, k)
    return if_given(c, cases([
        (F.length(d) == 10, F.concat(F.lit("("), s(1, 3), F.lit(") "), s(4, 3), F.lit("-"), s(7, 4))),
        ((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+1 ("), s(2, 3), F.lit(") "), s(5, 3), F.lit("-"), s(8, 4))),
        (p.startswith("+"), p)], c))


def title_case(c: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    parts = F.split(c, r"(?<=[^\p{L}])(?=\p{L})|(?<=\p{L})(?=[^\p{L}])")
    return F.array_join(F.transform(parts, lambda p: F.initcap(F.lower(p))), "")


def industry(c: Column) -> Column:
    """CLN-8: first variation contained, in listed order."""
    low = F.lower(trim(c))
    return cases([(any_in(low, v), k.title()) for k, v in R.INDUSTRY_MAP.items()], title_case(low))


def size(c: Column, strict_ranges: bool = False) -> Column:
    """CLN-9. ``strict_ranges`` matches whole range texts, so '501-1000' no longer hits '1-10'."""
    s = trim(c)
    low = F.lower(s)
    test = (lambda v: low.isin(v)) if strict_ranges else (lambda v: any_in(low, v))
    return cases([(test(v), k) for k, v in R.SIZE_MAP.items()], s)


def location(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim(c), r",\s*,", ","), r"\s+", " ")


def company(c: str = "company") -> Column:
    """CLN-4 on the company struct."""
    f = lambda x: F.col(f"{c}.{x}")
    fixed = {"name": if_given(f("name"), trim(f("name"))), "industry": if_given(f("industry"), industry(f("industry"))),
             "size": if_given(f("size"), size(f("size"))), "location": if_given(f("location"), location(f("location")))}
    out = F.col(c)
    for k, v in fixed.items():
        out = out.withField(k, v)
    return F.when(F.col(c).isNotNull(), out)


def title(c: Column) -> Column:
    """CLN-5."""
    words = F.split(trim(c), r"\s+")
    return if_given(c, F.array_join(F.transform(words, lambda x: F.when(F.upper(x).isin(R.TITLE_ABBREVIATIONS), F.upper(x)).otherwise(F.initcap(F.lower(x)))), " "))


def with_scheme(c: Column) -> Column:
    u = trim(c)
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))


def linkedin(c: Column) -> Column:
    """CLN-6."""
    u = with_scheme(c)
    profile = F.regexp_extract(u, r"linkedin\.com/in/([a-zA-Z0-9_-]+)", 1)
    return if_given(c, F.when(profile != "", F.concat(F.lit("https://www.linkedin.com/in/"), profile)).otherwise(u))


def website(c: Column) -> Column:
    return if_given(c, with_scheme(c))


def trim_all(df: DataFrame) -> DataFrame:
    """CLN-7: trims every string, also inside structs, driven by the schema."""
    def walk(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StringType):
            return trim(c)
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c.getField(f.name), f.dataType).alias(f.name) for f in t]))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def clean_leads(df: DataFrame) -> DataFrame:
    """CLN-10."""
    steps = {"first_name": name, "last_name": name, "email": email, "phone": phone, "title": title, "linkedin_url": linkedin, "website": website}
    cols = {c: fn(F.col(c)) for c, fn in steps.items() if c in df.columns}
    if "company" in df.columns:
        cols["company"] = company()
    return trim_all(df.withColumns(cols))


def match_name(c: Column) -> Column:
    """CLN-11: lower-case letters only."""
    return F.regexp_replace(F.lower(trim(F.coalesce(c, F.lit("")))), "[^a-z]", "")


def match_domain(c: Column) -> Column:
    d = F.regexp_replace(F.lower(trim(F.coalesce(c, F.lit("")))), r"^https?://", "")
    return F.split_part(F.regexp_replace(d, r"^www\.", ""), F.lit("/"), F.lit(1))


def match_phone(c: Column) -> Column:
    d = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9+]", "")
    return cases([(d.startswith("+1"), F.substring(d, 3, 99)), (d.startswith("1") & (F.length(d) == 11), F.substring(d, 2, 99))], d)


# Fixed parts dropped from a company name, in this order.
DOMAIN_NOISE = [" ", ",", ".", "inc", "corp", "llc", "solutions", "systems"]


def company_domain(c: Column, extension: str = ".com") -> Column:
    """CLN-12."""
    d = F.lower(c)
    for s in DOMAIN_NOISE:
        d = F.replace(d, F.lit(s), F.lit(""))
    return F.concat(d, F.lit(extension))
