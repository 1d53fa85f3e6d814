"""Table-level predicates, joins and set operators (PRD-*, JN-*, SET-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R  # noqa: F401
from ..functions.exprs import compact, present, recent, say
from .aggregates import latest_by


def where_equals(df: DataFrame, **filters) -> DataFrame:
    """PRD-2: equality filters; None and '' mean no filter."""
    for c, v in filters.items():
        if v is not None and v != "":
            df = df.where(F.col(c) == v)
    return df


def min_score(df: DataFrame, bound: float | None) -> DataFrame:
    """PRD-3."""
    return df if bound is None else df.where(F.col("score") >= bound)


def contains_key(left: Column, right: Column) -> Column:
    return left.contains(right)


def feedback_models(feedback: DataFrame, predictions: DataFrame, models: DataFrame) -> DataFrame:
    """PRD-8: models whose name contains the rated prediction's type.

    The theta join runs on the distinct types (a closed list), not on the feedback rows; the result is joined back by key.
    """
    rated = feedback.select("id", "prediction_id").join(
        predictions.select(F.col("id").alias("prediction_id"), "model_type"), "prediction_id")
    types = rated.select("model_type").distinct()
    active = models.where("is_active").select("model_name")
    pairs = types.join(active, F.col("model_name").contains(F.col("model_type")))
    first = pairs.groupBy("model_type").agg(F.min("model_name").alias("model_name"))
    return rated.join(first, "model_type")


def cached_split(leads, predictions, insights, as_of: str, model_type: str | None = None) -> DataFrame:
    """PRD-10: per lead whether a prediction younger than 24 h and an active priority insight exist."""
    p = where_equals(predictions, model_type=model_type)
    fresh = p.groupBy("lead_id").agg(F.max("created_at").alias("last")).where(recent(F.col("last"), as_of, 1) & (F.col("last") != F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")))
    live = insights.where((F.col("status") == "active") & (F.col("insight_type") == "priority")).select("lead_id").distinct()
    ok = fresh.join(live, "lead_id", "left_semi").select(F.col("lead_id").alias("id"), F.lit(True).alias("cached"))
    return leads.select("id").join(ok, "id", "left").select("id", F.coalesce("cached", F.lit(False)).alias("cached"))


def validate_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """PRD-13: adds ``reasons`` (names of broken rules) and ``valid``; a null value breaks no rule."""
    broken = compact(*[say(~F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items()])
    return df.withColumn("reasons", broken).withColumn("valid", F.size("reasons") == 0)


# Fixed row constraints: ranges, closed lists and the weekday pattern.
WEEKDAYS = r"^(monday|tuesday|wednesday|thursday|friday|saturday|sunday)$"


def generated_data_issues(df: DataFrame) -> DataFrame:
    """PRD-14: long table of issues and warnings per row."""
    digits = F.regexp_replace(F.coalesce("phone", F.lit("")), r"[\s()+-]", "")
    def missing(c):
        return say(~present(F.col(c)), f"issue: missing {c}")

    items = compact(
        missing("first_name"), missing("last_name"), missing("email"), missing("title"),
        say(present(F.col("email")) & ~F.col("email").contains("@"), "issue: invalid email"),
        say(present(F.col("phone")) & (F.length(digits) < 10), "warning: short phone"),
        say(~present(F.col("company.name")), "issue: missing company name"),
        say(~F.col("score").between(0, 100), "issue: score out of range"))
    return df.select("id", F.explode(items).alias("item"))


def validation_summary(df: DataFrame) -> DataFrame:
    items = generated_data_issues(df)
    return items.groupBy("item").agg(F.count("*").alias("n"))


def enrich(leads: DataFrame, found: DataFrame) -> DataFrame:
    """JN-16: fill blanks from an enrichment row per domain, always take its technologies, and list what was filled.

    ``leads`` carries company_id, size, revenue, technologies, linkedin_url; ``found`` is keyed by domain.
    """
    f = found.select(F.col("domain").alias("_d"), *[F.col(c).alias(f"_{c}") for c in ("size", "revenue", "technologies", "linkedin_url")])
    j = leads.join(f, F.col("domain") == F.col("_d"), "left")
    def fill(c):
        return F.when(~present(F.col(c)) & present(F.col(f"_{c}")), F.col(f"_{c}")).otherwise(F.col(c))

    filled = compact(
        say(~present(F.col("size")) & present(F.col("_size")), "company_size"),
        say(~present(F.col("revenue")) & present(F.col("_revenue")), "company_revenue"),
        say(present(F.col("_technologies")), "technologies"),
        say(~present(F.col("linkedin_url")) & present(F.col("_linkedin_url")), "linkedin_url"))
    return j.select(
        "id", fill("size").alias("size"), fill("revenue").alias("revenue"),
        F.when(present(F.col("_technologies")), F.col("_technologies")).otherwise(F.col("technologies")).alias("technologies"),
        fill("linkedin_url").alias("linkedin_url"), filled.alias("enriched_fields"))


def adjacent_pairs(df: DataFrame, position: str = "position") -> DataFrame:
    """JN-17: rows 1-2, 3-4, ... side by side, joined on the pair number; an odd last row has no partner."""
    k = F.floor((F.col(position) - 1) / 2)
    first = df.where(F.col(position) % 2 == 1).withColumn("pair", k)
    second = df.where(F.col(position) % 2 == 0).withColumn("pair", k)
    def pack(side, name):
        return side.select("pair", F.struct(*df.columns).alias(name))

    return pack(first, "a").join(pack(second, "b"), "pair")


def match_known_people(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """JN-18: within a domain, names equal or contained (first contains first and last contains last); first hit by order."""
    c = candidates.select("id", "domain", F.lower("first_name").alias("cf"), F.lower("last_name").alias("cl"))
    k = known.select("domain", F.lower("first_name").alias("kf"), F.lower("last_name").alias("kl"), "email", "ord")
    # Equal names collapse first, so a crowded domain joins distinct names and not rows.
    ck = c.select("domain", "cf", "cl").distinct()
    kk = k.groupBy("domain", "kf", "kl").agg(F.min_by("email", "ord").alias("email"), F.min("ord").alias("ord"))
    hit = ck.join(kk, "domain").where((F.col("kf").contains(F.col("cf"))) & (F.col("kl").contains(F.col("cl"))))
    best = hit.groupBy("domain", "cf", "cl").agg(F.min_by("email", "ord").alias("matched_email"), F.min("ord").alias("matched_ord"))
    return c.join(best, ["domain", "cf", "cl"]).select("id", "domain", "matched_email", "matched_ord")


def merge_upsert(target: DataFrame, source: DataFrame, keys) -> DataFrame:
    """SNK-12 in set form: source rows replace target rows of the same key. ``source`` holds one row per key."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source)


def insert_absent(target: DataFrame, source: DataFrame, keys) -> DataFrame:
    """SNK-13: target plus the source rows whose key it lacks."""
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["latest_by"]
