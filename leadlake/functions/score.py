"""Rule score of a lead, its parts, tiers, factors and the batch form (SCR-*)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .exprs import add, alphabetic, any_in, cases, clamp, compact, count_true, ends_any, lookup, points, present, say, tiers
from .record import drop_work, prepare, w


@dataclass
class ScoringConfig:
    """Weights, source multipliers and the enhancement switch; ``updated`` merges a partial override."""

    weights: dict = field(default_factory=lambda: dict(R.SCORE_WEIGHTS))
    source_multipliers: dict = field(default_factory=lambda: dict(R.SOURCE_MULTIPLIERS))
    enhancement: bool = True
    null_policy: str = "neutral"
    jitter_salt: str | None = None

    def updated(self, override: dict) -> "ScoringConfig":
        return ScoringConfig(
            {**self.weights, **override.get("weights", {})},
            {**self.source_multipliers, **override.get("source_multipliers", {})},
            override.get("ai_enhancement_enabled", self.enhancement),
            self.null_policy,
            self.jitter_salt,
        )


def email_score(cfg: ScoringConfig) -> Column:
    e = w("email_l")
    generic = cases(
        [(e.contains(g), -15.0 if g in R.HARSH_MAILBOXES else -10.0) for g in R.GENERIC_MAILBOXES], 0.0
    )
    total = add(
        F.lit(float(cfg.weights["email_available"])),
        points(e.rlike(R.PROFESSIONAL_MAILBOX), 8),
        generic,
        points(w("domain") != "", email_domain_score()),
        cases([(F.length(w("email")) > 50, -3.0), (F.length(w("email")) < 10, -5.0)], 0.0),
        points(w("email").rlike("[0-9]{3,}"), -3),
    )
    return points(w("email") != "", F.greatest(F.lit(0.0), total))


def email_domain_score() -> Column:
    d = w("domain")
    return add(
        points(F.lower(d).isin(R.SCORE_FREE_DOMAINS), -8, 5),
        cases([(ends_any(d, R.DOMAIN_TIERS["tier_1"]), 8.0), (ends_any(d, R.DOMAIN_TIERS["tier_2"]), 5.0),
               (ends_any(d, R.DOMAIN_TIERS["tier_3"]), 2.0)], 0.0),
        points(F.length(F.split_part(d, F.lit("."), F.lit(1))) >= 8, 2),
    )


def contact_score(cfg: ScoringConfig, socials: bool = False) -> Column:
    li, lil = w("linkedin"), w("linkedin_l")
    phone = add(F.lit(float(cfg.weights["phone_available"])), points(F.length(w("phone_d")) >= 10, 3),
                points(w("phone").startswith("+"), 2))
    link = add(
        F.lit(float(cfg.weights["linkedin_profile"])),
        cases([(lil.contains("linkedin.com/in/"), 8.0), (lil.contains("linkedin.com/company/"), 5.0),
               (lil.contains("linkedin.com"), 3.0)], 0.0),
        points(li.contains("/in/") & ~li.rlike(r"/in/[a-z]+-[a-z]+-\w{8}"), 4),
    )
    total = add(points(w("phone") != "", phone), points(li != "", link))
    if socials:
        wanted = F.map_filter("social_media", lambda k, v: present(v) & F.lower(k).isin("twitter", "github", "facebook"))
        total = total + 2.0 * F.coalesce(F.size(F.map_keys(wanted)), F.lit(0))
    return total


def _jitter(cfg: ScoringConfig, low: float, high: float, tag: str) -> Column:
    """Range midpoint, or a repeatable hash draw from the range when a salt is set."""
    if cfg.jitter_salt is None:
        return F.lit((low + high) / 2)
    unit = F.pmod(F.xxhash64(F.col("id"), F.lit(cfg.jitter_salt + tag)), F.lit(1 << 20)) / float(1 << 20)
    return F.lit(low) + unit * (high - low)


def title_score(cfg: ScoringConfig) -> Column:
    t = w("title")
    base = float(cfg.weights["senior_title"])
    level = cases(
        [
            (any_in(t, R.EXECUTIVE_TITLES),
             base + 25 + points(any_in(t, ["ceo", "founder", "president", "managing partner"]), 15)),
            (any_in(t, R.SENIOR_TITLES), base + 10 + points(any_in(t, ["vp", "vice president"]), 8)),
            (any_in(t, R.MANAGER_TITLES), base * 0.8 + points(any_in(t, ["senior", "lead", "principal"]), 6)),
        ],
        base * 0.4 + points(any_in(t, ["senior", "principal", "lead"]), 10),
    )
    n = w("title_words")
    extra = points(any_in(t, R.VALUED_FUNCTIONS), _jitter(cfg, 3, 8, "function")) + cases(
        [(n >= 4, _jitter(cfg, 3, 7, "long")), (n >= 3, _jitter(cfg, 1, 4, "mid"))], 0.0
    )
    return points(t != "", level + extra)


def seniority_level() -> Column:
    t = w("title")
    return cases(
        [(t == "", None), (any_in(t, R.EXECUTIVE_TITLES), "executive"), (any_in(t, R.SENIOR_TITLES), "senior"),
         (any_in(t, R.MANAGER_TITLES), "manager")], "individual")


def industry_score(cfg: ScoringConfig) -> Column:
    i = w("co_industry")
    base = float(cfg.weights["industry_match"])
    return cases(
        [
            (i == "", 0.0),
            (any_in(i, R.INDUSTRY_TIERS["tier_1"]),
             base + 20 + points(any_in(i, ["ai", "artificial intelligence", "machine learning", "ml"]), 12)
             + points(any_in(i, ["fintech", "financial technology"]), 10)),
            (any_in(i, R.INDUSTRY_TIERS["tier_2"]), base + 10 + points(any_in(i, ["saas", "software as a service"]), 8)),
            (any_in(i, R.INDUSTRY_TIERS["tier_3"]), base + 5),
        ],
        base * 0.5 + points(any_in(i, R.STABLE_INDUSTRIES), 3),
    )


def company_size_score(cfg: ScoringConfig) -> Column:
    s, base = w("co_size"), float(cfg.weights["company_size"])
    size = cases([(s.contains(k), base * m) for k, m in R.SIZE_MULTIPLIERS.items()], base * 0.6)
    hot = any_in(s, ["1-10", "11-50"]) & any_in(w("co_industry"), ["ai", "fintech", "saas", "blockchain"])
    return points(s != "", size + points(hot, 8))


def location_score(cfg: ScoringConfig) -> Column:
    loc, base = w("co_location"), float(cfg.weights["location_match"])
    place = cases(
        [(any_in(loc, R.LOCATION_TIERS["tier_1"]), base + 12), (any_in(loc, R.LOCATION_TIERS["tier_2"]), base + 6),
         (any_in(loc, R.LOCATION_TIERS["tier_3"]), base + 2), (any_in(loc, R.ENGLISH_COUNTRIES), base * 0.8),
         (any_in(loc, R.EU_COUNTRIES), base * 0.7)], base * 0.4)
    return points(loc != "", place + points(any_in(loc, ["remote", "distributed"]), 5))


def domain_quality_score(cfg: ScoringConfig) -> Column:
    d, base = w("co_domain"), float(cfg.weights["domain_quality"])
    label = F.split_part(d, F.lit("."), F.lit(1))
    n = F.length(label)
    total = add(
        cases([(ends_any(d, R.DOMAIN_TIERS["tier_1"]), base + 8), (ends_any(d, R.DOMAIN_TIERS["tier_2"]), base + 3),
               (ends_any(d, R.DOMAIN_TIERS["tier_3"]), base)], base * 0.4),
        cases([(n.between(3, 10), 6.0), (n.between(11, 15), 3.0), (n > 25, -4.0)], 0.0),
        points(label.rlike("[0-9]"), -3),
        points(label.contains("-"), -2),
        points((n <= 12) & label.rlike(r"^\p{L}+$"), 4),
    )
    return points(d != "", total)


def company_maturity_score() -> Column:
    site, desc = w("co_website"), w("co_description")
    total = add(
        points(site != "", 3), points(site.startswith("https://"), 2),
        points(F.length(desc) > 50, add(F.lit(4.0), points(any_in(desc, R.PROFESSIONAL_TERMS), 2))),
        w("co_social") * 1.5,
    )
    return F.least(total, F.lit(15.0))


def company_growth_score() -> Column:
    rev = w("co_revenue")
    return add(
        points(rev != "", add(F.lit(5.0), points(any_in(rev, R.REVENUE_MARKS), 8))),
        points(any_in(w("co_description"), R.FUNDING_MARKS), 6),
        F.least(w("co_tech") * 0.5, F.lit(5.0)),
    )


def company_score(cfg: ScoringConfig) -> Column:
    return points(w("has_company"), add(industry_score(cfg), company_size_score(cfg), location_score(cfg),
                                        domain_quality_score(cfg), company_maturity_score(), company_growth_score()))


def name_score(cfg: ScoringConfig) -> Column:
    f, l, base = w("first"), w("last"), float(cfg.weights["name_completeness"])
    good = F.length(f).between(2, 20) & F.length(l).between(2, 25) & alphabetic(f) & alphabetic(l)
    tidy = F.length(f).between(3, 12) & F.length(l).between(3, 15)
    single = F.when(f != "", f).otherwise(l)
    score = cases(
        [((f == "") & (l == ""), 0.0),
         ((f != "") & (l != ""), base + points(good, add(F.lit(6.0), points(tidy, 3))))],
        base * 0.6 + points((F.length(single) >= 2) & alphabetic(single), 2),
    )
    fake = any_in(F.lower(F.concat(f, F.lit(" "), l)), R.FAKE_NAME_WORDS)
    return F.when((f == "") & (l == ""), 0.0).otherwise(F.greatest(F.lit(0.0), score + points(fake, -10)))


def source_score(cfg: ScoringConfig) -> Column:
    s = w("source")
    base = float(cfg.weights["lead_source_quality"])
    return lookup(s, {k: base * m for k, m in cfg.source_multipliers.items()}, base) + lookup(
        s, {k: float(v) for k, v in R.SOURCE_EXTRA.items()}, 0.0)


def freshness_score(cfg: ScoringConfig) -> Column:
    a = w("age")
    return float(cfg.weights["data_freshness"]) + cases(
        [(a.isNull(), 0.0), (a <= 7, 5.0), (a <= 30, 3.0), (a <= 90, 1.0)], -2.0)


def social_score(cfg: ScoringConfig) -> Column:
    total = add(points(w("linkedin") != "", 3), points(w("twitter") != "", 2), points(w("github") != "", 2),
                points(w("facebook") != "", 2), w("co_social") * 1.5)
    return F.least(total, F.lit(float(cfg.weights["social_presence"])))


def contact_methods() -> Column:
    return w("methods")


def engagement_score() -> Column:
    s = w("co_size")
    total = add(contact_methods() * 3.0, points(any_in(w("title"), R.DECISION_WORDS), 5),
                cases([(any_in(s, ["1-10", "11-50"]), 4.0), (s.contains("51-200"), 6.0)], 0.0))
    return F.least(total, F.lit(20.0))


def is_enterprise() -> Column:
    return any_in(w("co_size"), R.ENTERPRISE_SIZES) | any_in(w("title"), R.ENTERPRISE_TITLES)


def is_smb() -> Column:
    return any_in(w("co_size"), R.SMB_SIZES)


def context_adjustment() -> Column:
    """Reads ``campaign_type``, ``target_regions``, ``target_industries`` and ``urgent`` of a joined campaign row."""
    kind = F.col("campaign_type")
    region = F.exists("target_regions", lambda r: w("co_location").contains(F.lower(r)))
    industry = F.exists("target_industries", lambda r: w("co_industry").contains(F.lower(r)))
    return add(
        cases([((kind == "enterprise") & is_enterprise(), 10.0), ((kind == "smb") & is_smb(), 8.0)], 0.0),
        points(F.coalesce(region, F.lit(False)), 5), points(F.coalesce(industry, F.lit(False)), 8),
        points(F.coalesce(F.col("urgent"), F.lit(False)) & (w("phone") != "") & (w("email") != ""), 6),
    )


def high_intent() -> Column:
    return any_in(w("title"), R.INTENT_TITLES) | any_in(w("co_description"), R.GROWTH_WORDS)


def quality_indicators(email_part: Column, contact_part: Column) -> Column:
    return ((email_part > 20) & (contact_part > 15)) | (
        (w("email") != "") & ~any_in(w("email"), ["gmail", "yahoo", "hotmail"]) & (w("linkedin") != "") & (w("phone") != ""))


def successful_pattern() -> Column:
    return count_true(
        any_in(w("co_industry"), ["technology", "software", "saas"]), any_in(w("title"), ["director", "vp", "head", "chief"]),
        (w("email") != "") & (w("phone") != "") & (w("linkedin") != ""), any_in(w("co_size"), ["51-200", "201-500"])) >= 3


def risk_factors() -> Column:
    d = w("co_domain")
    return count_true(any_in(w("email"), ["info@", "contact@", "admin@"]), (w("first") == "") | (w("last") == ""),
                      (d != "") & ((F.length(d) > 30) | any_in(d, ["_", "%"]))) >= 2


def enhancement(email_part: Column, contact_part: Column) -> Column:
    return add(points(high_intent(), 8), points(quality_indicators(email_part, contact_part), 6),
               points(successful_pattern(), 10), points(risk_factors(), -5))


def industry_bonus() -> Column:
    return cases([(w("co_industry").contains(k), float(v)) for k, v in R.INDUSTRY_TRENDS.items()], 0.0)


def timing_bonus(as_of: str) -> float:
    t = datetime.fromisoformat(as_of)
    bonus = 5 if t.month in (3, 6, 9, 12) and t.day >= 25 else 0
    bonus += 8 if t.month == 12 and t.day >= 15 else 0
    bonus += 6 if t.month == 1 else 0
    return float(bonus + (2 if 9 <= t.hour <= 17 else 0))


PARTS = ["email", "contact", "title", "company", "name", "source", "freshness", "social", "engagement"]


def with_parts(df: DataFrame, as_of: str, cfg: ScoringConfig | None = None) -> DataFrame:
    """Prepared frame plus one ``part_*`` column per component."""
    cfg = cfg or ScoringConfig()
    df = prepare(df, as_of)
    return df.withColumns({
        "part_email": email_score(cfg), "part_contact": contact_score(cfg, "social_media" in df.columns),
        "part_title": title_score(cfg), "part_company": company_score(cfg), "part_name": name_score(cfg),
        "part_source": source_score(cfg), "part_freshness": freshness_score(cfg), "part_social": social_score(cfg),
        "part_engagement": engagement_score(),
    })


def total_score(as_of: str, cfg: ScoringConfig, context: bool) -> Column:
    parts = [F.col(f"part_{p}") for p in PARTS]
    total = add(*parts)
    if context:
        total = total + context_adjustment()
    if cfg.enhancement:
        total = total + enhancement(F.col("part_email"), F.col("part_contact"))
    if cfg.jitter_salt is not None:
        total = total + _jitter(cfg, -3, 3, "base") + _jitter(cfg, -2, 2, "final")
    total = total + industry_bonus() + timing_bonus(as_of)
    bounded = F.round(clamp(total / float(sum(cfg.weights.values()) + 50) * 100, 5, 95), 1)
    if cfg.null_policy == "neutral":
        # A null title or source makes the whole score neutral.
        return F.when(F.col("title").isNull() | F.col("source").isNull(), 50.0).otherwise(bounded)
    return bounded


def with_lead_score(df: DataFrame, as_of: str, cfg: ScoringConfig | None = None, context: bool = False,
                    name: str = "lead_score", keep_parts: bool = False) -> DataFrame:
    """SCR-22. Narrow: no shuffle beyond what built ``df``."""
    cfg = cfg or ScoringConfig()
    out = with_parts(df, as_of, cfg).withColumn(name, total_score(as_of, cfg, context))
    return out if keep_parts else drop_work(out).drop(*[f"part_{p}" for p in PARTS])


def score_tier(c: Column) -> Column:
    return tiers(c, R.SCORE_TIERS, "Poor")


def completeness_percent() -> Column:
    return w("complete")


def factors() -> Column:
    t, i, s = w("title"), w("co_industry"), w("co_size")
    done = completeness_percent()
    return compact(
        say((w("email") != "") & any_in(w("email"), [".", "_"]) & w("has_at"), "✅ Professional email format"),
        say(contact_methods() >= 2, F.concat(F.lit("✅ Multiple contact methods available ("), contact_methods().cast("string"), F.lit("/3)"))),
        cases([(any_in(t, ["ceo", "cto", "founder", "president"]), "🌟 Executive-level contact"),
               (any_in(t, ["director", "vp", "head"]), "✅ Senior decision maker")], F.lit(None).cast("string")),
        say(any_in(i, ["ai", "saas", "fintech", "technology"]), "🚀 High-value industry sector"),
        cases([(any_in(s, ["51-200", "201-500", "501-1000"]), "🎯 Optimal company size for B2B"),
               (s.contains("1-10"), "⚡ Startup - potentially agile decision making")], F.lit(None).cast("string")),
        say(any_in(w("co_location"), ["san francisco", "new york", "london", "seattle"]), "🌆 Located in major business hub"),
        say(done > 80, F.concat(F.lit("📋 High data completeness ("), done.cast("string"), F.lit("%)"))),
        say(F.col("source").isin("linkedin", "referral", "event"), F.concat(F.lit("✅ High-quality source: "), F.col("source"))),
    )


def recommendations(as_of: str, cfg: ScoringConfig) -> Column:
    hour = datetime.fromisoformat(as_of).hour
    i = w("co_industry")
    rule = [
        cases([((w("email") == ""), "🔍 Find email address to increase engagement potential"),
               (~(any_in(w("email"), [".", "_"]) & w("has_at")), "🎯 Verify email format and deliverability")],
              F.lit(None).cast("string")),
        say(contact_methods() < 2, "📞 Gather additional contact information"),
        say(w("title") == "", "💼 Identify job title for better targeting"),
        say(completeness_percent() < 60, "📊 Enrich lead data for better insights"),
        say(F.col("source").isin("purchased", "import"), "🔍 Verify lead authenticity and interest"),
    ]
    if cfg.enhancement:
        # The part scores are not at hand here, so only the profile half of the quality test counts.
        rule += [
            say(high_intent(), "🤖 AI detected high purchase intent - prioritize for immediate contact"),
            say(~quality_indicators(F.lit(0.0), F.lit(0.0)), "🤖 AI suggests data enrichment to improve lead quality"),
            say(F.lit(hour < 9 or hour > 17), "🤖 AI recommends contacting during business hours (9-17 UTC)"),
            cases([(any_in(i, ["ai", "machine learning"]), "🤖 AI industry lead - emphasize technical capabilities"),
                   (i.contains("fintech"), "🤖 Fintech lead - highlight security and compliance features")],
                  F.lit(None).cast("string")),
        ]
    return compact(*rule)


# Fixed values used where a field is blank when the potential is computed.
IMPUTED = {"email": "contact@company.com", "phone": "+1-555-123-4567", "linkedin_url": "https://linkedin.com/in/contact", "title": "Director"}


def with_improvement_potential(df: DataFrame, as_of: str, cfg: ScoringConfig | None = None) -> DataFrame:
    """SCR-27: score with blank contact fields filled minus the score, both in one narrow stage."""
    cfg = cfg or ScoringConfig()
    base = with_lead_score(df, as_of, cfg)
    kept = {c: F.col(c) for c in IMPUTED}
    filled = base.withColumn("_raw", F.struct(*[v.alias(k) for k, v in kept.items()])).withColumns(
        {c: F.when(present(F.col(c)), F.col(c)).otherwise(v) for c, v in IMPUTED.items()})
    rescored = with_lead_score(filled, as_of, cfg, name="_potential")
    return rescored.withColumns({c: F.col(f"_raw.{c}") for c in IMPUTED}).withColumn(
        "improvement_potential", F.round(F.col("_potential") - F.col("lead_score"), 1)).drop("_raw", "_potential")


def with_explanation(df: DataFrame, as_of: str, cfg: ScoringConfig | None = None) -> DataFrame:
    """SCR-28: score, tier, factors, recommendations, breakdown and potential as one struct."""
    cfg = cfg or ScoringConfig()
    pot = with_improvement_potential(df, as_of, cfg).drop("lead_score")
    full = with_lead_score(pot, as_of, cfg, keep_parts=True)
    explained = full.withColumn(
        "score_explanation",
        F.struct(F.col("lead_score").alias("total_score"), score_tier(F.col("lead_score")).alias("quality_tier"),
                 factors().alias("factors"), recommendations(as_of, cfg).alias("recommendations"),
                 F.struct(*[F.col(f"part_{p}").alias(p) for p in PARTS]).alias("score_breakdown"),
                 F.col("improvement_potential")))
    return drop_work(explained).drop(*[f"part_{p}" for p in PARTS])
