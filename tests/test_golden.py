"""Rows worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from leadlake.functions import clean as C
from leadlake.functions import emails as M
from leadlake.session import spread
from leadlake.functions import features as X
from leadlake.functions import priority as P
from leadlake.functions import quality as Q
from leadlake.functions import score as S
from leadlake.functions.record import prepare
from leadlake.sources.schemas import LEAD_IMPORT

AS_OF = "2024-02-15 12:00:00"


def leads(spark, *rows):
    company = {"id": None, "name": None, "domain": None, "industry": None, "size": None, "location": None, "website": None, "description": None, "linkedin_url": None, "phone": None, "revenue": None,
               "technologies": None, "social_media": None}
    out = []
    for r in rows:
        r = dict(r)
        if "company" in r and r["company"] is not None:
            r["company"] = {**company, **r["company"]}
        for c in ("first_name", "last_name", "email", "phone", "title", "linkedin_url", "source"):
            r.setdefault(c, "")
        out.append({k: r.get(k) for k in ("id", "first_name", "last_name", "email", "phone", "title", "linkedin_url", "twitter_url", "github_url", "facebook_url", "website", "source", "status", "notes",
                                          "created_at", "updated_at", "company")})
    df = spark.createDataFrame(out, LEAD_IMPORT)
    ts = F.to_timestamp("created_at")
    return df.withColumn("created_at", ts)


ENGINE = [
    {"id": 1, "first_name": "John", "last_name": "Smith", "email": "john.smith@techcorp.com", "phone": "+1 (555) 123-4567", "title": "Senior Software Engineer", "linkedin_url": "https://linkedin.com/in/john-smith",
     "company": {"name": "TechCorp Inc", "industry": "Technology", "size": "51-200", "location": "San Francisco, CA"}},
    {"id": 2, "first_name": "jane", "last_name": "DOE", "email": "jane.doe@techcorp.com", "phone": "5551234567", "title": "software engineer", "company": {"name": "techcorp inc", "industry": "tech", "size": "50-200"}},
    {"id": 3, "first_name": "Test", "last_name": "User", "email": "test@test.com", "phone": "1234567890", "title": "Test Engineer", "company": {"name": "Test Company", "industry": "Testing"}},
    {"id": 4, "last_name": "Unknown", "email": "invalid-email", "phone": "123", "company": {}},
]


def test_quality_engine(spark):
    got = {r.id: r for r in Q.assess(leads(spark, *ENGINE), AS_OF).collect()}
    want = {1: (90, 70, 24 / 26 * 100, 100, 100, 100, 93.5769, True), 2: (90, 70, 21 / 26 * 100, 100, 100, 100, 90.6923, True),
            3: (55, 30, 19 / 26 * 100, 75, 100, 100, 73.2692, True), 4: (0, 0, 8 / 26 * 100, 100, 100, 100, 57.6923, False)}
    for i, w in want.items():
        r = got[i]
        assert (r.email_quality, r.phone_quality, r.completeness_score, r.accuracy_score, r.consistency_score, r.freshness_score, r.overall_score) == pytest.approx(w[:7], abs=1e-4), i
        assert r.validation_passed is w[7]
    assert [x.severity for x in got[4].issues if x.severity == "critical"]


def test_repeated_characters_and_fallback(spark):
    df = leads(spark, {"id": 1, "first_name": "Aaaaab", "last_name": "B", "email": "xaaaa@b.com"}, {"id": 2, "first_name": "Abc"})
    r = {x.id: [i.description for i in x.issues] for x in Q.assess(df, AS_OF, "comprehensive").collect()}
    assert "Repeated character patterns detected" in r[1] and "Data contains suspicious sequential patterns" in r[2]
    f = Q.assess(df, AS_OF, unreadable=F.lit(True)).first()
    assert f.overall_score == 50 and f.confidence == 0.3 and not f.validation_passed


def test_cleaning(spark):
    r = C.clean_leads(leads(spark, ENGINE[1])).first()
    assert (r.first_name, r.last_name, r.title, r.phone) == ("Jane", "Doe", "Software Engineer", "(555) 123-4567")
    assert (r.company.industry, r.company.size, r.company.name) == ("Tech", "51-200", "techcorp inc")
    e = spark.createDataFrame([("MAILTO: A.B@C.com ",), ("john.acme.com",), ("plain",), ("",)], "e string").select(C.email(F.col("e")).alias("e")).collect()
    assert [x.e for x in e] == ["a.b@c.com", "john@acme.com", "plain", ""]


def test_quirks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(C.size(F.lit("501-1000"))) == "1-10" and one(C.size(F.lit("501-1000"), strict_ranges=True)) == "501-1000"
    assert one(C.industry(F.lit("Hospitality"))) == "Tech" and one(C.title_case(F.lit("e-commerce shop"))) == "E-Commerce Shop"
    df = leads(spark, {"id": 1, "title": "director of sales"})
    assert X.with_features(df, AS_OF).first().seniority_score == 95
    null_title = leads(spark, {"id": 1, "first_name": "A"}).withColumn("title", F.lit(None).cast("string"))
    assert S.with_lead_score(null_title, AS_OF).first().lead_score == 50.0
    assert S.with_lead_score(null_title, AS_OF, S.ScoringConfig(null_policy="blank")).first().lead_score < 50


@pytest.mark.parametrize("email,score,ok", [("john.smith@company.com", 80, True), ("test@test.com", 80, True), ("admin@company.com", 60, False), ("user@10minutemail.com", 40, False), ("invalid-email", 0, False), ("chris@acme.com", 60, False)])
def test_deliverability(spark, email, score, ok):
    r = spark.range(1).select(Q.deliverability(F.lit(email)).alias("d")).first().d
    assert (r.score, r.deliverable) == (score, ok)


@pytest.mark.parametrize("phone,score,valid,country,formatted", [
    ("+1 (555) 123-4567", 50, True, "US/Canada", "+15551234567"), ("5551234567", 50, True, "Unknown", "+5551234567"), ("123-456-7890", 30, False, "Unknown", "+1234567890"),
    ("+44 20 7946 0958", 80, True, "United Kingdom", "+442079460958"), ("123", 30, False, "Unknown", "+123"), ("1111111111", 10, False, "Unknown", "+1111111111")])
def test_phone_engine(spark, phone, score, valid, country, formatted):
    r = spark.range(1).select(Q.phone_report(F.lit(phone)).alias("d")).first().d
    assert (r.score, r.valid, r.country, r.formatted) == (score, valid, country, formatted)


def test_six_dimensions(spark):
    rows = [{"id": 1, "first_name": "John", "last_name": "Smith", "email": "john.smith@example.com", "phone": "+1-555-123-4567", "title": "Senior Software Engineer", "linkedin_url": "https://www.linkedin.com/in/johnsmith",
             "company": {"name": "TechCorp Inc", "domain": "example.com", "industry": "Technology", "size": "201-500", "location": "San Francisco, CA"}, "source": "linkedin"},
            {"id": 3, "first_name": "Test", "last_name": "User", "email": "test@test.com", "phone": "+1-999-999-9999", "title": "CEO", "company": {"name": "Example Corp", "domain": "test.com", "industry": "Consulting", "size": "1-10"}, "source": "demo"}]
    df = leads(spark, *rows).withColumn("created_at", F.when(F.col("id") == 1, F.lit("2024-01-15 10:30:00").cast("timestamp")))
    got = {r.id: r for r in Q.six_dimensions(df, "2024-02-15 00:00:00").collect()}
    assert (got[1].completeness, got[1].uniqueness, got[1].overall_score) == pytest.approx((25 / 26 * 100, 95, 98.79), abs=0.01)
    assert (got[3].completeness, got[3].validity, got[3].freshness, got[3].overall_score) == pytest.approx((22 / 26 * 100, 50, 80, 86.40), abs=0.01)


ANALYZER = {"id": 1, "first_name": "John", "last_name": "Smith", "email": "john.smith@techcorp.ai", "phone": "+1-555-123-4567", "title": "Chief Technology Officer", "linkedin_url": "https://linkedin.com/in/john-smith-cto",
            "source": "linkedin", "company": {"name": "TechCorp AI", "domain": "techcorp.ai", "industry": "Artificial Intelligence", "size": "51-200", "location": "San Francisco, CA", "website": "https://techcorp.ai"}}


def test_analyzer(spark):
    df = leads(spark, ANALYZER).withColumn("created_at", F.lit(AS_OF).cast("timestamp"))
    r = X.analyze(df, AS_OF).first()
    assert (r.email_quality_score, r.seniority_score, r.title_decision_power, r.industry_relevance, r.company_size_score, r.location_score) == (100, 95, 20, 95, 85, 90)
    assert (r.engagement_potential, r.response_likelihood, r.completeness_score, r.freshness_score, r.consistency_score, r.source_quality) == (100, 90, 100, 100, 100, 90)
    assert (r.priority_score, r.quality_score, r.confidence) == pytest.approx((95, 86.5, 0.95))


def test_priority(spark):
    df = leads(spark, ANALYZER).withColumn("created_at", F.lit(AS_OF).cast("timestamp"))
    r = P.with_priority(df, AS_OF).first()
    assert (r.contact_score, r.company_score, r.role_score, r.timing_score, r.priority_level) == (90, 85, 30, 80, "high")
    assert r.priority_score == pytest.approx(71.75, abs=0.06) and r.confidence == pytest.approx(0.885, abs=0.006)
    assert list(r.key_factors) == ["Optimal company size", "Personal email address", "Fresh lead - optimal timing window"]


@pytest.mark.parametrize("outcome,rating,want", [("converted", 5, 100), ("qualified", 4, 95), ("rejected", 1, 0), ("whatever", 0, 50)])
def test_outcome_labels(spark, outcome, rating, want):
    assert spark.range(1).select(X.outcome_score(F.lit(outcome), F.lit(rating)).alias("x")).first().x == want


def test_score_stays_in_range_and_potential_is_not_negative_for_blanks(spark):
    df = leads(spark, *ENGINE, ANALYZER)
    rows = S.with_improvement_potential(df, AS_OF).collect()
    assert all(5 <= r.lead_score <= 95 for r in rows)
    assert next(r for r in rows if r.id == 4).improvement_potential > 0


def test_jitter_is_repeatable(spark):
    df = leads(spark, *ENGINE)
    run = lambda salt: [r.lead_score for r in S.with_lead_score(df, AS_OF, S.ScoringConfig(jitter_salt=salt)).orderBy("id").collect()]
    assert run("a") == run("a")


def test_config_override():
    cfg = S.ScoringConfig().updated({"weights": {"email_available": 30}, "ai_enhancement_enabled": False})
    assert cfg.weights["email_available"] == 30 and cfg.weights["phone_available"] == 15 and not cfg.enhancement


def test_email_patterns(spark):
    known = spark.createDataFrame([("Al", "Bo", "x.com", "al.bo@x.com"), ("Cy", "Do", "x.com", "cy.do@x.com"), ("Ed", "Fu", "x.com", "efu@x.com"), ("Gi", "Ho", "y.com", "giho@y.com")], "first_name string, last_name string, domain string, email string")
    people = spark.createDataFrame([(1, "ann", "lee", "x.com"), (2, "ann", "lee", "y.com"), (3, "ann", "lee", "z.com")], "id long, first string, last string, domain string")
    got = {r.id: r.email for r in M.impute(people, M.learned_patterns(known)).collect()}
    assert got == {1: "ann.lee@x.com", 2: "annlee@y.com"}
    best = M.best_candidate(people).where("id = 1").first()
    assert (best.email, best.confidence) == ("ann.lee@x.com", 65)


def test_prepare_never_yields_null(spark):
    df = leads(spark, {"id": 1}).withColumn("company", F.lit(None).cast(leads(spark, ENGINE[0]).schema["company"].dataType))
    r = prepare(df, AS_OF).first().asDict()
    assert all(v is not None for k, v in r.items() if k.startswith("w_") and k != "w_age")


def test_best_address_is_found_without_sorting_all_candidates(spark):
    """Many templates a contact: grouped by hash within the contact's partition, one exchange in all."""
    rows = [(i, f"a{chr(97 + i % 26)}", f"b{chr(97 + i % 7)}", "x.org") for i in range(200)] + [(900, "zoe", "li", "no tld")]
    people = spread(spark.createDataFrame(rows, "id long, first string, last string, domain string"), "id")
    best = M.best_candidate(people)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1
    got = {r.id: (r.email, r.confidence) for r in best.collect()}
    assert got == {i: (f"{f}.{l}@x.org", 65) for i, f, l, _ in rows[:200]}


def test_variations_keep_template_order_and_drop_malformed_addresses(spark):
    p = spark.createDataFrame([(1, "ann", "lee", "x.org"), (2, "ann", "lee", "no tld")], "id long, first string, last string, domain string")
    got = {r.id: [(v.ord, v.email, v.confidence, v.pattern_type) for v in r.v] for r in p.select("id", M.variations().alias("v")).collect()}
    assert got[2] == [] and got[1][:3] == [(0, "ann.lee@x.org", 70, "first.last"), (1, "annlee@x.org", 65, "firstlast"), (8, "ann-lee@x.org", 55, "other")]
    assert len(got[1]) == 15
