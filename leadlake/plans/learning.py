"""Registered model features, labels and training runs (FEA-16..18, DRV-12..17, FN-7, ML, AGG-47, AGG-51, AGG-52)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import training as TR
from ..functions.quality import DIM_WEIGHTS, ensemble, six_dimensions
from ..functions.record import prepare, with_company
from ..operators import aggregates as A
from ..operators import ml as ML
from ..session import cut_lineage, shared_folder
from ..sources.bindings import AS_OF
from .registry import query
from .scoring import nested
from .sqltext import BASE, case, has, one_of, pts
from .sqltext import W as WORK

XW = {"w": WORK}
b = lambda c: f"({c})::INT::DOUBLE"


def first_of(col, table, otherwise, blank):
    return "(" + case([(f"{col} = ''", blank)] + [(has(col, ws), v) for v, ws in table], otherwise) + ")::DOUBLE"


LASTD = "(CASE WHEN has_at THEN lower(string_split(email, '@')[-1]) ELSE '' END)"
CORP = f"(email <> '' AND NOT {one_of(LASTD, TR.CLASSIFIER_FREE)})"
F16 = {
    "has_email": b("email <> ''"), "has_phone": b("phone <> ''"), "has_linkedin": b("linkedin <> ''"), "email_is_corporate": b(CORP),
    "email_quality_score": pts("email <> ''", "least(1, 0.5::DOUBLE + " + pts(CORP, 0.3) + "+" + pts("contains(local, '.')", 0.15) + "+" + pts("has_at AND contains(domain, '.')", 0.05) + ")"),
    "name_completeness": "((fn <> '')::INT + (ln <> '')::INT)::DOUBLE", "name_length": "(length(fn) + length(ln))::DOUBLE",
    "title_seniority": first_of("title", [(1.0, ["ceo", "president", "founder", "chief"]), (0.8, ["vp", "vice president", "director"]), (0.6, ["manager", "head of", "lead"]), (0.4, ["senior"])], 0.2, 0.0),
    "title_decision_power": first_of("title", [(1.0, ["ceo", "president", "founder", "owner"]), (0.8, ["cto", "cfo", "vp", "director"]), (0.6, ["manager", "head"]), (0.4, ["senior", "lead", "principal"])], 0.2, 0.0),
    "title_length": "length(title)::DOUBLE", "title_word_count": "title_words::DOUBLE", "company_size_score": "(" + case([(f"co_size = '{k}'", v) for k, v in TR.SIZE_CODES.items()], 0.5) + ")::DOUBLE",
    "industry_relevance": first_of("co_industry", [(1.0, ["technology", "software", "ai", "fintech", "saas"]), (0.7, ["finance", "healthcare", "consulting", "manufacturing"])], 0.5, 0.5),
    "location_score": first_of("co_location", [(1.0, ["san francisco", "new york", "seattle", "boston", "austin", "london"]), (0.7, ["chicago", "denver", "atlanta", "toronto", "berlin"])], 0.5, 0.5),
    "has_company_website": b("co_website <> ''"),
    "data_completeness": "((fn <> '')::INT + (ln <> '')::INT + (email <> '')::INT + (title <> '')::INT) / 4.0::DOUBLE * 0.7::DOUBLE + ((phone <> '')::INT + (linkedin <> '')::INT + has_company::INT) / 3.0::DOUBLE * 0.3::DOUBLE",
    "data_freshness": "(" + case([("age IS NULL", 0.5), ("age <= 7", 1.0), ("age <= 30", 0.8), ("age <= 90", 0.6)], 0.3) + ")::DOUBLE",
    "source_quality": "(" + case([(f"source = '{k}'", v) for k, v in TR.SOURCE_CODES.items()], 0.5) + ")::DOUBLE", "source_is_referral": b("contains(source, 'referral')"), "source_is_organic": b("source IN ('website', 'organic', 'search')"),
    "contact_methods_count": "methods::DOUBLE", "profile_richness": "((fn <> '')::INT + (ln <> '')::INT + (email <> '')::INT + (title <> '')::INT + (phone <> '')::INT + (linkedin <> '')::INT + (notes <> '')::INT + has_company::INT) / 8.0::DOUBLE",
    "day_of_week": "coalesce(isodow(created_at) - 1, 0)::DOUBLE", "hour_of_day": "coalesce(hour(created_at), 12)::DOUBLE", "is_weekend": "coalesce((isodow(created_at) >= 6)::INT, 0)::DOUBLE", "is_business_hours": "coalesce((hour(created_at) BETWEEN 9 AND 17)::INT, 1)::DOUBLE",
}


@query("fea_16", BASE, "SELECT id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in F16.items()) + " FROM w", XW)
def fea_16(t):
    return TR.classifier_features(nested(t), AS_OF).select("id", *[F.round(c, 6).alias(c) for c in TR.CLASSIFIER_COLUMNS])


F17 = {
    "has_email": b("email <> ''"), "has_phone": b("phone <> ''"), "has_linkedin": b("linkedin <> ''"), "has_title": b("title <> ''"), "has_company": b("co_name <> ''"), "email_length": "length(email)::DOUBLE",
    "email_has_dot": b("contains(email, '.')"), "email_domain_length": "length(domain)::DOUBLE", "is_free_email": b(has("email", ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com"])), "phone_length": "length(phone_d)::DOUBLE",
    "phone_has_country_code": b("starts_with(phone, '+') OR length(phone_d) > 10"), "first_name_length": "length(fn)::DOUBLE", "last_name_length": "length(ln)::DOUBLE", "name_has_special_chars": b("regexp_matches(fn || ln, '[^a-zA-Z\\s]')"),
    "company_has_domain": b("co_domain <> ''"), "company_has_industry": b("co_industry <> ''"), "company_has_size": b("co_size <> ''"), "title_length": "length(title)::DOUBLE", "is_executive": b(has("title", ["ceo", "cto", "cfo", "president", "founder"])),
    "is_manager": b(has("title", ["manager", "director", "head", "lead"])), "is_senior": b(has("title", ["senior", "sr."])), "days_old": "least(coalesce(age, 365), 1000)::DOUBLE", "is_recent": "coalesce((age <= 30)::INT, 0)::DOUBLE",
    "source_is_referral": b("contains(source, 'referral')"), "source_is_linkedin": b("contains(source, 'linkedin')"), "source_is_organic": b(has("source", ["organic", "website"])),
}


@query("fea_17", BASE, "SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in F17.items()) + " FROM w", XW)
def fea_17(t):
    return TR.quality_features(nested(t), AS_OF).select("id", *TR.QUALITY_COLUMNS)


SEN = "(" + case([(has("title", ["ceo", "cto", "cfo", "president", "founder", "executive"]), "'executive'"), (has("title", ["senior", "director", "head", "principal"]), "'senior'"), (has("title", ["manager", "lead"]), "'manager'")], "'individual'") + ")"
PH = "regexp_replace(phone, '[-() +.]', '', 'g')"


@query("fea_18", BASE, f"""SELECT id, {SEN} AS seniority_level, CASE WHEN NOT has_at THEN 'unknown' WHEN {one_of('domain', TR.TRAINING_FREE)} THEN 'free' ELSE 'corporate' END AS email_domain_type,
 ((fn <> '')::INT + (ln <> '')::INT + (email <> '')::INT + (phone <> '')::INT + (title <> '')::INT + (linkedin <> '')::INT + (co_name <> '')::INT + (co_industry <> '')::INT + (co_size <> '')::INT + (co_location <> '')::INT) / 10.0::DOUBLE AS data_completeness_score,
 {b("length(" + PH + ") >= 10 AND regexp_matches(" + PH + ", '^[0-9]+$')")} AS phone_format_valid, {b("contains(linkedin, 'linkedin.com/in/')")} AS linkedin_url_valid,
 ((co_name <> '')::INT + (co_industry <> '')::INT + (co_size <> '')::INT + (co_location <> '')::INT) / 4.0::DOUBLE AS company_data_complete,
 round(greatest(0, 1 + {pts("has_at AND co_domain <> '' AND domain <> co_domain", -0.2)} + {pts("regexp_matches(fn || ln, '[0-9]')", -0.3)}), 6) AS data_consistency_score FROM w""", XW)
def fea_18(t):
    r = TR.training_features(nested(t), AS_OF)
    return r.select("id", "seniority_level", "email_domain_type", "data_completeness_score", "phone_format_valid", "linkedin_url_valid", "company_data_complete", F.round("data_consistency_score", 6).alias("data_consistency_score"))


@query("fn_7", BASE, "SELECT id, " + case([(f"co_size = '{k}'", v) for k, v in {"1-10": 1, "11-50": 11, "51-200": 51, "201-500": 201, "501-1000": 501, "1001-5000": 1001, "5000+": 5000}.items()], 10) + " AS min_employees FROM w", XW)
def fn_7(t):
    return prepare(nested(t), AS_OF).select("id", TR.employee_range()["min"].alias("min_employees"))


@query("drv_12", ["feedback"], "SELECT id, " + case([(f"actual_outcome = '{k}'", f"'{v}'") for k, v in TR.OUTCOME_CLASS.items()], "'medium'") + " AS priority_class FROM feedback")
def drv_12(t):
    return t.feedback().select("id", TR.outcome_class(F.col("actual_outcome")).alias("priority_class"))


FSQL = "SELECT id, " + ", ".join(f"{F16[k]} AS {k}" for k in TR.KEY_FEATURES) + " FROM w"
TARGET = "title_seniority * 0.3::DOUBLE + email_quality_score * 0.2::DOUBLE + data_completeness * 0.2::DOUBLE + industry_relevance * 0.15::DOUBLE + company_size_score * 0.15::DOUBLE"


@query("drv_13", BASE, f"SELECT id, CASE WHEN {TARGET} >= 0.8::DOUBLE THEN 'high' WHEN {TARGET} >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS target FROM f", {**XW, "f": FSQL})
def drv_13(t):
    return TR.classifier_features(nested(t), AS_OF).select("id", TR.synthetic_target().alias("target"))


SS = case([(f"{SEN} = 'executive'", 0.4), (f"{SEN} = 'senior'", 0.3), (f"{SEN} = 'manager'", 0.2)], 0.1)
IS = case([(f"co_industry = '{k}'", v) for k, v in {"technology": 0.3, "finance": 0.25, "healthcare": 0.2, "consulting": 0.15, "manufacturing": 0.1}.items()], 0.05)
ZS = case([(f"co_size = '{k}'", v) for k, v in {"201-500": 0.2, "501-1000": 0.15, "51-200": 0.15, "1001-5000": 0.1, "11-50": 0.1, "1-10": 0.05, "5000+": 0.05}.items()], 0.05)
OS = case([(f"source = '{k}'", v) for k, v in {"referral": 0.1, "linkedin": 0.08, "event": 0.08, "website": 0.06, "webinar": 0.05, "directory": 0.03, "purchased": 0.01}.items()], 0.02)
LAB = f"""SELECT id, sen, CASE WHEN ps >= 0.7 THEN 'high' WHEN ps >= 0.4 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN qs >= 0.8 THEN 'excellent' WHEN qs >= 0.6 THEN 'good' WHEN qs >= 0.4 THEN 'fair' ELSE 'poor' END AS quality FROM (SELECT id, {SEN} AS sen,
 (({SS}) + ({IS}) + ({ZS}) + ({OS}))::DECIMAL(9,4) AS ps, ((email <> '')::INT * 0.3 + (has_at AND contains(email, '.'))::INT * 0.1 + (phone <> '')::INT * 0.2 + (linkedin <> '')::INT * 0.1 + (co_domain <> '')::INT * 0.1 + has_company::INT * 0.1 + (email <> '' AND co_domain <> '' AND domain = co_domain)::INT * 0.1)::DECIMAL(9,4) AS qs FROM w)"""


@query("drv_14", BASE, """SELECT id, priority, quality, CASE WHEN t >= 0.8 THEN 'high' WHEN t >= 0.5 THEN 'medium' ELSE 'low' END AS conversion_likely,
 CASE priority WHEN 'high' THEN 40 WHEN 'medium' THEN 25 ELSE 10 END + CASE quality WHEN 'excellent' THEN 30 WHEN 'good' THEN 20 WHEN 'fair' THEN 15 ELSE 5 END + CASE sen WHEN 'executive' THEN 30 WHEN 'senior' THEN 20 WHEN 'manager' THEN 15 ELSE 10 END AS label_score
FROM (SELECT *, CASE priority WHEN 'high' THEN 0.6 WHEN 'medium' THEN 0.4 ELSE 0.2 END + CASE quality WHEN 'excellent' THEN 0.4 WHEN 'good' THEN 0.3 WHEN 'fair' THEN 0.2 ELSE 0.1 END AS t FROM lab)""", {**XW, "lab": LAB})
def drv_14(t):
    return TR.label_rules(nested(t), AS_OF).select("id", "priority", "quality", "conversion_likely", "label_score")


@query("drv_15", BASE, f"""SELECT id, array_to_string(list_filter([CASE WHEN co_industry <> '' THEN replace(co_industry, '_', '-') END, CASE {SEN} WHEN 'executive' THEN 'decision-maker' WHEN 'senior' THEN 'influencer' END,
 CASE WHEN source IN ('referral', 'event', 'webinar') THEN 'warm-lead' WHEN source = 'linkedin' THEN 'social' END], lambda x: x IS NOT NULL), ',') AS tags FROM w""", XW)
def drv_15(t):
    return prepare(nested(t), AS_OF).select("id", F.array_join(TR.tags(), ",").alias("tags"))


@query("drv_16", BASE, "SELECT id, " + ", ".join(f"round(CASE WHEN s > 0 THEN {k} / s ELSE 0 END, 6) AS {k}" for k in TR.KEY_FEATURES) + f" FROM (SELECT *, {' + '.join(TR.KEY_FEATURES)} AS s FROM f)", {**XW, "f": FSQL})
def drv_16(t):
    r = TR.classifier_features(nested(t), AS_OF).select("id", TR.contributions().alias("m"))
    return r.select("id", *[F.round(F.col("m")[k], 6).alias(k) for k in TR.KEY_FEATURES])


@query("drv_17", BASE, """SELECT id, (CASE WHEN title_seniority > 0.8 OR title_seniority < 0.3 THEN 1 ELSE 0 END + CASE WHEN email_quality_score > 0.8::DOUBLE OR email_quality_score < 0.5 THEN 1 ELSE 0 END + CASE WHEN data_completeness > 0.8::DOUBLE OR data_completeness < 0.5 THEN 1 ELSE 0 END
 + CASE WHEN industry_relevance > 0.8 OR industry_relevance < 0.5 THEN 1 ELSE 0 END + CASE WHEN company_size_score > 0.8::DOUBLE OR company_size_score < 0.4 THEN 1 ELSE 0 END)::INT AS n_reasons FROM f""", {**XW, "f": FSQL})
def drv_17(t):
    return TR.classifier_features(nested(t), AS_OF).select("id", F.size(TR.reasoning()).alias("n_reasons"))


@query("agg_47", BASE, """SELECT 'priority' AS field, priority AS value, count(*) AS n FROM lab GROUP BY 2 UNION ALL SELECT 'quality', quality, count(*) FROM lab GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM w GROUP BY 2
 UNION ALL SELECT 'industry', co_industry, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'size', co_size, count(*) FROM w GROUP BY 2""", {**XW, "lab": LAB})
def agg_47(t):
    """Value counts of all fields in one pass: unpivot, then count."""
    r = TR.label_rules(nested(t), AS_OF)
    p = r.select("id", "priority", "quality", F.lower(F.coalesce("source", F.lit(""))).alias("source"), F.lower(F.coalesce("company.industry", F.lit(""))).alias("industry"), F.coalesce("company.size", F.lit("")).alias("size"))
    return p.unpivot(["id"], ["priority", "quality", "source", "industry", "size"], "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


@query("agg_51", ["models"], "SELECT count(*) AS total_models, count(DISTINCT purpose) AS purposes, round(avg(accuracy), 6) AS average_accuracy FROM models")
def agg_51(t):
    return t.models().agg(F.count("*").alias("total_models"), F.count_distinct("purpose").alias("purposes"), F.round(F.avg("accuracy"), 6).alias("average_accuracy"))


@query("agg_52", ["leads"], """
, p AS (SELECT status AS actual, CASE WHEN score >= 60 THEN 'converted' WHEN score >= 40 THEN 'qualified' WHEN score >= 20 THEN 'new' ELSE 'rejected' END AS predicted FROM leads),
k AS (SELECT actual AS k, count(*) AS s, count(*) FILTER (WHERE actual = predicted) AS tp FROM p GROUP BY 1), g AS (SELECT predicted AS k, count(*) AS g FROM p GROUP BY 1),
j AS (SELECT k.k, s, tp, CASE WHEN coalesce(g, 0) > 0 THEN tp::DOUBLE / g ELSE 0 END AS pr, tp::DOUBLE / s AS re FROM k LEFT JOIN g ON g.k = k.k)
SELECT sum(s)::BIGINT AS n_test, round(sum(tp)::DOUBLE / sum(s), 6) AS accuracy, round(sum(pr * s) / sum(s), 6) AS precision, round(sum(re * s) / sum(s), 6) AS recall, round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * s) / sum(s), 6) AS f1_score FROM j""")
def agg_52(t):
    s = F.col("score")
    p = t.leads(dates=False).select("status", F.when(s >= 60, "converted").when(s >= 40, "qualified").when(s >= 20, "new").otherwise("rejected").alias("guess"))
    m = ML.metrics_from_confusion(ML.confusion(p, "status", "guess"))
    return m.select("n_test", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


# ---- training ---------------------------------------------------------------------------------------------------

# The fixed defaults of forests, boosting and logistic regression. Where FEW_ROUNDS are given boosting runs few rounds: its rounds are
# many small jobs each.
FOREST = ML.DEFAULTS["priority"].params
FEW_ROUNDS, QUALITY_FOREST = {"maxIter": 5, "maxDepth": 4}, {"numTrees": 50, "maxDepth": 8}
BOOSTING = ML.DEFAULTS["conversion"].params
DEFAULT_QUALITY = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6}  # boosting of the default pair
LOGISTIC = {"maxIter": 1000}
SVM = {"maxIter": 100}  # Spark's default


#: Rows of a training table that one task holds: a forest of 100 trees keeps some 550 bytes of each in memory.
PART_ROWS = 200_000


def dealt(t, df, source="customer"):
    """``df`` by ``id`` in parts that grow in number with the rows of ``source``, at least one a core.

    Files and joins leave as few parts as their compressed bytes ask for, often one, and every pass of a fit is one task a part.
    """
    return df.repartition(max(t.spark.sparkContext.defaultParallelism, -(-t.raw(source).count() // PART_ROWS)), "id")


def fit_table(t, df, source="customer"):
    """``df`` dealt, in the order of ids, because a forest draws its rows by their place, and written down once because a fit reads it many times."""
    return cut_lineage(dealt(t, df, source).sortWithinPartitions("id"))


def dealt_leads(t):
    return with_company(dealt(t, t.leads()), t.companies())


def training_table(t):
    """Classifier features with the rule label, as :func:`fit_table` has them; dealt before the features, which are the narrow work."""
    r = TR.classifier_features(dealt_leads(t), AS_OF)
    return cut_lineage(r.withColumn("label", TR.synthetic_target()).select("id", "owner_id", "label", "status", *TR.CLASSIFIER_COLUMNS).sortWithinPartitions("id"))


def tidy(m):
    return m.select("purpose", "algorithm", "n_test", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


def run(t, algorithm="random_forest", params=None, purpose="priority", balanced=False, data=None):
    cfg = ML.TrainingConfig(purpose, algorithm, params=params or FOREST, balanced=balanced)
    return ML.train(data or training_table(t), TR.CLASSIFIER_COLUMNS, cfg)


@query("ml_1")
def ml_1(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    df = training_table(t).join(t.leads(dates=False).select("id", F.coalesce("source", F.lit("")).alias("source")), "id")
    cols = TR.KEY_FEATURES + ["source"]
    m = Pipeline(stages=ML.preprocessor(df, cols)).fit(df)
    return m.transform(df).select("id", F.size(vector_to_array("features")).alias("width"))


@query("ml_2")
def ml_2(t):
    return tidy(run(t)[1])


@query("ml_3")
def ml_3(t):
    data = training_table(t)
    out = None
    for algorithm, params in [("random_forest", FOREST), ("gradient_boosting", BOOSTING), ("logistic_regression", LOGISTIC), ("svm", SVM)]:
        m = tidy(run(t, algorithm, params, data=data)[1])
        out = m if out is None else out.unionByName(m)
    return out


@query("ml_4")
def ml_4(t):
    data = training_table(t)
    model, _, _ = run(t, data=data)
    return ML.predict(model, data).select("id", "predicted_class", F.round("confidence", 6).alias("confidence"))


@query("ml_5")
def ml_5(t):
    cfg = ML.TrainingConfig("priority", "random_forest", params={"numTrees": 10})
    return ML.tune(training_table(t), TR.CLASSIFIER_COLUMNS, cfg, {"maxDepth": [3, 5], "numTrees": [5, 10]}, folds=2)


@query("ml_6")
def ml_6(t):
    r = TR.training_features(nested(t), AS_OF).join(TR.label_rules(nested(t), AS_OF).select("id", "priority", F.col("label_score").cast("double").alias("label_score")), "id")
    r = fit_table(t, r.select("id", "priority", "label_score", *TR.PRIORITY_SET, *[c for c in TR.QUALITY_SET if c not in TR.PRIORITY_SET]))
    a = ML.train(r, TR.PRIORITY_SET, ML.TrainingConfig("priority", "random_forest", label="priority", params=FOREST))[1]
    q = ML.train(r, TR.QUALITY_SET, ML.TrainingConfig("quality", "gradient_boosting", "regression", "label_score", FEW_ROUNDS))[1]
    return a.select("purpose", "algorithm", "n_test", F.round("accuracy", 6).alias("metric")).unionByName(q.select("purpose", "algorithm", "n_test", F.round("r2_score", 6).alias("metric")))


def quality_table(t):
    f = TR.quality_features(nested(t), AS_OF).select("id", *TR.QUALITY_COLUMNS)
    return fit_table(t, f.join(six_dimensions(nested(t), AS_OF).select("id", "overall_score", *DIM_WEIGHTS), "id"))


@query("ml_7")
def ml_7(t):
    d = quality_table(t)
    out = None
    for label, algorithm, params in [("overall_score", "gradient_boosting", FEW_ROUNDS), *((d, "random_forest", QUALITY_FOREST) for d in DIM_WEIGHTS)]:
        m = ML.train(d, TR.QUALITY_COLUMNS, ML.TrainingConfig(label, algorithm, "regression", label, params))[1]
        out = m if out is None else out.unionByName(m)
    return out.select("purpose", "algorithm", "n_test", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2_score")])


@query("dq_25")
def dq_25(t):
    d = quality_table(t)
    models = {n: ML.train(d, TR.QUALITY_COLUMNS, ML.TrainingConfig("quality", n, "regression", "overall_score", p))[0] for n, p in (("gradient_boosting", FEW_ROUNDS), ("random_forest", QUALITY_FOREST))}
    out = d.select("id", F.col("overall_score").alias("rule_based"), *TR.QUALITY_COLUMNS)
    for n, m in models.items():
        out = m.transform(out).withColumnRenamed("prediction", n).select("id", "rule_based", *[c for c in ("gradient_boosting", "random_forest") if c == n or c in out.columns], *TR.QUALITY_COLUMNS)
    from ..functions.quality import ENSEMBLE_WEIGHTS

    cols = {k: F.col(k) for k in ENSEMBLE_WEIGHTS}
    best = F.greatest(*cols.values())
    return out.select("id", ensemble(cols, ENSEMBLE_WEIGHTS).alias("ensemble_score"), F.round(best, 2).alias("best_score"), F.when(best == F.col("rule_based"), "rule_based").when(best == F.col("gradient_boosting"), "gradient_boosting").otherwise("random_forest").alias("best_scorer"))


@query("ml_8")
def ml_8(t):
    data = training_table(t)
    models = [run(t, a, p, data=data)[0] for a, p in (("random_forest", FOREST), ("logistic_regression", LOGISTIC))]
    return ML.soft_vote(models, data).select("id", "predicted_class", F.round("confidence", 6).alias("confidence"))


@query("ml_9")
def ml_9(t):
    data = training_table(t)
    preds = {n: ML.predict(run(t, "random_forest", {"numTrees": 5 + i, "maxDepth": 4}, n, data=data)[0], data) for i, n in enumerate(ML.ENSEMBLE_WEIGHTS)}
    return ML.three_way(preds).withColumn("confidence", F.round("confidence", 6))


@query("ml_10")
def ml_10(t):
    return tidy(run(t, balanced=True)[1])


@query("ml_11")
def ml_11(t):
    """Feedback rows joined to the features of the rated lead, labelled by outcome."""
    p = t.predictions().select(F.col("id").alias("prediction_id"), "lead_id")
    fb = t.feedback().join(p, "prediction_id").select("lead_id", F.col("id").alias("fid"), TR.outcome_class(F.col("actual_outcome")).alias("label"))
    f = TR.classifier_features(dealt_leads(t), AS_OF).select(F.col("id").alias("lead_id"), *TR.CLASSIFIER_COLUMNS)
    data = fit_table(t, fb.join(f, "lead_id").withColumnRenamed("fid", "id"), "events")
    return tidy(run(t, data=data)[1])


@query("ml_12", BASE, None)
def ml_12(t):
    data = quality_table(t)
    model = ML.train(data, TR.QUALITY_COLUMNS, ML.TrainingConfig("quality", "random_forest", "regression", "overall_score", QUALITY_FOREST))[0]
    # Rows without an e-mail get no model value and so fall back to the rule.
    scored = model.transform(data).select("id", F.when(F.col("has_email") == 1, F.col("prediction")).alias("model_quality"))
    rows = nested(t).join(scored, "id", "left")
    return X.analyze(rows, AS_OF, model_quality=F.col("model_quality")).select("id", F.round("quality_score", 6).alias("quality_score"), F.round("priority_score", 6).alias("priority_score"))


@query("ml_13")
def ml_13(t):
    data = training_table(t)
    out = None
    for a, p in (("random_forest", FOREST), ("logistic_regression", LOGISTIC)):
        m = run(t, a, p, data=data)[0]
        e = ML.evaluate(m, data, ML.TrainingConfig("priority", a))
        out = e if out is None else out.unionByName(e)
    return tidy(out)


def scratch(t) -> str:
    """A folder of its own for one run, below the one that driver and executors share."""
    return f"{shared_folder(t.spark)}/run-{uuid.uuid4().hex}"


@query("ml_14")
def ml_14(t):
    data, path = training_table(t), scratch(t)
    model, metrics, _ = run(t, data=data)
    ML.save_model(model, f"{path}/priority_random_forest", tidy(metrics), f"{path}/registry")
    again = ML.predict(ML.load_model(f"{path}/priority_random_forest"), data).select("id", F.col("predicted_class").alias("reloaded"))
    return ML.predict(model, data).select("id", "predicted_class").join(again, "id").groupBy((F.col("predicted_class") == F.col("reloaded")).alias("same")).agg(F.count("*").alias("n"))


@query("ml_15")
def ml_15(t):
    data = training_table(t)
    model, _, _ = run(t, data=data)
    imp = ML.feature_importance(model, TR.CLASSIFIER_COLUMNS, 26)
    return ML.explain_predictions(data, imp, TR.CLASSIFIER_COLUMNS).select("id", "rn", "feature", F.round("contribution", 6).alias("contribution"))


@query("srt_9")
def srt_9(t):
    model, _, _ = run(t)
    return ML.feature_importance(model, TR.CLASSIFIER_COLUMNS, 10)


@query("ml_16")
def ml_16(t):
    """Owners with at least 50 leads, one fit over their rows together with the owner as a text feature."""
    data = training_table(t)
    enough = data.groupBy("owner_id").agg(F.count("*").alias("n")).where("n >= 50").select("owner_id")
    # Owners may be few, so the join leaves few parts.
    d = fit_table(t, data.join(enough, "owner_id", "left_semi").withColumn("owner", F.col("owner_id").cast("string")))
    if d.isEmpty():
        return t.spark.createDataFrame([], "purpose string, algorithm string, n_test bigint, accuracy double, precision double, recall double, f1_score double")
    m = ML.train(d, TR.CLASSIFIER_COLUMNS + ["owner"], ML.TrainingConfig("priority", params=FOREST))[1]
    return tidy(m)


@query("ml_17")
def ml_17(t):
    """Samples written as JSON lines with nested features and read back."""
    from ..sources.readers import read_samples

    path = f"{scratch(t)}/samples"
    training_table(t).select(F.struct(*TR.CLASSIFIER_COLUMNS).alias("features"), "label", F.col("id").alias("lead_id")).write.json(path)
    d = read_samples(t.spark, path, TR.CLASSIFIER_COLUMNS)
    return tidy(run(t, data=fit_table(t, d.withColumnRenamed("lead_id", "id")))[1])


@query("ml_19", ["models", "predictions"], """SELECT m.purpose, m.id, m.model_name, m.accuracy, coalesce(n, 0) AS predictions FROM (SELECT *, split_part(model_name, '_', 1) AS k FROM models QUALIFY row_number() OVER (PARTITION BY purpose ORDER BY id DESC) = 1) m
LEFT JOIN (SELECT model_type, count(*) AS n FROM predictions GROUP BY 1) p ON p.model_type = m.k""")
def ml_19(t):
    latest = t.models().groupBy("purpose").agg(F.max_by(F.struct("id", "model_name", "accuracy"), "id").alias("m")).select("purpose", "m.*")
    n = A.count_by(t.predictions(), "model_type", name="predictions")
    return latest.withColumn("model_type", F.split_part("model_name", F.lit("_"), F.lit(1))).join(n, "model_type", "left").select("purpose", "id", "model_name", "accuracy", F.coalesce("predictions", F.lit(0)).alias("predictions"))


@query("ml_20")
def ml_20(t):
    data = training_table(t)
    out = None
    for purpose, cfg in ML.DEFAULTS.items():
        # Where the default is boosting, a small forest stands in for it.
        boosted = cfg.algorithm == "gradient_boosting"
        algorithm, params = ("random_forest", {"numTrees": 5, "maxDepth": 4}) if boosted else (cfg.algorithm, cfg.params)
        m = tidy(run(t, algorithm, params, purpose, data=data)[1])
        out = m if out is None else out.unionByName(m)
    return out


@query("ml_21")
def ml_21(t):
    p = t.predictions().select(F.col("id").alias("prediction_id"), "lead_id")
    fb = t.feedback().join(p, "prediction_id").select(F.col("id").alias("fid"), "lead_id", X.outcome_score(F.col("actual_outcome"), F.col("rating")).alias("score"))
    f = X.with_features(dealt_leads(t), AS_OF).select(F.col("id").alias("lead_id"), *[F.col(c).cast("double").alias(c) for c in X.VECTOR])
    d = fit_table(t, fb.join(f, "lead_id").withColumnRenamed("fid", "id").withColumn("label", F.when(F.col("score") > 70, "yes").otherwise("no")), "events")
    a = ML.train(d, X.VECTOR, ML.TrainingConfig("priority", "random_forest", params=FOREST, balanced=True))[1]
    q = ML.train(d, X.VECTOR, ML.TrainingConfig("quality", "gradient_boosting", "regression", "score", DEFAULT_QUALITY))[1]
    return a.select("purpose", "algorithm", "n_test", F.round("accuracy", 6).alias("metric")).unionByName(q.select("purpose", "algorithm", "n_test", F.round("mae", 6).alias("metric")))
