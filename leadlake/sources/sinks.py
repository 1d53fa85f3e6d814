"""Exports and table writes (SNK-*). All writers stream partitions out; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import text
from ..operators.tables import insert_absent, merge_upsert

EXPORT = ["first_name", "last_name", "email", "phone", "title", "linkedin_url", "source", "status"]
EXPORT_COMPANY = ["name", "domain", "industry", "size", "location"]
HEADERS = ["First Name", "Last Name", "Email", "Phone", "Title", "LinkedIn URL", "Source", "Status", "Score", "Company Name", "Company Domain", "Company Industry", "Company Size", "Company Location", "Created At"]


def flat_export(df: DataFrame, extra=()) -> DataFrame:
    """SNK-1 projection: the fixed 15 columns, missing text as '' and missing score as 0."""
    return df.select(*[text(F.col(c)).alias(c) for c in EXPORT], F.coalesce("score", F.lit(0.0)).alias("score"),
                     *[text(F.col(f"company.{c}")).alias(f"company_{c}") for c in EXPORT_COMPANY], text(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created_at"), *extra)


def export_leads(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """SNK-4: csv, xlsx (the sheet's columns under display headers, as CSV) or json; anything else is refused."""
    if fmt == "csv":
        # An empty text is written as "" and read back as such.
        flat_export(df).write.option("header", True).option("emptyValue", '""').csv(path)
    elif fmt == "xlsx":
        flat_export(df).toDF(*HEADERS).write.option("header", True).option("emptyValue", '""').csv(path)
    elif fmt == "json":
        df.withColumn("created_at", F.col("created_at").cast("string")).write.json(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def flatten(df: DataFrame) -> DataFrame:
    """SNK-7: company fields as ``company_*`` columns, array columns joined by ', '."""
    kinds = dict(df.dtypes)
    lead = [F.array_join(c, ", ").alias(c) if kinds[c].startswith("array<string") else F.col(c) for c in df.columns if c != "company"]
    inner = {f.name: f.dataType.simpleString() for f in df.schema["company"].dataType}

    def show(n, k) -> Column:
        c = F.col(f"company.{n}")
        return F.array_join(c, ", ") if k.startswith("array") else F.to_json(c) if k.startswith("map") else c

    # A company field never overwrites a lead column of the flattened name.
    return df.select(*lead, *[show(n, k).alias(f"company_{n}") for n, k in inner.items() if f"company_{n}" not in df.columns])


def save_dataset(df: DataFrame, path: str, fmt: str = "json") -> None:
    """SNK-6."""
    writers = {"json": lambda: df.write.json(path), "csv": lambda: flatten(df).write.option("header", True).csv(path), "parquet": lambda: df.write.parquet(path)}
    if fmt not in writers:
        raise ValueError(f"unsupported format: {fmt}")
    writers[fmt]()


def write_rows(df: DataFrame, path: str, fmt: str) -> None:
    """SNK-8."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unsupported format: {fmt}")
    w = df.write
    (w.option("header", True).csv if fmt == "csv" else w.json)(path)


def long_metrics(row: DataFrame, ids, metric_type: str, category: str) -> DataFrame:
    """SNK-9/10: numeric columns of a report in long form (metric_type, metric_name, value, category)."""
    numeric = [c for c, k in row.dtypes if k in ("int", "bigint", "double", "float") and c not in ids]
    wide = row.select(*ids, *[F.col(c).cast("double").alias(c) for c in numeric])
    return wide.unpivot(list(ids), numeric, "metric_name", "value").withColumns({"metric_type": F.lit(metric_type), "category": F.lit(category)})


def prediction_rows(scored: DataFrame, as_of: str, version: str = "1.0.0") -> DataFrame:
    """SNK-11: one prediction per analysed lead."""
    return scored.select(F.col("id").alias("lead_id"), F.lit("priority").alias("model_type"), F.lit(version).alias("model_version"), F.col("priority_score").alias("prediction_score"), "confidence",
                         F.col("reason").alias("explanation"), F.lit(50.0).alias("processing_time_ms"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"))


def insight_rows(scored: DataFrame, as_of: str) -> DataFrame:
    return scored.select(F.col("id").alias("lead_id"), F.lit("priority").alias("insight_type"), F.col("reason").alias("insight_text"), F.to_json("actions").alias("action_items"), "priority_level",
                         F.col("confidence").alias("confidence_score"), F.col("priority_score").alias("impact_score"), "urgency_score", F.lit("active").alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"))


def quality_rows(assessed: DataFrame, as_of: str, method: str = "batch_automated") -> DataFrame:
    return assessed.select(F.col("id").alias("lead_id"), "overall_score", "email_quality", "completeness_score", "accuracy_score", "consistency_score", "freshness_score",
                           F.to_json(F.transform("issues", lambda i: i.description)).alias("issues_found"), F.to_json("suggestions").alias("suggestions"), F.lit(method).alias("assessment_method"),
                           F.lit(as_of).cast("timestamp_ntz").alias("created_at"))


def delete_leads(gone: DataFrame, leads: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """SNK-14: leads and their child rows without the given ids."""
    ids = gone.select("id").distinct()
    out = {"leads": leads.join(ids, "id", "left_anti")}
    for name, child in children.items():
        out[name] = child.join(ids.withColumnRenamed("id", "lead_id"), "lead_id", "left_anti")
    return out


# Fixed status values of an insight.
INSIGHT_STATES = ["active", "resolved", "dismissed"]


def update_status(insights: DataFrame, leads: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-15: (new table, rejected updates). An update (id, new_status, user_id, feedback) applies when its status is in
    the closed list and the insight's lead belongs to the user; ids are unique in ``updates``."""
    owner = insights.select("id", "lead_id").join(leads.select(F.col("id").alias("lead_id"), "owner_id"), "lead_id").select("id", "owner_id")
    judged = updates.join(owner, "id", "left").withColumn("ok", F.col("new_status").isin(INSIGHT_STATES) & F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False)))
    good = judged.where("ok").select("id", "new_status", "feedback")
    table = insights.join(good, "id", "left").withColumn("status", F.coalesce("new_status", "status")).withColumnRenamed("feedback", "user_feedback").drop("new_status")
    return table, judged.where("NOT ok").select("id", "new_status", "user_id")


def enrichment_rows(opportunities: DataFrame, pending: DataFrame, as_of: str) -> DataFrame:
    """SNK-18: suggestions for leads that have none pending; they expire after 30 days."""
    have = pending.where("status = 'pending'").select("lead_id").distinct()
    rows = opportunities.select(F.col("id").alias("lead_id"), F.explode("opportunities").alias("o")).join(have, "lead_id", "left_anti")
    return rows.select("lead_id", F.col("o.field").alias("missing_field"), "o.priority", F.col("o.impact").alias("estimated_impact"), F.lit("pending").alias("status"),
                       (F.lit(as_of).cast("timestamp_ntz") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))


def log_rows(df: DataFrame, operation: str, as_of: str, details) -> DataFrame:
    """SNK-20."""
    return df.select(F.lit(operation).alias("operation_type"), F.lit("lead").alias("entity_type"), F.col("id").alias("entity_id"), F.col("owner_id").alias("user_id"), F.lit("completed").alias("processing_status"),
                     F.lit(as_of).cast("timestamp_ntz").alias("start_time"), F.to_json(F.struct(*details)).alias("details"))


def feedback_rows(incoming: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-21: (accepted rows with sentiment, rejected rows without a known prediction)."""
    from ..operators.aggregates import sentiment

    known = predictions.select(F.col("id").alias("prediction_id"))
    mood = F.coalesce("sentiment", sentiment(F.col("rating"))) if "sentiment" in incoming.columns else sentiment(F.col("rating"))
    return incoming.join(known, "prediction_id", "left_semi").withColumn("sentiment", mood), incoming.join(known, "prediction_id", "left_anti")


__all__ = [n for n in dir() if not n.startswith("_")] + ["insert_absent", "merge_upsert"]
