"""Table scans and imports (SRC-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import present
from ..functions.score import ScoringConfig, with_lead_score
from .schemas import COMPANY_FIELDS, LEAD_FIELDS, LEAD_IMPORT


def scan(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """SRC-1."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def read_leads(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC-2 input: JSON lines (or one array) with a nested company, or CSV with ``company_*`` columns."""
    if fmt == "json":
        return spark.read.schema(LEAD_IMPORT).json(path)
    if fmt == "csv":
        flat = spark.read.option("header", True).csv(path)
        have = {c for c in flat.columns}
        pick = lambda c, name, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(name)
        company = F.struct(*[pick(f"company_{k}", k, v) for k, v in COMPANY_FIELDS.items() if v in ("string", "bigint")],
                           *[F.lit(None).cast(v).alias(k) for k, v in COMPANY_FIELDS.items() if v not in ("string", "bigint")])
        lead = [pick(k, k, v) for k, v in LEAD_FIELDS.items()]
        return flat.select(*lead, company.alias("company"))
    raise ValueError(f"unsupported format: {fmt}")


def bulk_import(rows: DataFrame, owner_id: int, campaign_id: int, as_of: str) -> DataFrame:
    """SRC-2: owner, campaign and score on every row."""
    scored = with_lead_score(rows, as_of, ScoringConfig(null_policy="blank"), name="score")
    return scored.withColumns({"owner_id": F.lit(owner_id).cast("bigint"), "campaign_id": F.lit(campaign_id).cast("bigint"), "status": F.lit("new")})


def read_samples(spark: SparkSession, path: str, columns, multi_line: bool = False) -> DataFrame:
    """SRC-3: training samples with nested features, a label and a lead id."""
    schema = "features struct<" + ",".join(f"{c}:double" for c in columns) + ">, label string, lead_id bigint"
    return spark.read.schema(schema).option("multiLine", multi_line).json(path).select("features.*", "label", "lead_id")


# Fixed column lengths of the stored tables.
COMPANY_LENGTHS = {"name": 255, "domain": 255, "industry": 255, "size": 50, "location": 255, "website": 500, "description": 1000}
LEAD_LENGTHS = {"first_name": 100, "last_name": 100, "email": 255, "phone": 50, "title": 255, "linkedin_url": 500, "source": 50}


def ingest(scraped: DataFrame, companies: DataFrame, owner_id: int, as_of: str, email_table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-4: new companies and new leads of a scraped batch.

    Companies are found by domain; each unknown domain adds one company, whose id is a hash of the domain, so that a
    rerun of the batch gives the same ids. ``email_table`` (id, email) fills blank addresses.
    """
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    named = scraped.where(present(F.col("company.name")))
    incoming = named.select(*[cut(F.col(f"company.{c}"), n).alias(c) for c, n in COMPANY_LENGTHS.items()])
    known = companies.groupBy("domain").agg(F.min("id").alias("company_id"))
    one = incoming.join(known.select("domain"), "domain", "left_anti").groupBy("domain").agg(F.min(F.struct(*[c for c in COMPANY_LENGTHS if c != "domain"])).alias("c"))
    fresh = one.select((F.xxhash64("domain").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)).alias("id"), "domain", "c.*")
    ids = known.unionByName(fresh.select("domain", F.col("id").alias("company_id")))
    rows = scraped.withColumn("_domain", F.when(present(F.col("company.name")), cut(F.col("company.domain"), 255))).join(
        ids.withColumnRenamed("domain", "_domain"), "_domain", "left").drop("_domain")
    if email_table is not None:
        fill = email_table.select("id", F.col("email").alias("_mail"))
        ask = ~present(F.col("email")) & present(F.col("first_name")) & present(F.col("last_name")) & present(F.col("company.domain"))
        rows = rows.join(fill, "id", "left").withColumn("email", F.when(ask, F.coalesce("_mail", "email")).otherwise(F.col("email"))).drop("_mail")
    scored = with_lead_score(rows, as_of, ScoringConfig(null_policy="blank"), name="new_score")
    leads = scored.select("id", *[cut(F.col(c), n).alias(c) for c, n in LEAD_LENGTHS.items()], F.lit("new").alias("status"), F.col("new_score").alias("score"), F.lit(owner_id).cast("bigint").alias("owner_id"), "company_id")
    return fresh, leads
