"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import WORD, free_name, whole_text, written

MARGINS = ("source", "lang", "topic")
ROUNDS = 12
TEMPER = 0.8
NONE = "(none)"


def topic(text: str | Column = "text") -> Column:
    """A coarse topic by what a text holds: legal, table, contact or prose; the first that applies."""
    low = F.lower(whole_text(text))
    return F.when(low.contains("license") | low.contains("copyright"), "legal").when(low.contains(" | "), "table").when(low.contains("@"), "contact").otherwise("prose")


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def named(column: str | Column) -> Column:
    """A category as text; null is a category of its own."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(NONE))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Targets (value, target) of one margin: its token shares raised to ``power`` and brought back to a sum of 1.

    A power below 1 lifts small categories; 1 keeps the corpus as it is; 0 makes all categories equal.
    """
    raised = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0").select("value", F.pow(F.col("t").cast("double"), F.lit(float(power))).alias("target"))
    total = raised.agg(F.sum("target")).first()[0]
    return raised.withColumn("target", F.col("target") / F.lit(total or 1.0))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the margins' columns, tokens) with ``factor``: token weights tokens * factor meet the targets of every margin.

    Each round scales the cells of every category to the category's target in turn, by a window over the category: windows
    run over cells, of which there are at most as many as combinations of categories, never over documents. Categories
    without a target or without tokens keep their factor. As many rounds are run as asked for, each written down;
    margins that contradict each other keep the last one exact.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("factor", F.lit(1.0))
    for m, goal in targets.items():
        now = now.join(goal.select(F.col("value").alias(m), F.col("target").alias(f"target_{m}")), m, "left")
    now = cut_lineage(now)
    for _ in range(rounds):
        for m in targets:
            mass = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(m))
            scale = F.when((mass > 0) & F.col(f"target_{m}").isNotNull(), F.col(f"target_{m}") * F.lit(float(total)) / mass).otherwise(F.lit(1.0))
            now = now.withColumn("factor", F.col("factor") * scale)
        now = cut_lineage(now)
    return now.select(*targets, "tokens", "factor")


def uniform(doc_id: str | Column) -> Column:
    """A number in [0, 1) from the id alone; a null id counts as ''."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def level(rows: DataFrame, most: Column, want: Column, goal: float) -> float:
    """The factor c at which the sum of least(most, c * want) over ``rows`` is ``goal``; enough to reach every ``most`` if it is more.

    Newton's steps on a concave function from below: what is full stays full, the rest is raised to what is missing. Each step
    is one aggregate, and there are at most as many as rows, mostly a few.
    """
    rows = cut_lineage(rows.select(most.cast("double").alias("most"), want.cast("double").alias("want")).where("most > 0 AND want > 0"))
    all_, total, top = rows.agg(F.sum("want"), F.sum("most"), F.max(F.col("most") / F.col("want"))).first()
    if not all_:
        return 1.0
    if goal >= total:
        return float(top)
    c = goal / all_
    while True:
        full = F.lit(c) * F.col("want") >= F.col("most")
        fixed, free = rows.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("want")))).first()
        if not free or (goal - fixed) / free <= c * (1 + 1e-12):
            return c
        c = (goal - fixed) / free


def kept_share(cells: DataFrame, goals: dict[str, DataFrame], rounds: int, keep: float) -> DataFrame:
    """``cells`` (the margins' columns, tokens) with factor and probability = least(1, factor), of which the expected tokens
    are ``keep`` of all.

    Raking as in :func:`rake`, but of the tokens that stay: a cell at probability 1 is full and the rest of its category is
    raised instead. A category that cannot reach its target stays whole, and what it lacks goes to the others in proportion.
    """
    goal = keep * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("factor", F.lit(float(keep)))
    for m, want in goals.items():
        have = cut_lineage(cells.groupBy(m).agg(F.sum("tokens").alias("most")).join(want.select(F.col("value").alias(m), F.col("target").alias("want")), m))
        c = level(have, F.col("most"), F.col("want"), goal)
        now = now.join(have.select(m, F.least("most", F.col("want") * F.lit(c)).alias(f"goal_{m}")), m, "left")
    now = cut_lineage(now)
    for _ in range(rounds):
        for m in goals:
            mass = F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor"))).over(Window.partitionBy(m))
            now = now.withColumn("factor", F.col("factor") * F.when((mass > 0) & F.col(f"goal_{m}").isNotNull(), F.col(f"goal_{m}") / mass).otherwise(F.lit(1.0)))
        now = cut_lineage(now)
    c = level(now, F.col("tokens"), F.col("tokens") * F.col("factor"), goal)
    return now.select(*goals, "tokens", (F.col("factor") * F.lit(c)).alias("factor")).withColumn("probability", F.least(F.lit(1.0), F.col("factor")))


def plan(docs: DataFrame, power: float | dict[str, float] = TEMPER, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, tokens: Column | None = None, topics: Column | None = None, keep: float | None = None) -> DataFrame:
    """One row for each cell (source, lang, topic): tokens, factor, probability.

    Without ``keep`` the probability is proportional to the factor, and 1 where the factor is largest: so every cell is sampled
    at exactly its raked rate and the expected tokens of every margin stand in the target proportions, but one rare cell sets
    the rate of all. With ``keep`` the expected tokens are that share of all tokens (see :func:`kept_share`).
    """
    cells = cut_lineage(docs.select(named("source").alias("source"), named("lang").alias("lang"), (topic() if topics is None else topics).alias("topic"), (n_words() if tokens is None else tokens).alias("tokens")).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    goals = {m: (targets or {}).get(m) for m in MARGINS}
    powers = power if isinstance(power, dict) else dict.fromkeys(MARGINS, power)
    goals = {m: tempered(cells, m, powers[m]) if g is None else g for m, g in goals.items()}
    if keep is not None:
        return written(kept_share(cells, goals, rounds, keep))[0]
    raked = rake(cells, goals, rounds)
    top = raked.where("tokens > 0").agg(F.max("factor")).first()[0]
    # As a table its size is known, so the planner itself broadcasts it below its threshold and no text is shuffled.
    return written(raked.withColumn("probability", F.least(F.lit(1.0), F.col("factor") / F.lit(float(top or 1.0)))))[0]


def mixed(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, lang, topic, n_words, probability, sampled.

    A row is sampled if a number drawn from its doc_id lies below its cell's probability, so repeated rows share their fate
    and a rerun gives the same sample. Null source or language is the category "(none)"; texts without words weigh nothing
    and are sampled at their cell's rate; an empty table gives no rows; other columns of ``docs`` are not read. Only built-in
    functions run. The documents meet the cells by one equi-join; cells are as few as the combinations of categories.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), named("source").alias("source"), named("lang").alias("lang"), topic().alias("topic"), n_words().alias("n_words"))
    rates = plan(docs, **options).select(*MARGINS, "probability")
    return rows.join(rates, list(MARGINS)).select("doc_id", *MARGINS, "n_words", F.round("probability", 9).alias("probability"), (uniform("doc_id") < F.col("probability")).alias("sampled"))


def sampled(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The sampled rows of ``docs``, all columns as they were."""
    names = {m: free_name(docs, f"_{m}") for m in MARGINS}
    p = free_name(docs, "_probability")
    rates = plan(docs, **options).select(*(F.col(m).alias(n) for m, n in names.items()), F.col("probability").alias(p))
    marked = docs.withColumns({names["source"]: named("source"), names["lang"]: named("lang"), names["topic"]: topic()})
    return marked.join(rates, list(names.values())).where(uniform(doc_id) < F.col(p)).select(*(F.col(f"`{c}`") for c in docs.columns))
