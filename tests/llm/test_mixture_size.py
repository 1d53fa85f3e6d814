"""The mixture's size is its target, whatever rare cells there are."""

from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from leadlake.llm import mixing
from leadlake.llm.base import table


def share(cells):
    return sum(c.tokens * c.probability for c in cells) / sum(c.tokens for c in cells)


def test_rare_rows_leave_the_size(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rare = spark.createDataFrame([(10**6, "word " * 50, "xx", "misspelt")], docs.schema)
    plain, more = (mixing.plan(d, keep=0.5).collect() for d in (docs, docs.unionByName(rare)))
    assert share(plain) == pytest.approx(0.5, abs=1e-6) and share(more) == pytest.approx(0.5, abs=1e-6)
    before = {(c.source, c.lang, c.topic): c.probability for c in plain}
    assert max(abs(before[k] - c.probability) for c in more if (k := (c.source, c.lang, c.topic)) in before) < 0.1
    base, got = defaultdict(float), defaultdict(float)
    for c in plain:
        base[c.source] += c.tokens
        got[c.source] += c.tokens * c.probability
    total, mass = sum(v**mixing.TEMPER for v in base.values()), sum(got.values())
    assert all(abs(got[v] / mass - base[v] ** mixing.TEMPER / total) < 0.02 for v in base)


def test_stage_keeps_its_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rare = docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "source": F.lit("misspelt"), "lang": F.lit("xx"), "text": F.lit("word " * 50)})
    sizes = [corpus_pipeline.mixture(spark, d, sf_dir).count() for d in (docs, docs.unionByName(rare))]
    assert abs(sizes[0] - sizes[1]) <= 0.1 * docs.count() and sizes[1] >= 0.35 * docs.count()


@pytest.mark.parametrize("goal,want", [(3.0, 1.0), (17.0, 7.0), (40.0, 10.0)])
def test_level(spark, goal, want):
    rows = spark.createDataFrame([(5.0, 1.0), (10.0, 1.0), (5.0, 1.0), (0.0, 1.0)], "most double, want double")
    c = mixing.level(rows, F.col("most"), F.col("want"), goal)
    assert c == pytest.approx(want)
