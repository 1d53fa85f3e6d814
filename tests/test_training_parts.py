"""Training rows are spread over tasks, however few bytes or classes they have."""

from pyspark.sql import functions as F

from leadlake.operators import ml as ML
from leadlake.plans import learning
from leadlake.sources.bindings import Tables


def rows_by_part(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_class_weights_leave_rows_where_they_are(spark):
    rows = spark.range(4000).repartition(8, "id").withColumn("label", F.when(F.col("id") % 10 == 0, "a").otherwise("b"))
    out = ML.with_class_weights(rows, "label")
    assert len(rows_by_part(out)) == 8
    assert {(r.label, r.weight__w) for r in out.select("label", "weight__w").distinct().collect()} == {("a", 5.0), ("b", 4000 / 7200)}


def test_parts_of_a_training_table_grow_with_its_rows(spark, sf_dir, monkeypatch):
    t = Tables(spark, sf_dir)
    assert len(rows_by_part(learning.training_table(t))) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(learning, "PART_ROWS", 5)
    parts = rows_by_part(learning.training_table(t))
    assert sum(parts) == 150 and len(parts) > 20 and max(parts) < 20


def test_feedback_rows_are_dealt(spark, sf_dir, monkeypatch):
    seen = []

    def train(df, columns, cfg):
        seen.append(rows_by_part(df))
        return None, spark.createDataFrame([("p", "a", 1, 1.0, 1.0)], "purpose string, algorithm string, n_test long, accuracy double, mae double"), None

    monkeypatch.setattr(ML, "train", train)
    monkeypatch.setattr(learning, "PART_ROWS", 50)
    learning.ml_21(Tables(spark, sf_dir))
    n = Tables(spark, sf_dir).raw("events").count()
    assert len(seen) == 2 and all(len(parts) >= n // 50 - 2 for parts in seen)


def test_kept_nodes_give_the_same_forest(spark, sf_dir):
    data = learning.training_table(Tables(spark, sf_dir))
    params = {"numTrees": 5, "maxDepth": 5}
    asked = [learning.run(None, params={**params, **more}, data=data)[0].stages[-1] for more in ({}, {"cacheNodeIds": False})]
    assert asked[0].getCacheNodeIds() and not asked[1].getCacheNodeIds()
    assert asked[0].toDebugString.splitlines()[1:] == asked[1].toDebugString.splitlines()[1:]
