"""Registered queries train with the defaults, not with less."""

from leadlake.operators import ml as ML
from leadlake.plans import learning
from leadlake.sources.bindings import Tables


def asked(spark, monkeypatch, query):
    seen = []
    one = spark.createDataFrame([("p", "a", 1, 1.0, 1.0, 1.0, 1.0)], "purpose string, algorithm string, n_test long, accuracy double, precision double, recall double, f1_score double")
    monkeypatch.setattr(learning, "training_table", lambda t: None)
    monkeypatch.setattr(learning, "run", lambda t, algorithm="random_forest", params=None, purpose="priority", **_: (seen.append((purpose, algorithm, params)), one))
    query(None)
    return seen


def test_support_vectors_run_their_default(spark, monkeypatch):
    svm = next(params for _, algorithm, params in asked(spark, monkeypatch, learning.ml_3) if algorithm == "svm")
    assert ML.estimator("svm", "classification", 2, svm).getMaxIter() >= 100


def test_purposes_without_boosting_train_their_default(spark, monkeypatch):
    seen = {p: (a, params) for p, a, params in asked(spark, monkeypatch, learning.ml_20)}
    assert set(seen) == set(ML.DEFAULTS)
    assert all(seen[p] == (c.algorithm, c.params) for p, c in ML.DEFAULTS.items() if c.algorithm != "gradient_boosting")


def test_boosting_of_the_algorithms_runs_its_default(spark, monkeypatch):
    boosted = next(params for _, algorithm, params in asked(spark, monkeypatch, learning.ml_3) if algorithm == "gradient_boosting")
    one = ML.estimator("gradient_boosting", "classification", 2, boosted)
    assert (one.getMaxIter(), one.getStepSize(), one.getMaxDepth()) == (200, 0.05, 6)
    assert ML.estimator("gradient_boosting", "classification", 3, boosted).getClassifier().getMaxIter() == 200


def test_default_pair_trains_its_defaults(spark, sf_dir, monkeypatch):
    seen = []

    def train(df, columns, cfg):
        seen.append(cfg)
        return None, spark.createDataFrame([("p", "a", 1, 1.0, 1.0)], "purpose string, algorithm string, n_test long, accuracy double, mae double"), None

    monkeypatch.setattr(ML, "train", train)
    learning.ml_21(Tables(spark, sf_dir))
    forest, boosted = (ML.estimator(c.algorithm, c.task, 2, c.params) for c in seen)
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, 10)
    assert (boosted.getMaxIter(), boosted.getStepSize(), boosted.getMaxDepth()) == (100, 0.1, 6)
