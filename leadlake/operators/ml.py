"""Training, evaluation and prediction on tables with ``pyspark.ml`` (ML-*). Every fit and transform is distributed."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class TrainingConfig:
    purpose: str
    algorithm: str = "random_forest"
    task: str = "classification"
    label: str = "label"
    params: dict = field(default_factory=dict)
    balanced: bool = False
    test_share: float = 0.2
    min_rows: int = 10


# Fixed defaults per purpose and preset.
DEFAULTS = {
    "priority": TrainingConfig("priority", "random_forest", params={"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2}),
    "quality": TrainingConfig("quality", "gradient_boosting", "regression", params={"maxIter": 150, "stepSize": 0.1, "maxDepth": 8}),
    "similarity": TrainingConfig("similarity", "random_forest", params={"numTrees": 80, "maxDepth": 12}),
    "conversion": TrainingConfig("conversion", "gradient_boosting", params={"maxIter": 200, "stepSize": 0.05, "maxDepth": 6}),
    "timing": TrainingConfig("timing", "logistic_regression", params={"maxIter": 1000}),
}
PRESETS = {
    "priority_classifier": TrainingConfig("priority", "random_forest", params={"numTrees": 100, "maxDepth": 10}, balanced=True),
    "quality_classifier": TrainingConfig("quality", "gradient_boosting", params={"maxIter": 100, "maxDepth": 6}),
    "conversion_classifier": TrainingConfig("conversion", "ensemble"),
}


def split(df: DataFrame, label: str, share: float = 0.2, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Repeatable split: rows fall to the test side by a hash of (label, key), so every class is cut at the same share."""
    h = F.pmod(F.xxhash64(F.col(label).cast("string"), F.col(key)), F.lit(10000))
    return df.where(h >= share * 10000), df.where(h < share * 10000)


def preprocessor(df: DataFrame, columns) -> list:
    """ML-1: median impute and scale numbers; index and one-hot texts with unseen values kept apart."""
    types = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in columns if not isinstance(types[c], T.StringType)]
    text = [c for c in columns if isinstance(types[c], T.StringType)]
    stages, parts = [], []
    if numeric:
        stages += [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric]),
                   VectorAssembler(inputCols=[f"{c}__i" for c in numeric], outputCol="numeric__v"), StandardScaler(inputCol="numeric__v", outputCol="numeric__s", withMean=True, withStd=True)]
        parts.append("numeric__s")
    if text:
        # Blank and null texts become one constant category.
        fills = ", ".join(f"coalesce(nullif(`{c}`, ''), 'missing') AS `{c}__t`" for c in text)
        stages.append(SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"))
        stages += [StringIndexer(inputCols=[f"{c}__t" for c in text], outputCols=[f"{c}__x" for c in text], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__x" for c in text], outputCols=[f"{c}__o" for c in text])]
        parts += [f"{c}__o" for c in text]
    return stages + [VectorAssembler(inputCols=parts, outputCol="features")]


def estimator(algorithm: str, task: str, classes: int, params: dict, weight: str | None = None):
    """ML-3. Boosting and support vectors are two-class in Spark, so more classes go one against the rest.

    A forest keeps the node of each row and tree instead of finding it from the root at every level; the trees are the same.
    """
    if algorithm == "random_forest":
        params = {"cacheNodeIds": True, **params}
    if task == "regression":
        kinds = {"random_forest": RandomForestRegressor, "gradient_boosting": GBTRegressor, "xgboost": GBTRegressor, "linear_regression": LinearRegression}
        e = kinds[algorithm](featuresCol="features", labelCol="label__x")
        return _set(e, params)
    kinds = {"random_forest": RandomForestClassifier, "gradient_boosting": GBTClassifier, "xgboost": GBTClassifier, "logistic_regression": LogisticRegression, "svm": LinearSVC}
    e = _set(kinds[algorithm](featuresCol="features", labelCol="label__x"), params)
    if weight:
        e.setWeightCol(weight)
    if classes > 2 and algorithm in ("gradient_boosting", "xgboost", "svm"):
        # The classes are fitted side by side, since a boosting round is many small jobs.
        return OneVsRest(classifier=e, featuresCol="features", labelCol="label__x", parallelism=min(classes, 8), **({"weightCol": weight} if weight else {}))
    return e


def _set(e, params: dict):
    for k, v in params.items():
        if e.hasParam(k):
            e.set(e.getParam(k), v)
    if e.hasParam("seed"):
        e.set(e.getParam("seed"), 42)
    return e


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * class size), joined back from the class counts. These are one row a class, so they go to the rows: by label the rows would come to as few tasks as there are classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = counts.crossJoin(totals).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight__w"))
    return df.join(F.broadcast(weights), label)


def train(df: DataFrame, columns, cfg: TrainingConfig) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """ML-2/6: fitted pipeline, one-row metrics and test predictions."""
    spark = df.sparkSession
    data = df.where(F.col(cfg.label).isNotNull()).select("id", cfg.label, *columns)
    fit, test = split(data, cfg.label, cfg.test_share)
    stages = preprocessor(data, columns)
    if cfg.task == "classification":
        indexer = StringIndexer(inputCol=cfg.label, outputCol="label__x", stringOrderType="alphabetAsc", handleInvalid="skip").fit(data)
        if cfg.balanced:
            fit = with_class_weights(fit, cfg.label)
        est = estimator(cfg.algorithm, cfg.task, len(indexer.labels), cfg.params, "weight__w" if cfg.balanced else None)
        model = Pipeline(stages=[indexer, *stages, est]).fit(fit)
        pred = model.transform(test)
        return model, classification_metrics(pred, cfg, len(indexer.labels)), pred
    fit, test = (x.withColumn("label__x", F.col(cfg.label).cast("double")) for x in (fit, test))
    model = Pipeline(stages=[*stages, estimator(cfg.algorithm, cfg.task, 0, cfg.params)]).fit(fit)
    pred = model.transform(test)
    return model, regression_metrics(pred, cfg, spark), pred


def classification_metrics(pred: DataFrame, cfg: TrainingConfig, classes: int) -> DataFrame:
    """Accuracy and weighted precision/recall/F1 from the confusion counts; AUC for two classes."""
    m = metrics_from_confusion(confusion(pred))
    auc = F.lit(None).cast("double")
    if classes == 2 and "rawPrediction" in pred.columns:
        auc = F.lit(float(BinaryClassificationEvaluator(labelCol="label__x").evaluate(pred)))
    return m.withColumn("auc", auc).withColumns({"purpose": F.lit(cfg.purpose), "algorithm": F.lit(cfg.algorithm)})


def confusion(pred: DataFrame, label: str = "label__x", guess: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).alias("actual"), F.col(guess).alias("predicted")).agg(F.count("*").alias("n"))


def metrics_from_confusion(c: DataFrame) -> DataFrame:
    """AGG-52 (classification): at most classes squared rows are left after the first count."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = c.groupBy(F.col("actual").alias("k")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    cols = c.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("guessed"))
    j = rows.join(cols, "k", "left").na.fill(0)
    p = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0)
    r = F.col("tp") / F.col("support")
    j = j.withColumns({"p": p, "r": r}).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    w = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    return j.agg(F.sum("support").alias("n_test"), (F.sum("tp") / F.sum("support")).alias("accuracy"), w("p").alias("precision"), w("r").alias("recall"), w("f").alias("f1_score"))


def regression_metrics(pred: DataFrame, cfg: TrainingConfig, spark: SparkSession | None = None) -> DataFrame:
    y, g = F.col("label__x"), F.col("prediction")
    err = y - g
    return pred.agg(F.count("*").alias("n_test"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                    (1 - F.sum(err * err) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2_score")).withColumns({"purpose": F.lit(cfg.purpose), "algorithm": F.lit(cfg.algorithm)})


def labels_of(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, StringIndexerModel) and s.getOrDefault("outputCol") == "label__x").labels


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """ML-4: class, confidence and the probability per class. Models without probabilities give a soft share of raw scores."""
    labels = labels_of(model)
    stages = [s for s in model.stages if not (isinstance(s, StringIndexerModel) and s.getOrDefault("outputCol") == "label__x")]
    out = PipelineModel(stages).transform(df)
    if "probability" in out.columns:
        probs = vector_to_array("probability")
    elif "rawPrediction" in out.columns:
        raw = F.transform(vector_to_array("rawPrediction"), lambda x: F.exp(x))
        probs = F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda s, y: s + y))
    else:
        probs = F.array(*[(F.col("prediction") == i).cast("double") for i in range(len(labels))])
    named = IndexToString(inputCol="prediction", outputCol="predicted_class", labels=labels).transform(out.withColumn("_p", probs))
    return named.withColumns({"probabilities": F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.col("_p")), "confidence": F.array_max("_p")}).drop("_p")


def feature_importance(model: PipelineModel, columns, k: int = 10) -> DataFrame | None:
    """SRT-9: importances by feature name, top k. Numeric columns only map one to one; encoded texts keep their slot number."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return None
    imp = last.featureImportances.toArray()
    names = list(columns) + [f"encoded_{i}" for i in range(len(imp) - len(columns))]
    spark = SparkSession.getActiveSession()
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def explain_predictions(scored: DataFrame, importance: DataFrame, columns, k: int = 5) -> DataFrame:
    """ML-15: per row the k largest importance x value, by unpivoting the features and joining the importances."""
    from .ranking import top_per_key

    long = scored.unpivot(["id"], list(columns), "feature", "value").join(importance, "feature")
    long = long.withColumn("contribution", F.col("importance") * F.col("value"))
    return top_per_key(long, ["id"], [F.desc("contribution"), F.col("feature")], k)


def tune(df: DataFrame, columns, cfg: TrainingConfig, grid: dict, folds: int = 3, samples: int | None = None, parallelism: int = 2) -> DataFrame:
    """ML-5: grid or sampled search with cross-validation; one row per setting."""
    data = df.where(F.col(cfg.label).isNotNull()).select("id", cfg.label, *columns)
    indexer = StringIndexer(inputCol=cfg.label, outputCol="label__x", stringOrderType="alphabetAsc", handleInvalid="skip").fit(data)
    est = estimator(cfg.algorithm, cfg.task, len(indexer.labels), cfg.params)
    maps = ParamGridBuilder()
    for k, v in grid.items():
        maps = maps.addGrid(est.getParam(k), v)
    maps = maps.build()
    if samples is not None and samples < len(maps):
        step = len(maps) / samples
        maps = [maps[int(i * step)] for i in range(samples)]
    pipe = Pipeline(stages=[indexer, *preprocessor(data, columns), est])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(labelCol="label__x", metricName="f1"), numFolds=folds, parallelism=parallelism, seed=42).fit(data)
    rows = [(str({p.name: v for p, v in m.items()}), float(s), bool(s == max(cv.avgMetrics))) for m, s in zip(maps, cv.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "params string, f1 double, best boolean")


def soft_vote(models: list[PipelineModel], df: DataFrame) -> DataFrame:
    """ML-8: mean probability over models, aligned by class name."""
    labels = sorted(set(itertools.chain(*[labels_of(m) for m in models])))
    out = df
    for i, m in enumerate(models):
        p = predict(m, df).select("id", F.col("probabilities").alias(f"p{i}"))
        out = out.join(p, "id")
    mean = F.array(*[sum((F.coalesce(F.col(f"p{i}")[lab], F.lit(0.0)) for i in range(len(models))), F.lit(0.0)) / len(models) for lab in labels])
    best = F.array_max(mean)
    return out.withColumns({"confidence": best, "predicted_class": F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(mean, best).cast("int"))}).drop(*[f"p{i}" for i in range(len(models))])


# Fixed weights and class scores of the three-classifier ensemble.
ENSEMBLE_WEIGHTS = {"priority": 0.4, "quality": 0.3, "conversion": 0.3}
CLASS_SCORES = {"low": 0.2, "medium": 0.6, "high": 1.0}


def three_way(predictions: dict[str, DataFrame]) -> DataFrame:
    """ML-9: class scores weighted per classifier, bands at .8 and .5, lowest confidence."""
    out = None
    for name, p in predictions.items():
        score = F.lit(0.5)
        for k, v in CLASS_SCORES.items():
            score = F.when(F.col("predicted_class") == k, v).otherwise(score)
        side = p.select("id", (score * ENSEMBLE_WEIGHTS[name]).alias(f"s_{name}"), F.col("confidence").alias(f"c_{name}"))
        out = side if out is None else out.join(side, "id")
    total = sum((F.col(f"s_{n}") for n in predictions), F.lit(0.0))
    r = F.round(total, 6)
    return out.select("id", r.alias("ensemble_score"), F.when(r >= 0.8, "high").when(r >= 0.5, "medium").otherwise("low").alias("ensemble_prediction"),
                      F.least(*[F.col(f"c_{n}") for n in predictions]).alias("confidence") if len(predictions) > 1 else F.col(f"c_{next(iter(predictions))}").alias("confidence"))


def save_model(model: PipelineModel, path: str, metadata: DataFrame, registry_path: str) -> None:
    """ML-14: the pipeline plus one appended registry row."""
    model.write().overwrite().save(path)
    metadata.withColumn("path", F.lit(path)).write.mode("append").parquet(registry_path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def evaluate(model: PipelineModel, df: DataFrame, cfg: TrainingConfig) -> DataFrame:
    """ML-13."""
    pred = model.transform(df)
    if cfg.task == "classification":
        return classification_metrics(pred, cfg, len(labels_of(model)))
    return regression_metrics(pred.withColumn("label__x", F.col(cfg.label).cast("double")), cfg)


def regression_scores(pred: DataFrame) -> dict:
    return {m: RegressionEvaluator(labelCol="label__x", metricName=m).evaluate(pred) for m in ("mae", "rmse", "r2")}
