"""Quality classifier: random-indexing word vectors pooled per text, a two-layer network, calibrated by a temperature."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import free_name, whole_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall
#: Stand-ins for words outside the vocabulary: by shape, for the first time in a text and again.
SHAPES = ["low", "title", "upper", "mixed", "digit", "mark"]
DIM, NONZERO, REACH, HIDDEN = 48, 4, 2, 16
#: Bounds of what is fitted on: labelled rows and the characters of all of them; and of the vocabulary.
SAMPLE, SAMPLE_CHARS, WORDS = 4000, 32_000_000, 20_000


def shape(token: str) -> int:
    if token.isalpha():
        return 0 if token.islower() else 2 if token.isupper() and len(token) > 1 else 1 if token.istitle() else 3
    return 4 if token.isdigit() else 5


def index_vector(word: str) -> np.ndarray:
    """The word's own sparse vector of +1 and -1, from its hash alone."""
    v = np.zeros(DIM, dtype=np.float32)
    for k in range(NONZERO):
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), k)
        v[h % DIM] += 1 if h >> 63 else -1
    return v


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Random indexing over ``texts``: a word's vector is the sum of its neighbours' index vectors, up to REACH words away.

    Words that occur twice or more, the WORDS most frequent of them, have a row of their own; then come the stand-ins.
    """
    counts = Counter(t for text in texts for t in TOKENS(text))
    words = sorted((w for w, c in counts.items() if c > 1), key=lambda w: (-counts[w], w))[:WORDS]
    ids = {w: i for i, w in enumerate(words)}
    names = words + [f"<{s}>" for s in SHAPES] + [f"<{s} again>" for s in SHAPES]
    own = np.stack([index_vector(w) for w in names])
    sums = np.zeros_like(own)
    for text in texts:
        at = np.array([ids[t] if t in ids else len(words) + shape(t) for t in TOKENS(text)], dtype=np.int64)
        for k in range(1, REACH + 1):
            if len(at) > k:
                np.add.at(sums, at[:-k], own[at[k:]])
                np.add.at(sums, at[k:], own[at[:-k]])
    sums[len(words) + len(SHAPES) :] = own[len(words) + len(SHAPES) :]
    return ids, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def pooled(text: str, ids: dict[str, int], vectors: np.ndarray) -> np.ndarray:
    """The mean of the vectors of all tokens of a text; zeros for a text without tokens."""
    n = len(ids)
    rows, weights = [], []
    for token, c in Counter(TOKENS(text)).items():
        i = ids.get(token)
        if i is not None:
            rows.append(i)
            weights.append(c)
        else:
            s = n + shape(token)
            rows += (s, s + len(SHAPES))
            weights += (1, c - 1)
    if not rows:
        return np.zeros(vectors.shape[1], dtype=np.float64)
    w = np.array(weights, dtype=np.float32)
    return (w @ vectors[rows]).astype(np.float64) / float(w.sum())


def _forward(x: np.ndarray, net: dict) -> np.ndarray:
    return np.tanh((x - net["mean"]) / net["std"] @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 500, rate: float = 0.02, decay: float = 1e-3) -> dict:
    """Two layers by full-batch Adam on the log loss; everything is seeded."""
    rng = np.random.default_rng(7)
    net = {"mean": x.mean(0), "std": x.std(0) + 1e-6}
    z = (x - net["mean"]) / net["std"]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y) / len(y)
        back = np.outer(d, p[2]) * (1 - h * h)
        grads = [z.T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], d.sum()]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net | dict(zip(("w1", "b1", "w2", "b2"), p, strict=True))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid from 1/4 to 8."""
    def loss(t: float) -> float:
        z = logits / t
        return float(np.mean(np.logaddexp(0, z) - y * z))

    return min(np.exp(np.linspace(np.log(0.25), np.log(8), 121)).tolist(), key=loss)


def fit(texts: list[str], labels: list[int]) -> dict:
    """The model of a bounded list of labelled texts; every fifth text only sets the temperature.

    Without both labels the score is the share of label 1 (a half without any row).
    """
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    ids, vectors = word_vectors(texts)
    x = np.stack([pooled(t, ids, vectors) for t in texts])
    aside = np.arange(len(y)) % 5 == 4
    net = _train(x[~aside], y[~aside]) if 0 < y[~aside].sum() < (~aside).sum() else _train(x, y)
    held = aside if aside.any() else ~aside
    return {"ids": ids, "vectors": vectors.astype(np.float32), "net": net, "temperature": _temperature(_forward(x[held], net), y[held])}


def score(text: str, model: dict) -> float:
    if "constant" in model:
        return model["constant"]
    logit = float(_forward(pooled(text, model["ids"], model["vectors"]), model["net"])) / model["temperature"]
    return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 on division by 3. A null id counts as ''."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list:
    """About ``sample`` labelled rows (text, quality) outside the held-out part, or all if there are fewer.

    Ids are chosen from the labels alone, by their hash, at the rate that gives ``sample`` of them, whatever their texts; only
    the texts of chosen ids are read out, one of each. Ids with two different labels and labels other than 0 and 1 are left
    out. Texts are taken in the order of the hash up to ``chars`` characters in all, which bounds the fit on the driver; a
    text that does not fit in what is left ends the sample, and one over ``chars`` by itself is passed over.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").alias("_key")).agg(F.min("quality").alias("y"), F.max("quality").alias("most")).where("y = most")
    share = min(1.0, sample / max(1, known.count()))
    chosen = cut_lineage(known.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < int(share * (1 << 20))).select("_key", "y"))
    # Some ``sample`` rows of an id and a label, so their size is bounded.
    rows = docs.select(F.col(doc_id).alias("_id"), whole_text(text).alias("x")).join(F.broadcast(chosen), F.col("_id") == F.col("_key"))
    rows = cut_lineage(rows.groupBy("_id").agg(F.min("x").alias("x"), F.min("y").alias("y")))
    # One length for each chosen id goes through the window.
    total = F.sum("n").over(Window.orderBy(F.xxhash64("_id"), "_id"))
    taken = rows.select("_id", F.length("x").cast("long").alias("n")).where(F.col("n") <= chars).withColumn("total", total).where(F.col("total") <= chars).select("_id")
    return rows.join(F.broadcast(taken), "_id").orderBy(F.xxhash64("_id"), "_id").collect()


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    rows = training_rows(docs, labels, doc_id, text, sample)
    return fit([r.x for r in rows], [int(r.y) for r in rows])


def scorer(spark: SparkSession, model: dict):
    """A column function: text -> score. The model is bounded (WORDS rows of DIM floats, about 6 MB) and broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([score(t, m) for t in texts], dtype="float64")

    # Not pure to the planner, so that a filter on the score does not compute it twice.
    return F.pandas_udf(scores, "double").asNondeterministic()


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5).

    Scores come from the whole text alone. Null and empty texts have the score of a text without words; repeated rows are
    scored each; an empty table gives no rows; without usable labels every score is the share of label 1, or a half; other
    columns of ``docs`` are not read.
    """
    model = train(docs, labels, doc_id, text, sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), scorer(docs.sparkSession, model)(whole_text(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def only_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` predicted as label 1, all columns as they were; the model is fitted on these rows' labels."""
    name = free_name(docs, "_score")
    return docs.withColumn(name, scorer(docs.sparkSession, train(docs, labels, doc_id, text, sample))(whole_text(text))).where(F.col(name) >= 0.5).drop(name)
