"""Toxicity: cumulative-link (proportional odds) regression over sparse word features.

P(severity <= k) = sigmoid(threshold[k] - w.x), one weight vector for all ordered thresholds. A feature is a word or
the first four or five letters of a word, present or absent, so a text of any length is scored alike. The labels only
say toxic or not; toxic training texts are graded 1..GRADES by how many distinct markers they hold (features that
labels tie to toxic texts), cut at the quantiles of the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.llm.words import by_bytes, texts_of
from isoline.session import cut, prepare

#: Most labelled rows that the model is fitted on; they bound the features as well.
SAMPLE_ROWS = 8_000
#: A feature is kept if it is in at least MIN_HOT toxic texts, LIFT times as often as in others, and tells apart well.
MIN_HOT, LIFT, MIN_GAIN = 4, 4.0, 15.0
GRADES = 3
SCORES = "doc_id long, severity int, expected_severity double, toxic_probability double, toxic boolean"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Feature numbers, shared weights and ascending thresholds."""

    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade 0..GRADES for each score."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def features_of(text: str | None) -> set[str]:
    """Distinct words of a whole text and their beginnings (marked with *)."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in (4, 5) if len(w) >= n}


def _ordinal(n: int, index: np.ndarray, row: np.ndarray, grade: np.ndarray, rows: int, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated gradient descent on the penalised likelihood; deterministic."""
    w, theta = np.zeros(n), np.linspace(1.0, 3.0, GRADES)
    vw, vt = np.zeros(n), np.zeros(GRADES)
    hit = np.arange(GRADES)[None, :] >= grade[:, None]  # is severity <= k
    share = np.maximum(np.bincount(grade, minlength=2)[1:].sum(), 1)
    # toxic rows weigh more, half way (geometrically) between their share and an even one
    weight = np.where(grade > 0, np.sqrt(max(rows - share, 1) / share), 1.0)
    rate = 2.0
    for _ in range(steps):
        score = np.bincount(row, w[index], minlength=rows)
        # every threshold is one logistic problem with the same weights
        gap = (_sigmoid(theta[None, :] - score[:, None]) - hit) * weight[:, None] / rows
        gw = -np.bincount(index, gap.sum(1)[row], minlength=n) + penalty * w
        gt = gap.sum(0)
        vw, vt = 0.9 * vw - rate * gw, 0.9 * vt - rate * gt
        w, theta = w + vw, np.sort(theta + vt)
    return w, theta


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic, text) of the labelled documents with the smallest hash of their doc_id, at most `rows` of them.

    A doc_id with several labels counts as toxic if one is, and with several texts by the smallest; a text that several
    ids share with one label counts once.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    picked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # bounded by `rows`
    return cut(found.groupBy("toxic", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic", "text"), "labelled")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_bytes(batches):
        toxic = b.column("toxic").to_pylist()
        found = [(f, t) for x, t in zip(texts_of(b), toxic, strict=True) for f in features_of(x)]
        yield pa.RecordBatch.from_pydict({"feature": pa.array([f for f, _ in found], pa.string()), "toxic": pa.array([t for _, t in found], pa.int32())})


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, penalty: float = 1e-4, steps: int = 800) -> Model:
    """Fit on at most sample_rows labelled documents, those with the smallest hash of their doc_id.

    Features are counted and chosen by Spark; the driver only gets the chosen ones and, per sampled document, the
    numbers of those that it holds. Rows without a text or a label are left out. Without any labelled row, or with one
    class only, the model finds nothing toxic.
    """
    prepare(docs.sparkSession)
    sample = _sample(docs, labels, sample_rows)
    size = {r.toxic > 0: r.n for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_hot, n_cold = size.get(True, 0), size.get(False, 0)
    if not n_hot or not n_cold:
        return Model({}, np.zeros(0), np.full(GRADES, 20.0))
    counts = sample.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).mapInArrow(_feature_rows, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("hot"), F.sum(1 - F.col("toxic")).alias("cold"))
    # how much better two rates explain a feature's counts than one rate does
    hot, cold, seen = F.col("hot").cast("double"), F.col("cold").cast("double"), (F.col("hot") + F.col("cold")) / (n_hot + n_cold)
    gain = 2 * (hot * F.log(hot / (n_hot * seen)) + F.when(cold > 0, cold * F.log(cold / (n_cold * seen))).otherwise(0.0))
    best = counts.where((F.col("hot") >= MIN_HOT) & (hot / n_hot > LIFT * cold / n_cold)).withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN)
    number = {f: i for i, f in enumerate(sorted(r.feature for r in best.select("feature").collect()))}
    markers = np.array([not f.endswith("*") for f in sorted(number)], bool)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            hits = [sorted(number[f] for f in features_of(x) if f in number) for x in texts_of(b)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "hits": pa.array([np.array(h, np.int32).tobytes() for h in hits], pa.binary())})

    rows = sorted(sample.mapInArrow(encode, "doc_id long, toxic int, hits binary").collect())
    held = [np.frombuffer(r.hits, np.int32) for r in rows]
    index = np.concatenate([np.zeros(0, np.int32), *held]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(h) for h in held])
    toxic = np.array([r.toxic > 0 for r in rows])
    marks = np.bincount(row, markers[index], minlength=len(rows))
    bounds = np.quantile(marks[toxic], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic, 1 + (marks[:, None] > bounds[None, :]).sum(1), 0)
    w, theta = _ordinal(len(number), index, row, grade, len(rows), penalty, steps)
    return Model(number, w, theta)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Severity grade, expected severity and verdict of every row, in one pass without a shuffle.

    A row is toxic if grade 0 is less likely than not. Null and empty texts have no features and score like any text
    without markers. Repeated ids each get a row; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weights = model.features, model.weights
        for b in by_bytes(batches):
            total = np.zeros(b.num_rows)
            for k, t in enumerate(texts_of(b)):
                hits = [number[f] for f in features_of(t) if f in number]
                total[k] = weights[sorted(hits)].sum() if hits else 0.0
            p = model.severity(total)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "severity": pa.array(p.argmax(1).astype(np.int32)), "expected_severity": pa.array(p @ np.arange(GRADES + 1)), "toxic_probability": pa.array(1 - p[:, 0]), "toxic": pa.array(p[:, 0] < 0.5)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORES)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns, in one pass without a shuffle.

    Every row is judged by its own text, as by score: repeated and null ids play no part, null and empty texts stay
    unless the model finds texts without any marker toxic.
    """
    prepare(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weights = model.features, model.weights
        for b in by_bytes(batches):
            keep = []
            for t in texts_of(b):
                hits = [number[f] for f in features_of(t) if f in number]
                total = weights[sorted(hits)].sum() if hits else 0.0
                keep.append(model.severity(np.array([total]))[0, 0] >= 0.5)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
