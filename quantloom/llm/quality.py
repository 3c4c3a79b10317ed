"""Quality classifier by co-training.

Two views of a document are scored apart: its text (hashed byte pairs and counts over the whole text) and its page metadata
(language, source, length). Each view's model is a linear discriminant: it needs only class counts, sums and products of the
features, which every task adds up over its rows, so all documents take part at any size. Over a few rounds each view labels
the unlabelled documents that it is sure of for the other view, all of them; the two final models are calibrated on one
held-out fold of the labels, and a logistic model fitted on another combines the calibrated views. Labels used: MAX_LABELLED
at most, those first in hash order (documents of further labels count as unlabelled). Scoring is one pass over all documents,
whole texts, that carries only the models' coefficients.

Defined results: null text counts as empty, null metadata as a value of its own; where labels hold fewer than two classes
nothing can be learned and all documents are accepted with the score null; where a held-out fold holds one class, margins stay
as they are and count alike; repeated rows all stay; an empty table gives no rows; columns other than doc_id, text, lang,
source and n_chars are left alone.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from quantloom.llm.common import checkpoint, read, shared_dir

MAX_LABELLED = 20_000
ROUNDS, SURE, THRESHOLD = 2, 0.97, 0.5
PAIRS, LANGS, SOURCES = 128, 16, 32
#: Folds of the labels; the first is for calibration, the second for the combination.
FOLDS, RIDGE = 5, 1e-3
#: Tasks that add up the sums of all others.
ADDERS = 32
_KINDS = np.zeros(256, dtype=np.int64)
for _kind, _of in enumerate((b" ", b"\n", bytes(range(48, 58)), bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)))):
    _KINDS[list(_of)] = _kind + 1


def text_view(text: str | None) -> np.ndarray:
    """Shares of hashed byte pairs and of character classes, log counts, and how far words and lines repeat."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(PAIRS + 13)
    if not len(b):
        return out
    if len(b) > 1:
        pairs = ((b[:-1] * 257 + b[1:]) * 40503 >> 8) % PAIRS
        out[:PAIRS] = np.bincount(pairs, minlength=PAIRS) / len(pairs)
    out[PAIRS : PAIRS + 7] = np.bincount(_KINDS[b], minlength=7) / len(b)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(len(words), 1)
    distinct = len(set(words))
    out[PAIRS + 7 :] = math.log1p(n), len(raw) / n / 10, distinct / n, math.log1p(distinct) / math.log1p(n), len(set(lines)) / len(lines), math.log1p(len(lines))
    return out


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANGS + SOURCES + 2)
    out[zlib.crc32((lang or "").encode()) % LANGS] = 1
    out[LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[-2:] = (0, 1) if n_chars is None else (math.log1p(max(n_chars, 0)) / 10, 0)
    return out


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


@dataclass(frozen=True)
class Model:
    """Both views, their calibration, and what combines them."""

    text: Linear
    metadata: Linear
    text_calibration: Linear
    metadata_calibration: Linear
    combined: Linear

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_calibration.margin(self.text.margin(text)[:, None])
        b = self.metadata_calibration.margin(self.metadata.margin(metadata)[:, None])
        c = self.combined.margin(np.stack([a, b], axis=1))
        return tuple(1 / (1 + np.exp(-np.clip(m, -700, 700))) for m in (a, b, c))


def _meta_columns(docs: DataFrame) -> list:
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.stack([text_view(t.as_py()) for t in batch.column("text")])
    meta = np.stack([metadata_view(*m) for m in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))])
    return text, meta


def vectors(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """text, meta (views as 32-bit floats), quality and fold (null: unlabelled) of every document, written once. Folds are dealt
    within each class, those for fitting first."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # so few that they can be broadcast
    turn = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1
    known = checkpoint(known.select("doc_id", "quality", (F.lit(FOLDS - 1) - turn % FOLDS).cast("int").alias("fold")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = [[x.tobytes() for x in v.astype("<f4")] for v in _views(b)]
                yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.binary()) for r in rows), b.column("quality"), b.column("fold")], names=["text", "meta", "quality", "fold"])

    path = f"{shared_dir(docs.sparkSession)}/views-{uuid.uuid4().hex}"
    met = docs.select("doc_id", "text", *_meta_columns(docs)).join(F.broadcast(known), "doc_id", "left")
    met.mapInArrow(run, "text binary, meta binary, quality double, fold int").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1).astype(np.float64)


def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Counts and sums of each class, and products, of the rows whose label y is known (not NaN), as one array."""
    parts = [x[y == 0], x[y == 1]]
    return np.concatenate([[len(p) for p in parts], *(p.sum(axis=0) for p in parts), sum(p.T @ p for p in parts).ravel()])


def discriminant(total: np.ndarray, ridge: float = RIDGE) -> Linear | None:
    """The linear discriminant of such sums: its margin is the log odds of two normal classes of one covariance."""
    d = math.isqrt(len(total) - 1) - 1  # 2 + 2 d + d * d of them
    n, s, products = total[:2], total[2 : 2 + 2 * d].reshape(2, d), total[2 + 2 * d :].reshape(d, d)
    if not n.all():
        return None
    m = s / n[:, None]
    within = (products - (m * n[:, None]).T @ m) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(within), 0))
    scale[scale < 1e-9] = 1
    w = np.linalg.solve(within / np.outer(scale, scale) + ridge * np.eye(d), (m[1] - m[0]) / scale) / scale
    return Linear(w, float(math.log(n[1] / n[0]) - w @ (m[1] + m[0]) / 2))


def told(text: np.ndarray, meta: np.ndarray, quality: np.ndarray, fold: np.ndarray, models: tuple[Linear, Linear] | None, edge: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels that the text view and the metadata view are fitted on: those given, and where there is none, what the other view
    is sure of."""
    given = np.where(fold >= 2, quality, np.nan)
    if models is None:
        return given, given
    free, out = np.isnan(quality), []
    for other in (models[1].margin(meta), models[0].margin(text)):
        out.append(np.where(free & (np.abs(other) > edge), other > 0, given))
    return tuple(out)


def _fit_views(v: DataFrame, models: tuple[Linear, Linear] | None, edge: float) -> tuple[Linear | None, Linear | None]:
    """Both views' models from one pass: every task adds up its rows, a few tasks add up the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                text, meta = _matrix(b.column("text")), _matrix(b.column("meta"))
                quality, fold = (np.array(b.column(c).to_pylist(), dtype=float) for c in ("quality", "fold"))
                got = [sums(x, y) for x, y in zip((text, meta), told(text, meta, quality, fold, models, edge))]
                total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "text": total[0].tobytes(), "meta": total[1].tobytes()}])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for r in b.to_pylist():
                got = [np.frombuffer(r[c]) for c in ("text", "meta")]
                total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_pylist([{"text": total[0].tobytes(), "meta": total[1].tobytes()}])

    parts = v.mapInArrow(run, "part long, text binary, meta binary").repartition(ADDERS, "part")
    rows = parts.select("text", "meta").mapInArrow(add, "text binary, meta binary").collect()  # ADDERS at most
    return tuple(discriminant(sum(np.frombuffer(r[c]) for r in rows)) if rows else None for c in ("text", "meta"))


def _logistic(rows: DataFrame, features: str) -> Linear:
    """A logistic model of few features, or their plain mean where rows hold one class."""
    n = len(rows.select(features).head()[0]) if not rows.isEmpty() else 1
    if rows.select("quality").distinct().count() < 2:
        return Linear(np.full(n, 1 / n), 0.0)
    m = LogisticRegression(featuresCol="x", labelCol="quality", maxIter=40, regParam=1e-4).fit(rows.select(array_to_vector(features).alias("x"), "quality"))
    return Linear(np.array(m.coefficients.toArray()), float(m.intercept))


def _margin(model: Linear, features: str):
    return F.aggregate(F.zip_with(features, F.array(*[F.lit(float(w)) for w in model.weights]), lambda x, w: x * w), F.lit(float(model.bias)), lambda s, x: s + x)


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE, **bounds) -> Model | None:
    """Co-train over all documents, then calibrate and combine on the first two folds of the labels."""
    v, edge, models = vectors(docs, labels, **bounds), math.log(sure / (1 - sure)), None
    for _ in range(rounds + 1):
        models = _fit_views(v, models, edge)
        if None in models:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                both = [pa.array(list(m.margin(_matrix(b.column(c)))[:, None]), pa.list_(pa.float64())) for m, c in zip(models, ("text", "meta"))]
                yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("fold"), *both], names=["quality", "fold", "a", "b"])

    held = v.filter("quality is not null and fold < 2").mapInArrow(run, "quality double, fold int, a array<double>, b array<double>")
    held = checkpoint(held.repartition(1))  # part of at most max_labelled rows
    first, second = held.filter("fold = 0"), held.filter("fold = 1")
    a, b = _logistic(first, "a"), _logistic(first, "b")
    both = second.select("quality", F.array(_margin(a, "a"), _margin(b, "b")).alias("c"))
    return Model(*models, a, b, _logistic(both, "c") if not both.isEmpty() else Linear(np.full(2, 0.5), 0.0))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, metadata_score, quality_score (calibrated chances of good quality), accepted of every document."""
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("text_score"), none.alias("metadata_score"), none.alias("quality_score"), F.lit(True).alias("accepted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = model.scores(*_views(b))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, got), pa.array(got[2] >= threshold)], names=["doc_id", "text_score", "metadata_score", "quality_score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *_meta_columns(docs)).mapInArrow(run, f"doc_id {kind}, text_score double, metadata_score double, quality_score double, accepted boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The accepted documents, with all their columns, in one pass."""
    model = train(docs, labels, **how)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                view = pa.RecordBatch.from_arrays([b.column("text")] + [b.column(c) if c in names else pa.nulls(b.num_rows) for c in ("lang", "source", "n_chars")], names=["text", "lang", "source", "n_chars"])
                yield b.filter(pa.array(model.scores(*_views(view))[2] >= threshold))

    names = set(docs.columns)
    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
