"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text becomes counts of hashed features: byte trigrams, four-character shapes (letters, capitals, digits, marks) and
repetition marks (a word equal to the one before it, a line or a three-word run seen before), all as damped frequencies.
A truncated singular value decomposition of a bounded labelled sample gives the latent space; sample vectors and labels
are broadcast (``SAMPLE_ROWS`` x ``RANK`` numbers, whatever the input). Every document is compared with all of them by
blocked matrix products, exact cosines, and its ``NEIGHBOURS`` nearest vote with weights that rise with similarity.

Defined cases: null and empty texts have the zero vector and score the share of label 1 in the sample; texts with no
similar neighbour likewise; null labels are left out; repeated rows score alike; an empty table gives no rows, and
without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import arrays as A
from chartloom.llm.labelled import held_out, labelled_sample

FEATURES, RANK = 4096, 48
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32 << 20
NEIGHBOURS, SHARPNESS = 15, 8.0
REPETITION = 3.0

# Shape classes: small letters (and every byte of a longer character), capitals, digits; marks and white space stay.
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_PLAIN = np.arange(256, dtype=np.uint64)
_HALF = FEATURES // 2
_MARKS = 3  # the last features of the table


def _grams(b: np.ndarray, row: np.ndarray, k: int, n: int, rows: int) -> np.ndarray:
    """Counts (rows x n) of hashed ``k``-grams that lie inside a row."""
    if len(b) < k:
        return np.zeros((rows, n), np.float32)
    m = len(b) - k + 1
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = (h + b[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (h >> np.uint64(32)).astype(np.int64) % n
    inside = row[:m] == row[k - 1 :]
    return np.bincount((row[:m] * n + bucket)[inside], minlength=rows * n).reshape(rows, n).astype(np.float32)


def features(s: A.Slice) -> np.ndarray:
    """Damped, length-normalised feature rows of a slice."""
    size = np.diff(s.off)
    row = np.repeat(np.arange(s.rows), size)
    x = np.empty((s.rows, FEATURES), np.float32)
    x[:, :_HALF] = _grams(_PLAIN[s.buf], row, 3, _HALF, s.rows)
    x[:, _HALF : FEATURES - _MARKS] = _grams(_SHAPE[s.buf], row, 4, FEATURES - _HALF - _MARKS, s.rows)
    x[:, -_MARKS:] = 0
    x = np.log1p(1000 * x / np.maximum(size, 1)[:, None])
    starts, ends, first = A.words(s)
    h = A.SpanHash(s.buf)(starts, ends)
    of = A.row_of(first)
    n = np.maximum(np.diff(first), 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    salt = of.astype(A.U64) * A.U64(0x9E3779B97F4A7C15)
    runs = np.zeros(len(h), bool)
    if len(h) >= 3:
        runs[: len(h) - 2] = A.repeats(A.mix(A.windows(h, 3) + salt[:-2]))[0] & (of[:-2] == of[2:])
    starts, ends, lines = A.lines(s)
    line_row = A.row_of(lines)
    same = A.repeats(A.mix(A.SpanHash(s.buf)(starts, ends) + line_row.astype(A.U64) * A.U64(0x9E3779B97F4A7C15)))[0] & (ends > starts)
    marks = [np.bincount(of[again], minlength=s.rows) / n, np.bincount(of[runs], minlength=s.rows) / n, np.bincount(line_row[same], minlength=s.rows) / np.maximum(np.diff(lines), 1)]
    norm = np.maximum(np.linalg.norm(x[:, : FEATURES - _MARKS], axis=1), 1e-6)
    for i, m in enumerate(marks):
        x[:, FEATURES - _MARKS + i] = REPETITION * np.sqrt(m) * norm
    x[size == 0] = 0
    return x


class Model:
    """Feature weights and axes of the latent space, the sample's unit vectors, labels and the share of label 1."""

    def __init__(self, weight: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.weight, self.axes, self.vectors, self.labels = weight, axes, vectors, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def embed(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weight) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def vote(self, z: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(z), self.prior)
        cosine = z @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = w.sum(1)
        return np.where(total > 1e-12, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)


def fit_model(x: np.ndarray, labels: np.ndarray) -> Model:
    if not len(labels):
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32), np.zeros((0, RANK), np.float32), labels)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    weighted = x * weight
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
    # leading right singular vectors by subspace iteration
    rank = min(RANK, len(x))
    basis = np.linalg.qr(np.random.default_rng(3).normal(size=(FEATURES, rank + min(16, len(x) - rank))).astype(np.float32))[0]
    for _ in range(5):
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    _, value, turn = np.linalg.svd(weighted @ basis, full_matrices=False)
    rank = max(1, min(rank, int((value > 1e-5).sum())))
    axes = np.ascontiguousarray(basis @ turn[:rank].T)
    model = Model(weight, axes, np.zeros((0, axes.shape[1]), np.float32), labels)
    model.vectors = model.embed(x)
    return model


def fit(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Model from a bounded sample (text, label) of one partition, up to about ``sample_bytes`` of text, embedded and
    decomposed in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, left = [], [], sample_bytes
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), np.float32)
            for s in A.slices(batch.column(0)):
                if left > 0:
                    left -= len(s.buf)
                    xs.append(features(s)), ys.append(label[s.lo : s.hi])
        m = fit_model(np.concatenate(xs) if xs else np.zeros((0, FEATURES), np.float32), np.concatenate(ys) if ys else np.zeros(0, np.float32))
        yield pa.RecordBatch.from_pydict({"rank": [m.axes.shape[1]], **{k: pa.array([getattr(m, k).astype(np.float32).tobytes()], pa.binary()) for k in ("weight", "axes", "vectors", "labels")}})

    (found,) = labelled.mapInArrow(run, "rank bigint, weight binary, axes binary, vectors binary, labels binary").collect() or (None,)
    if not found:
        return fit_model(np.zeros((0, FEATURES), np.float32), np.zeros(0, np.float32))
    back = lambda b: np.frombuffer(b, np.float32)
    return Model(back(found.weight), back(found.axes).reshape(-1, found.rank), back(found.vectors).reshape(-1, found.rank), back(found.labels))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """(id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # under 2 MiB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for s in A.slices(batch.column(1)):
                made = []
                for lo in range(0, s.rows, 512):  # a slice of very short texts has very many rows
                    part = s if s.rows <= 512 else s.take(np.arange(lo, min(lo + 512, s.rows)))
                    made.append(m.vote(m.embed(features(part))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(np.concatenate(made).astype(np.float64))], names=["id", "score"])

    ids = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text").alias("__text"))
    return ids.mapInArrow(run, f"id {ids.schema[0].dataType.simpleString()}, score double").withColumnRenamed("id", id_column)


def learn_and_score(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, threshold: float, id_column: str = "doc_id") -> DataFrame:
    """Fit on the labelled rows outside ``fold``, score every row: id, held_out, score, predicted."""
    taught = labels.filter(~held_out(F.col(f"`{id_column}`"), folds, fold))
    model = fit(labelled_sample(docs, taught, label, SAMPLE_ROWS, id_column))
    return score(docs, model, id_column).select(
        id_column, held_out(F.col(f"`{id_column}`"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
