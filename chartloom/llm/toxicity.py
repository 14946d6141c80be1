"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words' subwords: byte n-grams of 3 to 6 bytes, word borders included, folded to lower case and
hashed into buckets. Bucket embeddings are averaged over the bag and a linear softmax gives two classes; embeddings and
softmax are trained jointly in numpy. A misspelt word shares most n-grams with the word it comes from.

The fit takes a bounded sample of labelled rows (``train_rows``, ``train_bytes``) in one task and returns the weights,
whose size is fixed, so they are broadcast. As average and softmax are linear, a bucket acts on a score through one
number, its margin; scoring looks margins up and averages them.

Defined cases: null and empty texts, and texts without words, get the score of the bias alone; null labels are left out;
repeated rows are scored alike; an empty table gives no rows; without labelled rows of both classes every score is the
share of the class that is there (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import arrays as A
from chartloom.llm.labelled import held_out, labelled_sample

BUCKETS, WIDTH, SCALE = 1 << 18, 8, 64.0
WORD_REPEATS = 4  # occurrences of a word that count, as term weights are damped elsewhere
PRIOR = 100  # neutral subwords that every bag holds besides its own, so a few words alone decide nothing
GRAMS = (3, 4, 5, 6)
TRAIN_ROWS, TRAIN_BYTES = 12000, 48 << 20
STEPS, EPOCHS, BATCH, RATE, MIN_DOCS = 1000, 8, 64, 0.3, 8

# Lower case for ASCII; white space and sentence punctuation become the border byte, a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[0x20, *range(0x09, 0x0E), *b".,;:!?\"'()[]{}|#$%&*<>/\\"]] = 0x20


def subwords(s: A.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of each row's words, and the row it belongs to."""
    n, rows = len(s.buf), s.rows
    folded = _FOLD[s.buf]
    starts, ends, first = A.words(A.Slice(0, rows, folded, s.off))
    row = A.row_of(first)
    h = A.SpanHash(folded)(starts, ends)
    few = A.occurrence(A.mix(h + row.astype(A.U64) * A.U64(0x9E3779B97F4A7C15))) < WORD_REPEATS
    starts, ends, row = starts[few], ends[few], row[few]
    size = ends - starts + 1  # with the border before it
    head = np.cumsum(size) - size
    n = int(size.sum())
    at = np.arange(n) + np.repeat(starts - 1 - head, size)
    b = np.append(folded[np.maximum(at, 0)], 0x20).astype(np.uint64)
    b[head] = 0x20
    owner = np.repeat(row, size)
    word = np.append(np.repeat(np.arange(len(size)), size), len(size))
    made, rows_of = [], []
    for k in GRAMS:
        m = len(b) - k + 1
        if m <= 0:
            continue
        # inside one word, its border before it and the next one's after it
        at = np.flatnonzero(word[:m] == word[k - 2 : k - 2 + m])
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = (h + b[at + j]) * np.uint64(0x100000001B3)
        same_end = (word[at] == word[at + k - 1]) | (b[at + k - 1] == 0x20)
        made.append((A.mix(h[same_end]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        rows_of.append(owner[at[same_end]])
    if not made:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(made), np.concatenate(rows_of)


class Bags:
    """Training texts as bags: bucket and weight (share of the bag) per entry, entries of a text together."""

    def __init__(self):
        self.bucket, self.weight, self.size, self.label = [], [], [], []

    def add(self, s: A.Slice, labels: np.ndarray) -> None:
        bucket, row = subwords(s)
        key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
        total = np.bincount(row, minlength=s.rows)
        row = key // BUCKETS
        self.bucket.append((key % BUCKETS).astype(np.int32))
        self.weight.append((count / (total + PRIOR)[row]).astype(np.float32))
        self.size.append(np.bincount(row, minlength=s.rows))
        self.label.append(labels)


def train(bags: Bags, steps: int = STEPS, seed: int = 5) -> tuple[np.ndarray, float]:
    """(margin per bucket, bias) of the positive class after joint training with per-weight step sizes."""
    label = np.concatenate(bags.label) if bags.label else np.zeros(0)
    if len(np.unique(label)) < 2:
        share = float(label.mean()) if len(label) else 0.5
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    epochs = max(EPOCHS, -(-steps * BATCH // len(label)))
    bucket, weight, size = np.concatenate(bags.bucket), np.concatenate(bags.weight), np.concatenate(bags.size)
    # buckets of few texts would learn those texts by heart: they keep margin 0 but count in the average
    common = np.bincount(bucket, minlength=BUCKETS)[bucket] >= min(MIN_DOCS, len(label) // 8 + 1)
    row = np.repeat(np.arange(len(label)), size)[common]
    bucket, weight, size = bucket[common], weight[common], np.bincount(row, minlength=len(label))
    first = np.concatenate([[0], np.cumsum(size)])
    heavy = float(np.sqrt((label == 0).sum() / (label == 1).sum()))  # a rare class weighs more
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    w, bias = rng.normal(0, 0.5, WIDTH).astype(np.float32), 0.0  # class 1 minus class 0 of the softmax
    ge, gw, gb = np.full((BUCKETS, 1), 1e-8, np.float32), np.full(WIDTH, 1e-8, np.float32), 1e-8
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            docs = docs[size[docs] > 0]
            if not len(docs):
                continue
            n = size[docs]
            start = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(first[docs] - start, n)
            use, share = bucket[at], SCALE * weight[at]
            mean = np.add.reduceat(e[use] * share[:, None], start)
            p = 1 / (1 + np.exp(-(mean @ w + bias)))
            g = ((p - label[docs]) * np.where(label[docs] > 0, heavy, 1.0) / len(docs)).astype(np.float32)
            step_w, step_b = mean.T @ g, float(g.sum())
            pull = np.bincount(use, share * np.repeat(g, n), minlength=BUCKETS)
            ids = np.flatnonzero(pull)
            step_e = pull[ids, None].astype(np.float32) * w
            ge[ids] += (step_e**2).mean(1, keepdims=True)
            e[ids] -= rate * step_e / np.sqrt(ge[ids])
            gw += step_w**2
            w -= 0.1 * rate * step_w / np.sqrt(gw)
            gb += step_b**2
            bias -= 0.1 * rate * step_b / np.sqrt(gb)
    margin = np.zeros(BUCKETS, np.float32)
    used = np.unique(bucket)
    margin[used] = SCALE * (e[used] @ w)
    return margin, float(bias)


def fit(labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, float]:
    """Train in one task on a bounded sample (text, label) of one partition, up to about ``train_bytes`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, left = Bags(), train_bytes
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), np.float32)
            for s in A.slices(batch.column(0)):
                if left > 0:
                    left -= len(s.buf)
                    bags.add(s, label[s.lo : s.hi])
        margin, bias = train(bags)
        yield pa.RecordBatch.from_pydict({"margin": pa.array([margin.tobytes()], pa.binary()), "bias": [bias]})

    (found,) = labelled.mapInArrow(run, "margin binary, bias double").collect() or (None,)
    return (np.frombuffer(found.margin, np.float32), found.bias) if found else (np.zeros(BUCKETS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_column: str = "doc_id") -> DataFrame:
    """(id, score): the softmax's probability of label 1 for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MiB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, bias = shared.value
        for batch in batches:
            for s in A.slices(batch.column(1)):
                bucket, row = subwords(s)
                total = np.bincount(row, margin[bucket].astype(np.float64), minlength=s.rows)
                z = total / (np.bincount(row, minlength=s.rows) + PRIOR) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["id", "score"])

    ids = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text").alias("__text"))
    return ids.mapInArrow(run, f"id {ids.schema[0].dataType.simpleString()}, score double").withColumnRenamed("id", id_column)


def learn_and_score(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, threshold: float, id_column: str = "doc_id") -> DataFrame:
    """Fit on the labelled rows outside ``fold``, score every row: id, held_out, score, predicted."""
    taught = labels.filter(~held_out(F.col(f"`{id_column}`"), folds, fold))
    model = fit(labelled_sample(docs, taught, label, TRAIN_ROWS, id_column))
    return score(docs, model, id_column).select(
        id_column, held_out(F.col(f"`{id_column}`"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
