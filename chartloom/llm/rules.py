"""Quality rules: a short-circuit cascade whose order is learned.

Base counts are taken of every document. Documents that pass the base rule then run through the cascade: each rule sees
only the documents that the rules before it let through. A sample gives each rule's cost and the share it rejects; rules
with the most rejections per second come first. The verdict is the conjunction, so the order changes time, never results.

Defined cases: null text counts as empty; an empty text has zero counts and fails the base rule; repeated rows are judged
alike, each on its own; other columns, whatever their names, are kept by ``filter_documents`` and ignored by ``judge``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import arrays as A

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
LOWER = np.zeros(256, bool)
LOWER[ord("a") : ord("z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"


def _share(s: A.Slice, table: np.ndarray) -> np.ndarray:
    return A.row_sums(table[s.buf], s.off)


# Each rule tells for every row of a slice whether it is rejected; ``n`` is the number of words.
@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[A.Slice, np.ndarray], np.ndarray]


RULES = (
    Rule("symbols", lambda s, n: 4 * _share(s, SYMBOL) > n),
    Rule("shouting", lambda s, n: (u := _share(s, UPPER)) > _share(s, LOWER) + u // 2),
    Rule("exclamations", lambda s, n: 3 * A.row_sums(s.buf == ord("!"), s.off) > n),
    Rule("digits", lambda s, n: 3 * _share(s, DIGIT) > np.diff(s.off)),
    Rule("repeated_lines", lambda s, n: _repeated_lines(s)),
    Rule("long_words", lambda s, n: np.diff(s.off) > 60 * np.maximum(n, 1)),
)


def _duplicate_lines(s: A.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, per row."""
    starts, ends, first = A.lines(s)
    solid = np.concatenate([[0], np.cumsum(~A.SPACE[s.buf])])
    full = solid[ends] > solid[starts]
    row = A.row_of(first)
    key = A.mix(A.SpanHash(s.buf)(starts[full], ends[full]) + row[full].astype(A.U64) * A.U64(0x9E3779B97F4A7C15))
    later, _ = A.repeats(key)
    return np.bincount(row[full], minlength=s.rows), np.bincount(row[full][later], minlength=s.rows)


def _repeated_lines(s: A.Slice) -> np.ndarray:
    full, later = _duplicate_lines(s)
    return (full >= 4) & (2 * later > full)


def base_counts(s: A.Slice) -> dict[str, np.ndarray]:
    """The base counts of every row of a slice."""
    starts, ends, first = A.words(s)
    solid = ~A.SPACE[s.buf]
    h = A.SpanHash(s.buf)(starts, ends)
    row = A.row_of(first)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        inside = np.flatnonzero(row[:-2] == row[2:])
        _, twice = A.repeats(A.mix(A.windows(h, 3)[inside] + row[inside].astype(A.U64) * A.U64(0x9E3779B97F4A7C15)))
        at = inside[twice]
        covered[at] = covered[at + 1] = covered[at + 2] = True
    n_words, repeat = np.diff(first), np.bincount(row[covered], minlength=s.rows)
    return {
        "n_words": n_words,
        "word_chars": A.row_sums(solid & ((s.buf & 0xC0) != 0x80), s.off),
        "n_symbols": _share(s, SYMBOL),
        "n_dup_lines": _duplicate_lines(s)[1],
        "n_repeat_words": repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words),
    }


def _cascade(s: A.Slice, n_words: np.ndarray, alive: np.ndarray, order: list[str]) -> np.ndarray:
    """Rows that every rule lets through; each rule only sees those still alive."""
    by_name = {r.name: r for r in RULES}
    alive = alive.copy()
    for name in order:
        rows = np.flatnonzero(alive)
        if not len(rows):
            break
        part = s if len(rows) == s.rows else s.take(rows)
        alive[rows[by_name[name].rejects(part, n_words[rows])]] = False
    return alive


def learn_order(docs: DataFrame, blocks: int = 8, fraction: float = 0.1, seed: int = 7) -> list[str]:
    """Rule names by falling rejections per second, measured on ``blocks`` slices of a random sample. Tasks start only until
    enough slices are measured and return times and counts alone; the sample's size bounds the cost of the estimate, and
    verdicts do not depend on it."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in A.slices(batch.column(0)):
                n = np.diff(A.words(s)[2])
                spent, hits = [], []
                for r in RULES:
                    began = time.perf_counter()
                    hits.append(int(r.rejects(s, n).sum()))
                    spent.append(time.perf_counter() - began)
                yield pa.RecordBatch.from_pydict({"rule": [r.name for r in RULES], "seconds": spent, "hits": hits})

    seconds, hits = dict.fromkeys((r.name for r in RULES), 1e-6), dict.fromkeys((r.name for r in RULES), 0.5)
    for r in docs.select("text").sample(False, fraction, seed).mapInArrow(measure, "rule string, seconds double, hits bigint").take(blocks * len(RULES)):
        seconds[r.rule] += r.seconds
        hits[r.rule] += r.hits
    return sorted(seconds, key=lambda x: (-hits[x] / seconds[x], x))


def judge(docs: DataFrame, keep: list[str], order: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with base counts and verdict."""
    order = order or learn_order(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in A.slices(batch.column(len(keep))):
                base = base_counts(s)
                base["kept"] = _cascade(s, base["n_words"], ~base["base_failed"], order)
                rest = batch.slice(s.lo, s.hi - s.lo).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(v) for v in base.values())], names=[*(f"k{i}" for i in range(len(keep))), *base])

    renamed = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("__text"))
    schema = "".join(f"k{i} {renamed.schema[i].dataType.simpleString()}, " for i in range(len(keep))) + BASE
    made = renamed.mapInArrow(run, schema)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[c.split()[0] for c in BASE.split(", ")])


def filter_documents(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The documents that pass, with all their columns and nothing else. Texts go to the rules and back in the same task."""
    order = order or learn_order(docs)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for s in A.slices(batch.column(at)):
                base = base_counts(s)
                kept[s.lo : s.hi] = _cascade(s, base["n_words"], ~base["base_failed"], order)
            yield batch.filter(pa.array(kept))

    return docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]).mapInArrow(
        run, ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    ).toDF(*names)
