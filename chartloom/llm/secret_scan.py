"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query over the trigrams every match must hold. Per block of texts one pass
over the bytes fills the postings of just the trigrams that some rule needs; a rule's postings are intersected and
united, and its regex runs on the remaining candidates alone. A rule without mandatory trigrams scans every text. Index,
query and verification of a block stay in one task, so nothing is shuffled and the index never outgrows a block.

Defined cases: null text counts as empty and has no spans; spans of different kinds may overlap; repeated rows are
scanned alike; other columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import arrays as A


@dataclass(frozen=True)
class Rule:
    """``group``/``least``: a match counts if that group has at least so many bytes (all sets here are ASCII)."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0
    base: bool = False
    regex: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "regex", re.compile(self.pattern.encode(), re.I if self.any_case else 0))


#: A private key from its first line to the END line of the same name. Where that is missing or another block comes before
#: it: to the end of the lines of base64 (and of the headers of encrypted keys), also quoted, indented or with escaped breaks.
_KEY = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END \1PRIVATE KEY-----"
    r"|(?:(?:[\s>]|\\[nrt])++(?:(?:Proc-Type|DEK-Info):[^\n\\]*+|[A-Za-z0-9+/]{16,}+={0,2}+|[A-Za-z0-9+/]++={0,2}+(?=[^\S\n]*+(?:\n|\\[nr]|\Z))))*+)"
)
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]+", least=32, base=True),
    Rule("key_block", _KEY),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"authorization: bearer [a-z0-9._~+/-]{16,}", True),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{4,128}@[a-z0-9]", True),
)

Query = list[list[frozenset[int]]]  # and of ors of ands of trigrams


def _code(three: str) -> int:
    a, b, c = three.encode()
    return a << 16 | b << 8 | c


def _strings(items, limit: int = 32) -> set[str] | None:
    """All strings a piece of a parsed regex can match, lower-cased, if they are few."""
    made = {""}
    for op, arg in items:
        if op is C.LITERAL:
            part = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            part = _strings(arg[3], limit)
        elif op is C.BRANCH:
            parts = [_strings(x, limit) for x in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and arg[1] <= 3:
            once = _strings(arg[2], limit)
            part = None if once is None else {"".join(t) for n in range(arg[0], arg[1] + 1) for t in _products(once, n)}
        else:
            part = None
        if part is None or len(part) * len(made) > limit:
            return None
        made = {a + b for a in made for b in part}
    return made


def _products(once: set[str], n: int) -> list[tuple[str, ...]]:
    made: list[tuple[str, ...]] = [()]
    for _ in range(n):
        made = [(*a, b) for a in made for b in once]
    return made


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of every match holds; an empty list if nothing is mandatory."""
    found: Query = []

    def close(run: set[str]) -> None:
        if all(len(x) >= 3 for x in run):
            found.append([frozenset(_code(x[i : i + 3]) for i in range(len(x) - 2)) for x in sorted(run)])

    def walk(items) -> None:
        run = {""}
        for item in items:
            one = _strings([item])
            if one is not None and len(one) * len(run) <= 32:
                run = {a + b for a in run for b in one}
                continue
            close(run)
            run = one or {""}
            op, arg = item
            if one is None and op is C.SUBPATTERN:
                walk(arg[3])
            elif one is None and op is C.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        close(run)

    walk(_parser.parse(pattern))
    return found


class Postings:
    """Rows of one slice by trigram, for the wanted trigrams only."""

    def __init__(self, wanted: list[int]):
        self.wanted = wanted
        self.slot = np.zeros(1 << 24, np.uint16)
        self.slot[wanted] = np.arange(1, len(wanted) + 1)
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[ord("A") : ord("Z") + 1] += 32

    def fill(self, s: A.Slice) -> dict[int, np.ndarray]:
        b = self.lower[s.buf]
        rows: dict[int, np.ndarray] = {}
        if len(b) >= 3:
            slot = self.slot[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            at = np.flatnonzero(slot)
            row = np.searchsorted(s.off, at, "right") - 1
            inside = at + 3 <= s.off[row + 1]
            key = np.unique(slot[at[inside]].astype(np.int64) * s.rows + row[inside])
            which, row = key // s.rows, key % s.rows
            cut = np.searchsorted(which, np.arange(1, len(self.wanted) + 2))
            rows = {t: row[cut[i] : cut[i + 1]] for i, t in enumerate(self.wanted)}
        return rows


_NONE = np.zeros(0, np.int64)


def candidates(query: Query, postings: dict[int, np.ndarray], rows: int) -> np.ndarray:
    """Rows that satisfy a query: postings intersected within a term, united over alternatives, intersected over all."""
    kept: np.ndarray | None = None
    for options in query:
        either = _NONE
        for term in options:
            both: np.ndarray | None = None
            for p in sorted((postings.get(t, _NONE) for t in term), key=len):
                both = p if both is None else np.intersect1d(both, p, assume_unique=True)
                if not len(both):
                    break
            either = np.union1d(either, both)
        kept = either if kept is None else np.intersect1d(kept, either, assume_unique=True)
        if not len(kept):
            break
    return np.arange(rows) if kept is None else kept


def find_spans(s: A.Slice, rules: tuple[Rule, ...], queries: list[Query], index: Postings) -> dict[int, list[tuple[int, int, int]]]:
    """By row: (start, rule, end) in bytes, sorted."""
    postings, found = index.fill(s), {}
    for k, (rule, query) in enumerate(zip(rules, queries)):
        for i in candidates(query, postings, s.rows):
            for m in rule.regex.finditer(s.buf[s.off[i] : s.off[i + 1]].tobytes()):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.setdefault(int(i), []).append((m.start(), k, m.end()))
    for spans in found.values():
        spans.sort()
    return found


_INDEX: dict[tuple[Rule, ...], tuple[list[Query], Postings]] = {}


def compiled(rules: tuple[Rule, ...]) -> tuple[list[Query], Postings]:
    """Queries and postings table of a rule set, made once per worker."""
    if rules not in _INDEX:
        queries = [trigram_query(r.pattern) for r in rules]
        _INDEX[rules] = queries, Postings(sorted({t for q in queries for o in q for term in o for t in term}))
    return _INDEX[rules]


def _points(s: A.Slice, i: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans of a row in code points."""
    before = np.concatenate([[0], np.cumsum((s.buf[s.off[i] : s.off[i + 1]] & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def scan(docs: DataFrame, id_column: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, kind_order, base, start, end) in code points by start and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, index = compiled(rules)
        for batch in batches:
            for s in A.slices(batch.column(1)):
                found = find_spans(s, rules, queries, index)
                spans = [[{"kind": rules[k].kind, "kind_order": k, "base": rules[k].base, "start": a, "end": b} for a, k, b in _points(s, i, found[i])] if i in found else [] for i in range(s.rows)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("kind_order", pa.int32()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(spans, kind)], names=["id", "spans"])

    ids = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text").alias("__text"))
    schema = f"id {ids.schema[0].dataType.simpleString()}, spans array<struct<kind:string,kind_order:int,base:boolean,start:bigint,end:bigint>>"
    return ids.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def digest_columns(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, shown), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        id_column, count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All documents and columns; every stretch of a text that spans cover becomes ``[SECRET]``, and ``n_chars``, where there
    is one, follows. Null texts stay null."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, index = compiled(rules)
        for batch in batches:
            text = batch.column(at)
            changed: dict[int, str] = {}
            for s in A.slices(text):
                for i, spans in find_spans(s, rules, queries, index).items():
                    raw, out, done = s.buf[s.off[i] : s.off[i + 1]].tobytes(), [], 0
                    for a, _, b in spans:
                        if a >= done:
                            out += [raw[done:a], b"[SECRET]"]
                        done = max(done, b)
                    changed[s.lo + i] = b"".join([*out, raw[done:]]).decode()
            if changed:
                values = text.to_pylist()
                for i, new in changed.items():
                    values[i] = new
                text = pa.array(values, text.type)
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    schema = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    made = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]).mapInArrow(run, schema).toDF(*names)
    if "n_chars" in names:
        made = made.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return made


