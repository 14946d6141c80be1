"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

``lookahead`` derives from the merge list how far right a token can still depend on text to come. When a merge happens
at a place where, with less text, it would not, the tokens to its left can change only through a later rule whose right
part begins where the left part of the merge began. Chains of such rules bound the reach: with
g(i) = |left(i)| + max g(j) over j > i whose right part has left(i) on its left spine, the bound is max g. A token that ends
that many bytes before the end of what was read is final. ``encode_stream`` reads a stretch in windows, emits the final
tokens and carries the rest, so its state has a constant size whatever the length of the stretch.

Texts are cut where no merge crosses: before a space followed by a solid character, and by the tokenizer's own pattern.
The distinct stretches of a block are merged together in numpy; frequent pieces come from a bounded cache.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import arrays as A

NO_RANK = np.int32(2**31 - 1)
CACHE_PIECES = 300_000
CACHED_CHARS = 64
WINDOW = 1 << 16


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@dataclass
class Merges:
    """Merge rules as arrays. ``left``, ``right``, ``made``: token ids by rank; ``size``: bytes of each token."""

    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    size: np.ndarray
    spine: dict[int, int]  # token: its left part

    def lookahead(self) -> int:
        best: dict[int, int] = {}
        reach = 0
        for i in range(len(self.left) - 1, -1, -1):
            a, b = int(self.left[i]), int(self.right[i])
            g = int(self.size[a]) + best.get(a, 0)
            reach = max(reach, g)
            t: int | None = b
            while t is not None:
                if g > best.get(t, 0):
                    best[t] = g
                t = self.spine.get(t)
        return reach

    def __post_init__(self):
        keys = (self.left.astype(np.uint32) << np.uint32(16)) | self.right.astype(np.uint32)
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift = np.uint32(32 - bits)
        self.tables = []
        rest = np.arange(len(keys))
        for multiplier in (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F), np.uint32(0x165667B1), np.uint32(0xD3A2646D), np.uint32(0xFD7046C5), np.uint32(0xB55A4F09)):
            key, rank = np.zeros(1 << bits, np.uint32), np.full(1 << bits, NO_RANK, np.int32)
            slot = (keys[rest] * multiplier) >> self.shift
            _, first = np.unique(slot, return_index=True)
            key[slot[first]], rank[slot[first]] = keys[rest[first]], rest[first]
            self.tables.append((multiplier, key, rank, np.bincount(slot, minlength=1 << bits) > 1))
            rest = np.delete(rest, first)
            if not len(rest):
                break
        assert not len(rest), "merge table too dense"

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging token ``a`` with ``b``, or NO_RANK."""
        pair = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        out = np.full(len(pair), NO_RANK, np.int32)
        todo = None
        for multiplier, key, rank, crowded in self.tables:
            p = pair if todo is None else pair[todo]
            slot = (p * multiplier) >> self.shift
            hit = key[slot] == p
            found = np.where(hit, rank[slot], NO_RANK)
            more = np.flatnonzero(crowded[slot] & ~hit)
            if todo is None:
                out, todo = found, more
            else:
                out[todo], todo = found, todo[more]
            if not len(todo):
                break
        return out

    def merge(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many stretches at once. ``first``: index of each stretch's first symbol (stretches + 1, none empty)."""
        n = len(first) - 1
        word = np.arange(n)
        size = np.diff(first)
        sym = sym.astype(np.int32)
        done_word, done_size, done_sym = [], [], []
        rank = np.full(len(sym), NO_RANK, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = NO_RANK
        while len(word):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            over = low == NO_RANK
            if over.any():
                flat = np.repeat(over, size)
                done_word.append(word[over]), done_size.append(size[over]), done_sym.append(sym[flat])
                go = ~flat
                sym, rank, word, size, low = sym[go], rank[go], word[~over], size[~over], low[~over]
                if not len(word):
                    break
                start = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(low, size))
            if len(at) > 1:  # of touching places, as in a a a, every second one counts
                run = np.ones(len(at), bool)
                run[1:] = np.diff(at) != 1
                head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            sym[at] = self.made[rank[at]]
            end = rank[at + 1]  # what stood after the right part now stands after the merged token
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            which = np.searchsorted(start, at, "right") - 1
            size = size - np.bincount(which, minlength=len(size))
            rank[at] = end
            place = np.cumsum(keep) - 1
            sym, rank, at = sym[keep], rank[keep], place[at]
            last = np.zeros(len(sym), bool)
            last[np.cumsum(size) - 1] = True
            fresh = np.concatenate([at, at[at > 0] - 1])
            fresh = fresh[~last[fresh]]
            rank[at[last[at]]] = NO_RANK
            rank[fresh] = self.rank(sym[fresh], sym[fresh + 1])
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        word, size, sym = np.concatenate(done_word), np.concatenate(done_size), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        out = np.concatenate([[0], np.cumsum(size)])
        return sym[np.arange(out[-1]) + np.repeat(begin - out[:-1], size)], out


def load_merges(model: dict, symbols: dict[str, int]) -> Merges:
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    suffix = model.get("end_of_word_suffix") or ""
    left, right = (np.array([symbols[p[k]] for p in pairs]) for k in (0, 1))
    made = np.array([symbols[a + b] for a, b in pairs])
    size = np.zeros(max(symbols.values()) + 1, np.int64)
    for s, i in symbols.items():
        size[i] = len(s.removesuffix(suffix) if suffix and len(s) > len(suffix) else s)
    return Merges(left, right, made, size, dict(zip(made.tolist(), left.tolist())))


class Tokenizer:
    """A byte-level BPE tokenizer read from a tokenizers JSON file: the plain kind (spaces belong to tokens, nothing is
    changed) or the kind with word ends (NFC, lower case, white space dropped)."""

    # White space of the Unicode property; fixed values.
    SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.fold = bool(self.suffix)
        vocab = model["vocab"]
        self.merges = load_merges(model, vocab)
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int32)
        self.end_id = np.array([vocab[c + self.suffix] for c in alphabet], np.int32)
        back = {c: b for b, c in enumerate(alphabet)}
        n = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        self.bytes_of: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in (token.removesuffix(self.suffix) if self.suffix else token))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.lookahead = self.merges.lookahead()
        if self.fold:
            wide, fast = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
        else:
            wide = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
        solid = f"[^{self.SPACES}]"
        white = f"[{self.SPACES}]"
        self.wide = regex.compile(wide.replace(r"[^\s", f"[^{self.SPACES}").replace(r"\S", solid).replace(r"\s", white))
        self.fast = re.compile(fast.replace(r"[^\s", f"[^{self.SPACES}").replace(r"\S", solid).replace(r"\s", white))
        self.split_safely = re.compile(f" (?={solid})")
        self.spaces = frozenset(self.SPACES)
        self.stops = frozenset(".,;:!?")
        self.tail: dict[str, bytes] = {}

    def stretches(self, piece: str) -> list[str | int]:
        """Pre-tokens of a piece in order; special tokens as their ids."""
        if "<|" in piece:
            out: list[str | int] = []
            for part in self.special_pattern.split(piece):
                out += [self.special[part]] if part in self.special else self._plain(part)
            return out
        return self._plain(piece)

    def _plain(self, part: str) -> list[str]:
        if self.fold:
            part = self._fold(part)
        return (self.fast if part.isascii() else self.wide).findall(part)

    @staticmethod
    def _fold(part: str) -> str:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
            if "\u03a3" in part:  # a capital sigma gets its medial form everywhere
                return "".join([c.lower() for c in part])
        return part.lower()

    def symbols(self, stretch: bytes) -> np.ndarray:
        raw = np.frombuffer(stretch, np.uint8)
        sym = self.byte_id[raw]
        if self.suffix:
            sym[-1] = self.end_id[raw[-1]]
        return sym

    def encode_stream(self, stretch: bytes, window: int = WINDOW) -> bytes:
        """Ids of one long stretch, window by window; only final tokens are emitted before its end."""
        sym, out, done = self.symbols(stretch), [], 0
        carry = np.zeros(0, np.int32)
        while done < len(sym):
            take = sym[done : done + window]
            done += len(take)
            buf = np.concatenate([carry, take])
            ids, _ = self.merges.merge(buf, np.array([0, len(buf)]))
            ends = np.cumsum(self.merges.size[ids])
            final = len(ids) if done == len(sym) else int(np.searchsorted(ends, len(buf) - self.lookahead, "right"))
            out.append(ids[:final].astype("<u4").tobytes())
            carry = buf[ends[final - 1] if final else 0 :]
        return b"".join(out)

    def encode_stretches(self, stretches: list[str]) -> list[bytes]:
        """Ids of distinct stretches, as little-endian 32-bit values."""
        raw = [x.encode() for x in stretches]
        result: list[bytes] = [b""] * len(raw)
        limit = max(4096, 2 * self.lookahead)
        short = [i for i, x in enumerate(raw) if len(x) <= limit]
        for i, x in enumerate(raw):
            if len(x) > limit:
                result[i] = self.encode_stream(x)
        for lo in range(0, len(short), 16384):
            part = [raw[i] for i in short[lo : lo + 16384]]
            first = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            flat = np.frombuffer(b"".join(part), np.uint8)
            sym = self.byte_id[flat]
            if self.suffix:
                sym[first[1:] - 1] = self.end_id[flat[first[1:] - 1]]
            ids, cut = self.merges.merge(sym, first)
            data, cut = ids.astype("<u4").tobytes(), (4 * cut).tolist()
            for k, i in enumerate(short[lo : lo + 16384]):
                result[i] = data[cut[k] : cut[k + 1]]
        return result


    def _safe(self, piece: str) -> bool:
        """Whether a piece neither begins nor ends with white space, so that cutting before its space changes nothing."""
        return bool(piece) and piece[0] not in self.spaces and piece[-1] not in self.spaces

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit values."""
        running = gc.isenabled()
        gc.disable()  # thousands of short-lived tuples hold no cycles
        try:
            return self._encode_block(texts)
        finally:
            if running:
                gc.enable()

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        gap, cached = "" if self.fold else " ", self.tail.get
        split = [t.split(" ") for t in texts]
        ids = [list(map(cached, p)) for p in split]
        missing = {x for p, v in zip(split, ids) if None in v for x, y in zip(p, v) if y is None}
        heads = {p[0] for p in split} if gap else set()
        if gap:
            unsafe = {x for x in missing if not self._safe(x)}
            if unsafe:
                missing -= unsafe
                for i, p in enumerate(split):
                    if len(p) > 1 and not unsafe.isdisjoint(p):
                        split[i] = p = self.split_safely.split(texts[i])
                        heads.add(p[0])
                        ids[i] = list(map(cached, p))
                        missing.update([x for x, y in zip(p[1:], ids[i][1:]) if y is None])
        made = {gap: self._encode_pieces(missing, gap), "": {}} if gap else {"": self._encode_pieces(missing, "")}
        if gap:
            first = self._encode_pieces(heads, "")
        fresh = made[gap]
        out = []
        for p, v in zip(split, ids):
            if gap:
                v[0] = first[p[0]]
            out.append(b"".join([fresh[x] if y is None else y for x, y in zip(p, v)] if None in v else v))
        room = CACHE_PIECES - len(self.tail)
        if room > 0:
            self.tail.update([(x, y) for x, y in fresh.items() if len(x) <= CACHED_CHARS and (self.fold or self._safe(x))][:room])
        return out

    def _encode_pieces(self, pieces: set[str], gap: str) -> dict[str, bytes]:
        """Ids of distinct pieces, each with ``gap`` before it."""
        place: dict[str, int] = {}
        at = place.setdefault
        plans = []
        for x in pieces:
            word = self._fold(x) if self.fold else x
            if word.isalpha():
                word = gap + word
                plans.append(at(word, len(place)))
            elif word[-1:] in self.stops and word[:-1].isalpha():
                word, stop = gap + word[:-1], word[-1]
                plans.append((at(word, len(place)), at(stop, len(place))))
            else:
                plans.append([at(t, len(place)) if t.__class__ is str else ~t for t in self.stretches(gap + x)])
        done = self.encode_stretches(list(place))
        return {
            x: done[k] if k.__class__ is int else b"".join([done[t] if t >= 0 else (~t).to_bytes(4, "little") for t in k])
            for x, k in zip(pieces, plans)
        }

    def decode_stream(self, ids: np.ndarray, block: int = 1 << 16) -> Iterator[str]:
        """Text of ids, piece by piece: ids become bytes, and a UTF-8 state machine carries the bytes of an unfinished
        character to the next block."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for lo in range(0, len(ids), block):
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids[lo : lo + block].tolist())))
        yield machine.decode(b"", True)


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, loaded once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about a slice each, with the index of the first."""
    for s in A.slices(column):
        yield s.lo, [s.text(i) for i in range(s.rows)]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Token ids of every text: (id, ``ids`` as little-endian unsigned 32-bit binary). Null text: no ids. Repeated rows give
    repeated rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for lo, texts in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(t.encode_block(texts), pa.binary())], names=["id", "ids"])

    ids = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text").alias("__text"))
    return ids.mapInArrow(run, f"id {ids.schema[0].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Texts of ``ids`` as ``encode`` gives them; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts = ["".join(t.decode_stream(np.frombuffer(x or b"", "<u4"))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    ids = encoded.select(F.col(f"`{id_column}`").alias("id"), "ids")
    return ids.mapInArrow(run, f"id {ids.schema[0].dataType.simpleString()}, text string").withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Encode and decode every text in one task, without sending ids or texts back: counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for lo, texts in blocks(batch.column(1)):
                coded = t.encode_block(texts)
                back = []
                for x in coded:
                    digest = hashlib.sha256()
                    for part in t.decode_stream(np.frombuffer(x, "<u4")):
                        digest.update(part.encode())
                    back.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array(back)],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    ids = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text").alias("__text"))
    schema = f"id {ids.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return ids.mapInArrow(run, schema).withColumnRenamed("id", id_column)
