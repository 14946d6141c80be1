import numpy as np
import pyarrow as pa

from chartloom.llm import arrays, jaccard, lines, minhash, rules


def thue_morse(n, zero, one):
    """``n`` letters of the word on which polynomials modulo a power of two agree with its complement, and that one."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [(zero, one)[b] for b in bits], [(one, zero)[b] for b in bits]


LETTERS = ["".join(w) for w in thue_morse(4096, "a", "b")]
WORDS = [" ".join(w) for w in thue_morse(4096, "left", "right")]


def hashes(texts, salt=0):
    (s,) = arrays.slices(pa.array(texts), 1 << 24)
    return arrays.SpanHash(s.buf)(s.off[:-1], s.off[1:], salt)


def test_spans_of_equal_bytes_and_no_others_are_equal():
    rng = np.random.default_rng(5)
    texts = ["", "a", "a\0", "aa", "\0", "\0\0", "é", "x" * 7, "x" * 8, "x" * 9, *LETTERS, "ab" * 4096, "ba" * 4096]
    texts += ["".join(rng.choice(list("ab"), rng.integers(1, 40))) for _ in range(5000)]
    for salt in (0, 1):
        h = hashes(texts, salt)
        assert len({*h.tolist()}) == len({*texts})
        assert hashes(texts[::-1], salt).tolist() == h[::-1].tolist()
    # an empty span, of which there is one, is zero whatever the salt
    assert set(hashes(texts, 0).tolist()) & set(hashes(texts, 1).tolist()) == {0}


def test_sequences_tell_places_and_lengths_apart():
    rows = [[], [0], [0, 0], [1, 2], [2, 1], [1], [2], [1, 2, 3], [3, 1, 2]]
    x = np.array([v for r in rows for v in r], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert len(set(arrays.sequences(x, first).tolist())) == len(rows)


def test_complements_stay_different(spark):
    a, b = LETTERS
    (s,) = arrays.slices(pa.array([f"{a}\n{b}\n{a}"]))
    assert rules.base_counts(s)["n_dup_lines"].tolist() == [1]
    (s,) = arrays.slices(pa.array([f"{a} {a} {a} {b} {b} {b}"]))
    assert rules.base_counts(s)["n_repeat_words"].tolist() == [0]
    for texts in (LETTERS, WORDS):
        f = minhash.fingerprints_of(pa.array(texts))
        assert len({r.tobytes() for r in f}) == (2 if texts is LETTERS else len({frozenset(zip(*[t.split()[k:] for k in range(5)])) for t in texts}))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        assert sorted(r.copies for r in jaccard.classes(docs).collect()) == [1, 1]
    docs = spark.createDataFrame([(1, LETTERS[0]), (2, LETTERS[1])], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in jaccard.keep_first(docs).collect()) == [1, 2]
    docs = spark.createDataFrame([(1, f"one\n{a}\nthree"), (2, f"one\n{b}\nthree"), (3, f"{a}\n{b}\n{a}\n{b}")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in lines.dedup(docs).collect()} == {1: 0, 2: 0, 3: 0}
