import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from chartloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_rows(rows, texts):
    """Every id once, right checksums, gapless sequences; gives the padding share."""
    library = Library.from_file(PATH)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r), by_seq[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert set(by_doc) == set(ids)
    for i, found in by_doc.items():
        found.sort(key=lambda r: r.start)
        assert [r.start for r in found] == [sum(q.length for q in found[:k]) for k in range(len(found))]
        assert sum(r.length for r in found) == len(ids[i])
    for found in by_seq.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(q.length for q in found[:k]) for k in range(len(found))]
        assert sum(r.length for r in found) <= packing.WINDOW
    return 1 - sum(map(len, ids.values())) / (packing.WINDOW * len(by_seq))


def test_packing_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("n_chars", "offset")
    assert check_rows(packing.pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}) < 0.02


def test_nulls_empties_repeats_and_long_texts(spark):
    texts = {0: None, 1: "", 2: "word " * 30_000, 3: "a b", 4: "a b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check_rows(packing.pack(docs, PATH).collect(), texts)
    odd = spark.createDataFrame([(None, "x y"), (None, "x y"), (7, "z"), (7, "z")], "doc_id bigint, text string")
    rows = packing.pack(odd, PATH).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 3), (-1, 3), (7, 2), (7, 2)]
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 7, 40])
def test_differencing(k):
    rng = np.random.default_rng(k)
    for n in (0, 1, 2, 5, 60):
        sizes = rng.integers(1, 500, n).tolist()
        made = packing.difference(sizes, k)
        assert sorted(i for w in made for i in w) == list(range(n)) and len(made) <= k
    sizes = rng.integers(1, 100, 60 * k).tolist()
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, k)]
    assert max(sums) - min(sums) <= 2
    assert sorted(sorted(w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [[0, 2], [1, 3, 4]] or k > 0


def test_windows_rise_with_overflow():
    made = packing.pack_block([60, 60, 60], 100)
    assert len(made) == 3
