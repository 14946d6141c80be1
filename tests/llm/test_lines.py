import re

from chartloom.llm import lines


def by_hand(rows):
    """``rows``: (id, text), ids distinct."""
    numbered, seen, gone = {}, {}, {}
    for i, t in rows:
        numbered[i] = [k for k, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        parts = (t or "").split("\n")
        for p in range(len(numbered[i]) - 2):
            window = tuple(parts[k] for k in numbered[i][p : p + 3])
            if window in seen:
                gone.setdefault(i, set()).update(numbered[i][p : p + 3])
            seen.setdefault(window, (i, p))
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())), len((t or "").split("\n")), len(gone.get(i, ()))) for i, t in rows}


TEXTS = [
    (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "é\n\n é\nü\n \nz"), (7, "q\né\n é\n\n\nü\nz"), (8, "s\n" * 12), (9, "\n\n\n"),
    (10, "b\nc\nd"), (11, "\n".join(f"line {i}" for i in range(5000))), (12, "\n".join(f"line {i}" for i in range(4000))), (None, "x\na\nb"), (13, "a\r\nb\r\nc"),
]


def test_windows_by_hand(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string").selectExpr("*", "cast(length(text) as int) as n_chars", "1 as h", "2 as pos", "3 as none", "4 as id").repartition(3)
    made = lines.dedup(docs)
    assert made.columns == [*docs.columns, "n_lines", "n_removed"] and made.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = {r.doc_id: r for r in made.collect()}
    for i, (text, n, removed) in by_hand(TEXTS).items():
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == (text, n, removed), i
        assert got[i].n_chars == (None if text is None else len(text)) and got[i].id == 4
    assert lines.dedup(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup(docs).collect()}
    assert got == by_hand(rows) and sum(r[2] for r in got.values()) > 100


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in lines.dedup(docs).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]


def test_null_and_repeated_ids_are_told_apart_by_text(spark):
    rows = [
        (None, "a\nb\nc\nd"), (None, "p\nq\nr\ns"), (None, "x\nb\nc\nd"), (None, None), (4, "k\nl\nm\nn"), (4, "o\nl\nm\nn"), (4, "e\nf\ng\nh\ni"),
        (5, "k\nl\nm\nn"), (4, "k\nl\nm\nn"), (6, "u\nv\nw\nu\nv\nw"), (None, "u\nv\nw\n1\n2"), (None, "u\nv\nw\n1\n2"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as doc", "2 as starts")
    order = sorted({(r.doc_id is None, r.doc_id or 0, r.h, r.text) for r in docs.selectExpr("*", "xxhash64(text) as h").collect() if r.text is not None})
    want = by_hand([(k, t) for k, (_, _, _, t) in enumerate(order)])
    want = {(None if none else i, t): want[k] for k, (none, i, _, t) in enumerate(order)} | {(None, None): (None, 1, 0)}
    got = lines.dedup(docs).selectExpr("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got))) == sorted(repr((i, *want[i, t])) for i, t in rows)
    clean = {(None, "p\nq\nr\ns"), (4, "e\nf\ng\nh\ni")}
    assert clean <= {(r.doc_id, r.text) for r in got}
