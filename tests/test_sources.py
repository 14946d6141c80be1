import struct
import zlib

import pytest
from pyspark.sql import functions as F

from chartloom.operators import fingerprint as FP
from chartloom.operators import resolve as R
from chartloom.sources import files, tables


def _png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    body = b"".join(b"\0" + b"\x7f\x7f\x7f" * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "images"
    (root / "train").mkdir(parents=True)
    for name in ("a_bar_1.png", "b_bar_2.PNG", "c_pie_1.png", "misc.png"):
        (root / name).write_bytes(_png(8, 6))
    (root / "d_pie_2.png").write_bytes(b"not an image")
    (root / "notes.txt").write_text("x")
    (root / "train" / "e_line_1.png").write_bytes(_png(3, 3))
    return str(root)


def test_scans(spark, folder):
    assert files.scan_files(spark, folder).count() == 5
    assert files.count_files(spark, folder) == 6
    names = [r["name"] for r in files.list_files(spark, folder).collect()]
    assert names == sorted(names) and "notes.txt" in names
    ids = {r["image_name"]: r for r in files.unified_scan(spark, {"local_raw": folder}).collect()}
    assert ids["a_bar_1.png"]["image_id"] == "local_raw_0000000"
    assert ids["e_line_1.png"]["original_split"] == "train"
    with pytest.raises(ValueError):
        files.unify({"none": files.scan_files(spark, folder, (".gif",))})


def test_probe_verify_and_balance(spark, folder):
    probed = files.probe_images(spark, folder)
    sizes = {r["image_name"]: (r["width"], r["height"], r["is_corrupt"]) for r in probed.collect()}
    assert sizes["a_bar_1.png"] == (8, 6, 0) and sizes["d_pie_2.png"] == (0, 0, 1)
    verified, balanced, summary = files.verify_and_balance(probed, target_total=5)
    assert verified.filter("is_verified = 1").count() == 3
    assert balanced.count() == 2
    row = summary.first()
    assert row["corrupt"] == 1 and row["unknown_labels"] == 1 and row["class_counts"] == {"bar_chart": 2, "pie_chart": 1}
    assert row["meets_target"]
    wanted = probed.select("path").union(spark.createDataFrame([("file:/gone.png",)], "path string"))
    with pytest.raises(ValueError, match="2 missing"):
        files.require_valid(wanted, probed)


def test_content_cache(spark, folder, tmp_path):
    rows = files.read_contents(spark, folder).select("path", FP.content_key(F.col("content"), "s").alias("content_key"))
    cache = FP.ResultCache(spark, str(tmp_path / "cache"))
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.select("content_key", F.length("path").alias("result"))

    assert cache.stats(rows).first()["hits"] == 0
    first = cache.compute_missing(rows, compute)
    assert first.count() == rows.count() and first.filter("result IS NULL").count() == 0
    cache.compute_missing(rows, compute)
    assert calls == [rows.select("content_key").distinct().count(), 0]
    assert cache.stats(rows).first()["misses"] == 0
    pinned = cache.version()
    cache.invalidate()
    assert cache.stats(rows).first()["hits"] == 0 and cache.read() is None
    assert cache.stats(rows, pinned).first()["misses"] == 0  # a reader of the earlier version still has all
    again = cache.compute_missing(rows.limit(1), compute)
    assert again.count() == 1 and cache.read().count() == 1 and cache.version() == pinned + 2
    # a part without an event is no part of any version
    rows.select("content_key", F.lit(0).alias("result")).write.parquet(str(tmp_path / "cache" / "parts" / "lost"))
    assert cache.read().count() == 1


def test_fingerprint_and_feature_reuse(spark, tmp_path):
    df = spark.createDataFrame([(f"n{i % 7}", i % 7) for i in range(50)], "name string, size int")
    a = FP.dataset_fingerprint(df, ["name", "size"]).first()
    b = FP.dataset_fingerprint(df.repartition(7).orderBy(F.rand()), ["name", "size"]).first()
    assert a == b and a["rows"] == 50 and len(a["fingerprint"]) == 64
    assert FP.dataset_fingerprint(df.limit(49), ["name", "size"]).first()["fingerprint"] != a["fingerprint"]
    built = []

    def build(source):
        built.append(1)
        return source.distinct()

    for _ in range(2):
        assert FP.reuse_features(df, ["name", "size"], str(tmp_path / "f"), build).count() == 7
    assert built == [1]
    FP.reuse_features(df.limit(10), ["name", "size"], str(tmp_path / "f"), build)
    assert built == [1, 1]
    assert FP.configuration_hash({"a": 1, "b": 2}) == FP.configuration_hash({"b": 2, "a": 1})


def test_six_names_resolve_to_the_original_store(spark):
    names = [f"{i}_dot_line.png" for i in range(10, 16)]
    rows = spark.createDataFrame([(n, f"raw_images/{n}") for n in names], "image_name string, image_path string")
    original = spark.createDataFrame([(f"/orig/{n.upper()}",) for n in names], "path string")
    empty = spark.createDataFrame([], "path string")
    resolved = R.resolve_references(rows, empty, original)
    assert {r["tier"]: r["rows"] for r in R.coverage(resolved).collect()} == {"raw": 0, "original": 6, "missing": 0}
    assert R.require_resolved(resolved).count() == 6
    with pytest.raises(FileNotFoundError):
        R.require_resolved(R.resolve_references(rows, empty, empty))
    with pytest.raises(ValueError, match="duplicate"):
        R.require_unique_names(original.union(original))


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y'), (2, None)], "id int, t string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), "id int, t string").collect())) == [(1, 'say "x", y'), (2, None)]
    (tmp_path / "r.json").write_text('[{"image_name": "a", "v": {"x": 1}},\n {"image_name": "b", "v": {}}]')
    back = tables.read_json(spark, str(tmp_path / "r.json"), "image_name string, v map<string,int>", array_file=True)
    assert {r["image_name"]: r["v"] for r in back.collect()} == {"a": {"x": 1}, "b": {}}
    snap = tables.provenance(spark, 42, "f" * 64, {"ratio": 0.7})
    tables.append_provenance(snap, str(tmp_path / "p"))
    tables.append_provenance(snap, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 2


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_a_table_written_in_parts_is_one_file(spark, tmp_path, scheme):
    root = tmp_path / "in.parquet" / "sf0.1"  # the extension above the root does not count
    (root / "deep").mkdir(parents=True)
    (root / "one.parquet").write_bytes(b"12345")
    (root / "notes.txt").write_text("x")
    spark.range(9).repartition(3).write.parquet(str(root / "many.PARQUET"))
    spark.range(4).repartition(2).write.parquet(str(root / "deep" / "below.parquet"))
    scan = lambda **how: {r["name"]: r for r in files.scan_files(spark, f"{scheme}{root}/", (".parquet",), in_parts=True, **how).collect()}
    flat, deep = scan(), scan(recursive=True)
    assert set(flat) == {"one.parquet", "many.PARQUET"} and set(deep) == {*flat, "below.parquet"}
    parts = list((root / "many.PARQUET").glob("part-*"))
    assert flat["many.PARQUET"]["file_size"] == sum(p.stat().st_size for p in parts) and len(parts) == 3
    assert flat["many.PARQUET"]["path"].endswith("/in.parquet/sf0.1/many.PARQUET")
    assert flat["one.parquet"]["file_size"] == 5
