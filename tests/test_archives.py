"""Archives as a data source, and results of publishers as rows of one kind."""

import zipfile

import pytest
from pyspark.sql import functions as F

from presswarp.sources import archives


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    archives.register(spark)
    root = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(root / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/", "")
        z.writestr("dir/one.csv", "h\r\n1\r\n2")
        z.writestr("dir/two.txt", "x\n\ny\n")
        z.writestr("empty.csv", "")
        z.writestr("ümlaut.csv", "h\né\n".encode() + b"\xff\n")
    with zipfile.ZipFile(root / "b.zip", "w", zipfile.ZIP_STORED) as z:
        for k in range(40):
            z.writestr(f"{k:02}.csv", f"model,score,extra\nm{k},{k}.5,e\n" if k % 2 else f"score,model\n{k}.5,m{k}\n")
    with zipfile.ZipFile(root / "none.zip", "w"):
        pass
    (root / "other.txt").write_text("no archive")
    return root


def read(spark, path, **options):
    return spark.read.format("zip").options(path=str(path), **options).load()


def test_lines_and_files(spark, folder):
    got = sorted(tuple(r)[1:] for r in read(spark, folder / "a.zip").collect())
    assert got == [("dir/one.csv", 0, "h"), ("dir/one.csv", 1, "1"), ("dir/one.csv", 2, "2"), ("dir/two.txt", 0, "x"), ("dir/two.txt", 1, ""), ("dir/two.txt", 2, "y"), ("ümlaut.csv", 0, "h"), ("ümlaut.csv", 1, "é"), ("ümlaut.csv", 2, "�")]
    files = {r.entry: bytes(r.data) for r in read(spark, folder / "a.zip", mode="files").collect()}
    assert files["empty.csv"] == b"" and files["dir/one.csv"] == b"h\r\n1\r\n2" and len(files) == 4
    assert {r.entry for r in read(spark, folder / "a.zip", entries="dir/*.csv").collect()} == {"dir/one.csv"}
    assert read(spark, f"file://{folder}/a.zip").count() == len(got)


def test_entries_are_dealt_by_size(spark, folder):
    many = read(spark, folder / "*.zip", partition_bytes=200)
    assert many.rdd.getNumPartitions() > 5 and many.count() == 9 + 80
    assert read(spark, folder / "none.zip").count() == 0 and read(spark, folder / "nothing*.zip").count() == 0
    assert [p.rsplit("/", 1)[1] for p in archives.archives(f"{folder}/b.zip, {folder}/?.zip")] == ["b.zip", "a.zip", "b.zip"]
    with pytest.raises(Exception, match="zip"):
        read(spark, folder / "other.txt").count()


def test_csv_entries(spark, folder):
    rows = archives.csv_entries(read(spark, folder / "b.zip"), "model string, score double, extra string, absent int").collect()
    assert sorted((r.model, r.score, r.extra, r.absent) for r in rows) == sorted((f"m{k}", k + 0.5, "e" if k % 2 else None, None) for k in range(40))


def test_results(spark):
    wide = spark.createDataFrame([("m1", "c", 1.0, 2.0, 0), ("m1", "c", 9.0, 9.0, 1), ("m2", None, 1.0, None, 2), (" ", "c", 5.0, 5.0, 3), (None, "c", 5.0, 5.0, 4), ("m3", "c", float("nan"), float("inf"), 5)], "name string, conf string, a double, b double, at int")
    one = archives.results(wide, "one", {"source_model_name": F.col("name"), "configuration": F.col("conf"), "position": F.col("at")}, {"a": ("A", F.col("a")), "b": ("B", F.col("b"))})
    ranked = spark.createDataFrame([("x", 5.0, None), ("y", 7.0, 4), ("z", 7.0, None)], "name string, score double, place int")
    two = archives.results(ranked, "two", {"source_model_name": F.col("name"), "base_name": F.upper("name"), "metric_key": F.lit("s"), "raw_score": F.col("score"), "source_rank": F.col("place")})
    got = {(r.source_key, r.source_model_name, r.metric_key): (r.raw_score, r.source_rank, r.base_name, r.metric_name) for r in archives.united([one, two]).collect()}
    assert got == {("one", "m1", "a"): (1.0, 1, "m1", "A"), ("one", "m2", "a"): (1.0, 1, "m2", "A"), ("one", "m1", "b"): (2.0, 1, "m1", "B"), ("two", "x", "s"): (5.0, None, "X", None), ("two", "y", "s"): (7.0, 4, "Y", None), ("two", "z", "s"): (7.0, None, "Z", None)}
    three = archives.results(ranked, "three", {"source_model_name": F.col("name"), "metric_key": F.lit("s"), "raw_score": F.col("score")})
    assert {r.source_model_name: r.source_rank for r in archives.united([three]).collect()} == {"y": 1, "z": 1, "x": 3}
    assert archives.united([three.limit(0)]).columns == list(archives.RESULT)
    with pytest.raises(ValueError):
        archives.results(ranked, "x", {"source_model_name": F.col("name"), "nonsense": F.lit(1)})


def test_partitions_are_bounded(tmp_path, monkeypatch):
    """Entries of several archives share a partition, and many small ones don't make as many partitions; lines come in batches, as they were."""
    monkeypatch.setattr(archives, "MOST_PARTITIONS", 4)
    monkeypatch.setattr(archives, "BATCH_LINES", 3)
    for k in range(40):
        with zipfile.ZipFile(tmp_path / f"{k:02}.zip", "w") as out:
            out.writestr("a.txt", b"x\r\ny\xff\n\nz\n" + b"w" * k)
            out.writestr("empty.txt", b"")
    reader = archives._Reader({"path": f"{tmp_path}/*.zip", "partition_bytes": "1"})
    parts = reader.partitions()
    assert len(parts) <= 8 and sum(len(p.value) for p in parts) == 80
    rows = [tuple(r.values()) for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    want = [(f"{tmp_path}/{k:02}.zip", "a.txt", n, x) for k in range(40) for n, x in enumerate(["x", "y�", "", "z", *(["w" * k] if k else [])])]
    assert rows == want
