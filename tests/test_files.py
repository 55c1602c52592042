"""The source of file trees against the file system itself."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evalframe.sources import inventory as I
from evalframe.sources.files import Files, file_system, planned, scan_tree, write_tree


@pytest.fixture
def tree(tmp_path):
    rng, made = random.Random(4), {}
    for i in range(60):
        path, raw = f"{'abc'[i % 3]}/{'deep/' * (i % 4)}f {i}é.tif", rng.randbytes(rng.choice([0, 1, 99, 5000, 40_000]))
        p = tmp_path / "root" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
        made[path] = raw
    (tmp_path / "root/a/.writing-0").write_bytes(b"of a task that died")
    return str(tmp_path / "root"), made


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_all_kinds_equal_the_files(spark, tree, scheme):
    root, made = tree
    small = {"partition_bytes": 70_000, "piece_bytes": 1000}
    at = scheme + root
    assert {r.path: r.length for r in scan_tree(spark, at).collect()} == {p: len(x) for p, x in made.items()}
    for name in ("sha256", "md5", "sha1"):
        got = scan_tree(spark, at, "checksum", algorithm=name, **small)
        assert {r.path: r.checksum for r in got.collect()} == {p: hashlib.new(name, x).hexdigest() for p, x in made.items()}
    assert got.rdd.getNumPartitions() > 5
    assert {r.path: bytes(r.content) for r in scan_tree(spark, at, "content", **small).collect()} == made
    pieces = scan_tree(spark, at, "pieces", **small).collect()
    assert max(len(r.content) for r in pieces) == 1000
    assert {p: b"".join(bytes(r.content) for r in sorted(pieces, key=lambda r: r.offset) if r.path == p) for p in made} == made


def test_absent_and_empty_roots_have_no_rows(spark, tmp_path):
    for read in ("list", "checksum", "content", "pieces"):
        assert scan_tree(spark, str(tmp_path / "none"), read).collect() == []
    assert I.scan_files(spark, str(tmp_path / "none"), content=True).collect() == []
    pairs, status = I.discover_root(spark, str(tmp_path / "none"), "none")
    assert pairs.collect() == [] and [tuple(r) for r in status.collect()] == [("none", 0, "dataset root has no files")]
    with pytest.raises(ValueError, match="unknown kind"):
        scan_tree(spark, str(tmp_path), "all")
    with pytest.raises(Exception, match="unsupported algorithm"):
        scan_tree(spark, str(tmp_path), "checksum", algorithm="crc").collect()


def test_partitions_are_even_and_cut_large_files():
    files = [(f"f{i:04}", (i * 37) % 1000) for i in range(500)] + [("large", 10_000_000_000), ("none", 0)]
    parts = planned(files, "pieces", 3_000_000, 100_000)
    covered = {}
    for p in parts:
        assert isinstance(p, Files) and sum(hi - lo for *_, lo, hi in p.parts) <= 3_000_000
        for path, _, lo, hi in p.parts:
            covered.setdefault(path, []).append((lo, hi))
    assert {p: sum(hi - lo for lo, hi in x) for p, x in covered.items()} == dict(files)
    assert all(a[1] == b[0] and a[1] % 100_000 == 0 for x in covered.values() for a, b in zip(sorted(x), sorted(x)[1:]))
    assert sum(len(p.parts) for p in planned(files, "checksum", 3_000_000, 100_000)) == len(files)


def test_written_files_are_whole_and_few_folders(spark, tmp_path):
    rows = [("images", f"{i}.tif", f"text {i} é") for i in range(200)] + [("labels/new", "1=2.tif", "z"), (None, "top", ""), ("images", "7.tif", "text 7 é")]
    df = spark.createDataFrame(rows, "folder string, name string, value string").repartition(5)
    write_tree(df, str(tmp_path / "out"))
    write_tree(df, str(tmp_path / "out"))  # a second run leaves the same files
    got = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert got == {f"{f}/{n}" if f else n: v for f, n, v in rows}
    assert sum(p.is_dir() for p in (tmp_path / "out").rglob("*")) == 3
    write_tree(spark.createDataFrame([("b", "raw", b"\x00\xff")], "folder string, name string, value binary"), str(tmp_path / "out"))
    assert (tmp_path / "out/b/raw").read_bytes() == b"\x00\xff"
    with pytest.raises(Exception, match="not a file's name"):
        write_tree(df.limit(1).withColumn("name", F.lit("../x")), str(tmp_path / "out"))


def test_locations():
    assert file_system("/a/b/")[1] == file_system("file:///a/b")[1] == file_system("file:/a/b/")[1] == "/a/b"
