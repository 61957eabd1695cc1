"""Hashes of files and of archive members by offsets."""

from __future__ import annotations

import hashlib
import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from tessitura.operators import content


def test_hash_files(spark, tmp_path):
    files = {"a.bin": os.urandom(3_000_000), "b.bin": b"", "d/c.bin": b"x" * content.BLOCK, "é f.bin": b"1"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for size in (1, 256 << 20):
        got = content.hash_files(spark, str(tmp_path), "*.bin", bytes_per_task=max(size, 500_000)).collect()
        assert sorted((r.length, r.sha256) for r in got) == sorted((len(d), hashlib.sha256(d).hexdigest()) for d in files.values())


def test_file_beyond_a_row(spark, tmp_path):
    """A sparse file of over 2 GB, which is too long for one binary value."""
    path, size = tmp_path / "large.bin", (1 << 31) + 5
    with open(path, "wb") as f:
        f.truncate(size)
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(128):
        digest.update(zeros)
    digest.update(bytes(5))
    assert [tuple(r) for r in content.hash_files(spark, str(tmp_path)).select("length", "sha256").collect()] == [(size, digest.hexdigest())]


def test_ranges(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    rows = [(f"{tmp_path}/f", 0, 10, 1), (f"{tmp_path}/f", 3, 2, 2), (f"{tmp_path}/f", 8, 3, 3), (f"{tmp_path}/f", 5, 0, 4), (f"{tmp_path}/none", 0, 1, 5)]
    got = {r.id: r.sha256 for r in content.hash_ranges(spark.createDataFrame(rows, "path string, offset long, length long, id int")).collect()}
    right = {1: b"0123456789", 2: b"34", 4: b""}
    assert got == {i: hashlib.sha256(right[i]).hexdigest() if i in right else None for i in range(1, 6)}
    assert content.hash_ranges(spark.createDataFrame([], "path string, offset long, length long")).count() == 0


def archive(path, members, form=tarfile.GNU_FORMAT):
    with tarfile.open(path, "w", format=form) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_members_by_range(spark, tmp_path, form):
    members = [("a.mxl", os.urandom(2_000_000)), ("d/" + "n" * 150 + ".mxl", b"y"), ("é.mxl", b""), ("last.mxl", b"z" * 700)]
    archive(tmp_path / "1.tar", members, form)
    archive(tmp_path / "2.tar", members, form)
    whole = (tmp_path / "2.tar").read_bytes()
    (tmp_path / "2.tar").write_bytes(whole[: whole.index(b"z" * 700) + 100])  # the last member is cut off
    (tmp_path / "3.tar").write_bytes(b"no archive" * 100)
    (tmp_path / "4.tar").write_bytes(b"")
    given = spark.createDataFrame([(i, f"{tmp_path}/{i}.tar") for i in range(1, 6)], "id long, path string")
    got = content.archive_members_by_range(given, bytes_per_task=1_000_000)
    right = [(i, n, hashlib.sha256(d).hexdigest(), len(d)) for i in (1, 2) for n, d in members if i == 1 or n != "last.mxl"]
    assert sorted(map(tuple, got.collect())) == sorted(right)
    assert sorted(map(tuple, content.archive_members_at(given.where("id = 1")).collect())) == sorted(r for r in right if r[0] == 1)


def test_pack(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 4).alias("archive_id"), F.format_string("%03d", "id").alias("relative_path"), F.encode(F.repeat(F.lit("ab"), F.col("id").cast("int")), "UTF-8").alias("content"))
    packed = sorted(map(tuple, content.pack_archives(rows, f"{tmp_path}/out").collect()))
    assert packed == [(i, f"{tmp_path}/out/{i}.tar", 75) for i in range(4)] and sorted(os.listdir(tmp_path / "out")) == [f"{i}.tar" for i in range(4)]
    again = content.pack_archives(rows, f"{tmp_path}/out").count()
    given = spark.createDataFrame([(i, p) for i, p, _ in packed], "id long, path string")
    got = sorted(map(tuple, content.archive_members_by_range(given).collect()))
    assert again == 4 and got == sorted((i % 4, f"{i:03d}", hashlib.sha256(b"ab" * i).hexdigest(), 2 * i) for i in range(300))
    with tarfile.open(packed[1][1]) as tar:
        assert tar.getnames() == [f"{i:03d}" for i in range(1, 300, 4)]


def test_truncate(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    cuts = spark.createDataFrame([(f"{tmp_path}/f", 4)], "path string, length long")
    assert content.truncate_files(cuts).count() == 1 and (tmp_path / "f").read_bytes() == b"0123"
