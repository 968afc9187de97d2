import gzip
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.sources import gzip_members as G


def chain(texts, level=6):
    return b"".join(gzip.compress(t, level) for t in texts)


def lines_of(spark, path, **options):
    return [r["value"] for r in G.read_gzip_lines(spark, str(path), **options).collect()]


@pytest.mark.parametrize("range_bytes", [7, 40, 300, 1 << 20])
def test_lines_that_cross_members(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    text = "".join(rng.choice(["é", "a" * rng.randrange(90), "\n", "\r\n", ""]) + str(rng.random()) + rng.choice(["\n", ""]) for _ in range(60)).encode()
    cuts = sorted(rng.sample(range(len(text)), 9))
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    (tmp_path / "x.gz").write_bytes(chain([*parts[:4], b"", *parts[4:]]))
    expected = text.decode().replace("\r\n", "\n").split("\n")
    got = lines_of(spark, tmp_path / "x.gz", range_bytes=range_bytes)
    assert got == (expected[:-1] if expected[-1] == "" else expected)


def test_stored_bytes_that_look_like_a_member(spark, tmp_path):
    inner = chain([b"no line of this file\n"])
    # an uncompressed block holds the start of a member, cut short, as it is
    texts = [b"one\n" + inner[:12].replace(b"\n", b"") + b"\n", b"two\n"]
    (tmp_path / "x.gz").write_bytes(chain(texts, 0))
    reader = G.GzipLinesReader({"path": str(tmp_path / "x.gz"), "rangebytes": "11"})
    starts = [s for p in reader.partitions() for s in [G.first_member(open(p.path, "rb"), p.first, p.last)] if s is not None]
    assert starts == [0, len(chain(texts[:1], 0))]


@pytest.mark.parametrize("range_bytes", [50, 1 << 20])
@pytest.mark.parametrize("damage", ["cut", "changed", "garbage", "middle"])
def test_damaged_members_stop_the_job(spark, tmp_path, range_bytes, damage):
    members = [gzip.compress("".join(f"{k} {random.Random(k * 99 + i).random()}\n" for i in range(20)).encode()) for k in range(6)]
    if damage == "cut":
        members[5] = members[5][:-9]
    elif damage == "changed":
        members[3] = members[3][:60] + bytes([members[3][60] ^ 255]) + members[3][61:]
    elif damage == "middle":
        members[2] = members[2][:-20]
    else:
        members.append(b"rest")
    (tmp_path / "x.gz").write_bytes(b"".join(members))
    with pytest.raises(PySparkException, match="member"):
        lines_of(spark, tmp_path / "x.gz", range_bytes=range_bytes)


def test_written_files_are_read_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(5000).select(F.concat(F.lit("line "), "id").alias("value")).repartition(2)
    G.write_gzip_members(df, path, header="name", lines=100)
    got = G.read_gzip_lines(spark, path, header=True, range_bytes=2000)
    assert got.rdd.getNumPartitions() > 4
    assert got.where(F.col("value") != "name").count() == got.count() == 5000
    assert got.exceptAll(df).isEmpty()
    # Spark's own reader takes the same files
    assert spark.read.csv(path, header=True).count() == 5000


def test_empty_folder_file_and_no_path(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "none.gz").write_bytes(b"")
    assert lines_of(spark, tmp_path / "empty") == [] and lines_of(spark, tmp_path / "none.gz") == []
    with pytest.raises(PySparkException):
        lines_of(spark, tmp_path / "missing")
