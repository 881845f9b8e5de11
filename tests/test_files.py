"""Containers as data sources: split reads, pruning and pushed filters, committed and aborted writes."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from tributary.sources import containers as K
from tributary.sources import files as S

HEAD = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"AV01", 16, 16, 30, 1, 1, 0)


@pytest.fixture(scope="module")
def formats(spark):
    return S.register(spark)


def ivf(*payloads):
    return HEAD + b"".join(struct.pack("<IQ", len(p), 10 * i) + p for i, p in enumerate(payloads))


def names(path):
    return sorted(f for f in os.listdir(path) if not f.startswith((".", "_")))


def test_a_large_file_is_split(formats, tmp_path):
    """3 GB of frames (a file with holes), of which only headers and one small payload are read."""
    sizes = [100_000_000] * 30 + [5]
    with open(tmp_path / "big.ivf", "wb") as f:
        f.write(HEAD)
        for i, n in enumerate(sizes):
            f.write(struct.pack("<IQ", n, i))
            f.seek(n, 1) if n > 5 else f.write(b"hello")
    assert os.path.getsize(tmp_path / "big.ivf") > 3 * 10**9
    read = lambda: formats.read.format("ivf").option("split", 250_000_000)
    frames = read().schema("idx int, pts long, size long").load(str(tmp_path))
    assert frames.rdd.getNumPartitions() == 11
    assert sorted(map(tuple, frames.collect())) == [(i, i, n) for i, n in enumerate(sizes)]
    one = read().load(str(tmp_path)).filter("idx = 30")
    assert one.rdd.getNumPartitions() == 1
    assert [(bytes(r.payload), r.size, r.error) for r in one.collect()] == [(b"hello", 5, None)]
    assert read().load(str(tmp_path)).filter("idx > 27 and idx <= 29").select("pts").collect() == [(28,), (29,)]
    index = S.split_index(formats, S.Ivf, S.listed(str(tmp_path), ".ivf"), 250_000_000)
    index.write.parquet(str(tmp_path / "_index"))
    again = read().schema("idx int, pts long, size long").option("index", str(tmp_path / "_index")).load(str(tmp_path))
    assert again.rdd.getNumPartitions() == 11 and sorted(again.collect()) == sorted(frames.collect())


@pytest.mark.parametrize("split", [1, 40, 1 << 20])
def test_parts_of_any_size_give_the_rows_of_the_whole(formats, tmp_path, split):
    units = [((i * 7) % 16, i % 8, i % 4, bytes([i]) * (i % 5)) for i in range(60)]
    rows = formats.createDataFrame([(k, t, a, b, bytearray(p), k // 7) for k, (t, a, b, p) in enumerate(units)], "k int, type int, temporal_id int, spatial_id int, payload binary, temporal_unit int").coalesce(1)
    rows.write.format("low_overhead_units").mode("append").save(str(tmp_path / "low"))
    rows.write.format("annexb_units").mode("append").save(str(tmp_path / "b"))
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.ivf").write_bytes(ivf(*(p for _, _, _, p in units)))
    for format_, parse, folder in (("low_overhead_units", K.low_overhead_units, "low"), ("annexb_units", K.annexb_units, "b"), ("ivf", K.ivf_frames, "i")):
        whole = parse(formats.read.format("binaryFile").load(str(tmp_path / folder)).filter("length > 0").select("content"))
        parts = formats.read.format(format_).option("split", split).load(str(tmp_path / folder))
        assert parts.count() == 60 and (split > 40 or parts.rdd.getNumPartitions() >= 5)
        shared = [c for c in whole.columns if c in parts.columns]
        assert sorted(map(str, whole.select(shared).collect())) == sorted(map(str, parts.select(shared).collect()))
    some = formats.read.format("annexb_units").option("split", split).load(str(tmp_path / "b")).filter("type in (7, 14) and spatial_id < 3 and payload is not null")
    assert sorted(r.idx for r in some.collect()) == [k for k, u in enumerate(units) if u[0] in (7, 14) and u[2] < 3]


def test_faults_are_rows_and_filters_leave_them_out(formats, tmp_path):
    (tmp_path / "a.ivf").write_bytes(ivf(b"ab", b"c")[:-1])
    (tmp_path / "b.ivf").write_bytes(b"RIFF" + ivf(b"x")[4:])
    (tmp_path / "c.ivf").write_bytes(b"")
    (tmp_path / "_d.ivf").write_bytes(b"not read")
    rows = formats.read.format("ivf").load(str(tmp_path)).orderBy("path", "idx").collect()
    assert sorted((os.path.basename(r.path), r.idx, r.error) for r in rows if r.error) == [("a.ivf", None, "truncated frame"), ("b.ivf", None, "not an IVF file of this codec"), ("c.ivf", None, "truncated file header")]
    assert [bytes(r.payload) for r in rows if r.payload] == [b"ab"]
    assert formats.read.format("ivf").load(str(tmp_path)).filter("idx >= 0").count() == 1
    (tmp_path / "e").mkdir()
    assert formats.read.format("ivf").load(str(tmp_path / "e")).collect() == []


def test_written_files_are_bounded_and_read_back(formats, tmp_path):
    frames = formats.range(500).select(F.concat(F.lit("s/"), F.col("id") % 3).alias("file"), F.col("id").alias("pts"), F.encode(F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")), "utf-8").alias("payload"))
    path = str(tmp_path / "out")
    for mode in ("append", "overwrite"):
        frames.repartition(4).sortWithinPartitions("file", "pts").write.format("ivf").option("width", 640).option("file_bytes", 2000).mode(mode).save(path)
    assert "_SUCCESS" in os.listdir(path) and not [f for f in os.listdir(path) if f.startswith("_staging")]
    assert all(os.path.getsize(f"{path}/{f}") <= 2032 for f in names(path)) and len(names(path)) > 12
    back = formats.read.format("ivf").load(path)
    assert {(r.width, r.error) for r in back.select("width", "error").distinct().collect()} == {(640, None)}
    assert sorted((r.pts, len(r.payload)) for r in back.collect()) == [(i, i % 90) for i in range(500)]
    assert back.groupBy("path").agg((F.max("frame_count") == F.count("idx")).alias("ok"), (F.max("idx") + 1 == F.count("idx")).alias("numbered")).filter("not ok or not numbered").count() == 0
    frames.limit(7).write.format("ivf").mode("append").save(path)
    assert formats.read.format("ivf").load(path).count() == 507


def test_a_failed_task_leaves_nothing(formats, tmp_path):
    @F.udf("binary")
    def failing(i):
        if i == 77:
            raise RuntimeError("no payload")
        return bytes(3)

    path = str(tmp_path / "out")
    good = formats.range(100).select(F.col("id").alias("pts"), F.lit(bytearray(b"abc")).alias("payload"))
    bad = formats.range(100).repartition(4).select(F.col("id").alias("pts"), failing("id").alias("payload"))
    with pytest.raises(Exception, match="no payload"):
        bad.write.format("ivf").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    good.write.format("ivf").mode("append").save(path)
    kept = names(path)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no payload"):
            bad.write.format("ivf").mode(mode).save(path)
        assert names(path) == kept and not [f for f in os.listdir(path) if f.startswith("_staging")]


def test_raw_planes(formats, tmp_path):
    rows = formats.createDataFrame([(1, bytearray(b"yyyy"), bytearray(b"u"), bytearray(b"v")), (2, bytearray(b"YYYY"), bytearray(b"U"), None)], "n int, y binary, u binary, v binary").coalesce(1)
    rows.write.format("raw_planes").mode("append").save(str(tmp_path / "p"))
    assert b"".join((tmp_path / "p" / f).read_bytes() for f in names(tmp_path / "p")) == b"yyyyuvYYYYU"


def test_digests_of_files(formats, tmp_path):
    import hashlib

    data = {"a": b"", "b": b"x" * 3_000_001, "c": b"abc"}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)
    got = {os.path.basename(r.path): r for r in S.file_digests(formats, [str(tmp_path / k) for k in (*data, "missing")], 1 << 16).collect()}
    assert {k: (got[k].size, got[k].sha256) for k in data} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items()}
    assert got["missing"].sha256 is None and got["missing"].error and S.file_digests(formats, []).collect() == []
