"""Table functions and aggregates in SQL against the calls on DataFrames."""

import math

import pytest
from pyspark.sql import functions as F

from tributary.functions import tables as SQL
from tributary.sources import containers as K
from tributary.sources import headers as H
from tributary.sources import payloads as P
from tributary.sources import rtcp as RC


@pytest.fixture(scope="module")
def sql(spark):
    return SQL.register(spark)


def same(a, b):
    assert a.columns == b.columns and [f.dataType for f in a.schema.fields] == [f.dataType for f in b.schema.fields]
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0


def table(sql, name, *contents):
    df = sql.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(contents)], "k int, content binary")
    df.createOrReplaceTempView(name)
    return df


def test_readers_equal_the_calls(sql):
    payloads = table(sql, "payloads", b"\x10ab", b"\x30\x01a\x02bc" + b"d" * 3, b"\x07", b"", None)
    same(sql.sql("SELECT * FROM rtp_elements(TABLE(payloads), 'content')"), P.payload_elements(payloads))
    same(sql.sql("SELECT * FROM rtp_elements(TABLE(payloads) PARTITION BY (k), 'content')"), P.payload_elements(payloads))
    streams = table(sql, "streams", b"\x12\x00\x0a\x01x", b"\x12\x00\x92", b"\x12")
    same(sql.sql("SELECT * FROM low_overhead_units(TABLE(streams), 'content')"), K.low_overhead_units(streams))
    packets = table(sql, "packets", bytes.fromhex("b1e0ffff00000007000000090000000500000000bede0001"[:32]), bytes.fromhex("8060000100000007000000090102"), b"\x40")
    same(sql.sql("SELECT * FROM rtp_packets(TABLE(packets), 'content')"), K.rtp_packets(packets))
    reports = table(sql, "reports", bytes.fromhex("81cd000300000001000000020 00a0003".replace(" ", "")), b"\x81")
    same(sql.sql("SELECT * FROM rtcp_packets(TABLE(reports), 'content')"), RC.rtcp_packets(reports))
    units = table(sql, "units", b"\x01\x03\xe8\x01\x90\x80", b"\x04\xb5ABC\x80", b"\x03\x0e\x10\x80", b"\x20\x07\x80", b"")
    same(sql.sql("SELECT * FROM metadata_units(TABLE(SELECT * FROM units), 'content')"), H.metadata_units(units, "content"))


def test_units_are_partitioned_and_ordered_by_the_function(sql):
    part = lambda z, y, data: bytearray(bytes([(z << 7) | (y << 6) | 0x10]) + data)
    rows = [(s, q, part(q % 3 > 0, q % 3 < 2, b"%d" % q)) for s in (1, 2, 3) for q in range(30) if (s, q) != (2, 4)]
    df = sql.createDataFrame(rows[::-1], "ssrc int, ext_seq long, payload binary").repartition(7)
    df.createOrReplaceTempView("live_packets")
    got = sql.sql("SELECT * FROM rtp_units(TABLE(live_packets), 'ssrc', 'ext_seq', 'payload')")
    want = P.reassembled(df).filter("complete").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 29


@pytest.mark.parametrize("call,error", [("rtp_elements(TABLE(named), 'nothing')", "no column"), ("rtp_elements(TABLE(named), 'idx')", None), ("rtp_elements(TABLE(SELECT content, 1 AS idx FROM named), 'content')", "named like")])
def test_faulty_calls(sql, call, error):
    sql.createDataFrame([(bytearray(b"\x10a"), bytearray(b"\x10b"))], "content binary, idx binary").createOrReplaceTempView("named")
    if error:
        with pytest.raises(Exception, match=error):
            sql.sql(f"SELECT * FROM {call}").collect()
    else:
        assert sql.sql(f"SELECT * FROM {call}").columns[0] == "content"


def test_aggregate_of_small_groups(sql):
    sql.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, math.e**2), ("a", 1.0, math.e**2), ("b", 1.0, 5.0), ("c", 1.0, -1.0), ("c", 2.0, math.e), ("c", 3.0, math.e), ("d", None, 2.0)], "k string, x double, y double").createOrReplaceTempView("curves")
    got = {r.k: r.m for r in sql.sql("SELECT k, mean_log_rate(x, y) AS m FROM curves GROUP BY k").collect()}
    assert got == {"a": pytest.approx(1.5), "b": None, "c": pytest.approx(1.0), "d": None}
    assert sql.table("curves").groupBy("k").agg(F.expr("mean_log_rate(x, y)")).count() == 4
