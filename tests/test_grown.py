"""Queries on rows that only grown tables have, against their SQL in DuckDB."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from compare import same
from conftest import SF

from tributary.plans import registry
from tributary.sources import files as S


def against_sql(spark, folder, name, **tables):
    """The query over tables of its own, and its SQL over the same."""
    c = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        c.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    same(registry.QUERIES[name](spark, str(folder)), c.sql(registry.ORACLE_SQL[name]))


def with_column(rows, name, values):
    return rows.set_column(rows.schema.get_field_index(name), name, pa.array(values, rows.schema.field(name).type))


def test_luminance_beyond_32_bits(spark, tmp_path):
    events = pq.read_table(f"{SF}/events.parquet").slice(0, 60)
    ids = [first + i for first in (429_490, 858_990, 6_000_000, 400_000_000) for i in range(15)]
    against_sql(spark, tmp_path, "metadata_units", events=with_column(events, "event_id", ids))


def test_metadata_of_repeated_events(spark, tmp_path):
    events = pq.read_table(f"{SF}/events.parquet").slice(0, 24)
    against_sql(spark, tmp_path, "metadata_units", events=pa.concat_tables([events, events]))


def documents(*rows):
    kinds = {"source": pa.string(), "doc_id": pa.int64(), "text": pa.string()}
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})


def test_units_of_documents_that_share_an_id(spark, tmp_path):
    long, longer = "x" * 3000, "y" * 5000
    rows = [("a", 1, long), ("a", 1, longer), ("a", 1, longer), ("a", 2, "one"), ("b", 1, "two"), ("a", 5, long), ("a", 5, "three"), (None, 5, longer), (None, 5, long), ("b", 10, longer)]
    against_sql(spark, tmp_path, "sql_units", documents=documents(*rows))


def test_units_without_text_or_id(spark, tmp_path):
    long = "z" * 2398
    rows = [("a", 0, ""), ("a", 1, long), ("a", 2, ""), ("a", 3, None), ("a", 5, ""), ("a", 5, long), ("a", None, long), ("a", None, "w" * 4000), ("b", None, ""), ("b", 7, "v")]
    against_sql(spark, tmp_path, "sql_units", documents=documents(*rows))


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    S.register(spark)
    rows = spark.range(1200).selectExpr("cast(id % 300 as string) as file", "id", "cast(id % 7 as int) as type", "0 as temporal_id", "0 as spatial_id", "cast(repeat('x', cast(id % 200 as int)) as binary) as payload", "id as temporal_unit")
    for name, source in (("annexb_units", S.AnnexB), ("low_overhead_units", S.LowOverhead)):
        path = f"{tmp_path}/{name}"
        rows.coalesce(1).sortWithinPartitions("file", "id").write.format(name).mode("append").save(path)
        (tmp_path / name / "1-faulty").with_suffix(source.suffix).write_bytes(b"\xff\xff")
        found = spark.read.format(name).load(path)
        assert found.rdd.getNumPartitions() <= 8
        assert sorted((r.type, r.size) for r in found.filter("error is null").collect()) == sorted((i % 7, i % 200) for i in range(1200)) and found.filter("error is not null").count() == 1
        parts = [S.Part(f"{k}", 0, size, (0, 0), None) for k, size in enumerate([1 << 28, 5, 1 << 19, 1 << 18, 1 << 19, 0, 1 << 27])]
        assert [[p.path for p in b.parts] for b in S.bundled(parts, S.PART)] == [["0"], ["1", "2", "3", "4", "5"], ["6"]]
    with monkeypatch.context() as m:
        m.setattr(S, "_Source", None)  # the driver opens none of them
        assert len(S._Reader(S.AnnexB, None, {"path": f"{tmp_path}/annexb_units"}).partitions()) <= 8


def test_nearest_of_many_different_values_takes_steps_in_proportion(spark, tmp_path):
    n = 60_000
    customers = pa.table({"c_custkey": pa.array(range(n), pa.int64()), "c_nationkey": pa.array([int(k % 50 == 0) for k in range(n)], pa.int32()), "c_acctbal": pa.array([(k * 7919 % n) / 100 for k in range(n)])})
    suppliers = pa.table({"s_nationkey": pa.array([0, 0, 1, 2], pa.int32()), "s_acctbal": [300.0, 300.25, -5.0, 1.0]})
    against_sql(spark, tmp_path, "sweep_nearest", customer=customers, supplier=suppliers)
    plan = registry.QUERIES["sweep_nearest"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan


def test_frames_of_any_size_and_rows_without_one(spark, tmp_path, monkeypatch):
    rows = [("a/b", 3, "x" * 3000), ("a_b", 3, "y"), ("a/b", 1, ""), ("a/b", 2, None), ("a/b", None, "z"), (None, 0, "w"), ("none", 5, "v"), ("a/b", -4, "u"), ("é" * 200, 1, "t"), ("b", 1, None)]
    rows += [("big", k, f"{k} " * (k * 37 % 900)) for k in range(400)]
    monkeypatch.setattr(registry, "FILE", 10_000)
    against_sql(spark, tmp_path, "ivf_roundtrip", documents=documents(*rows))
    plan = registry.QUERIES["ivf_roundtrip"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
