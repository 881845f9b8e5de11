"""The stateful stream against its batch twin and a plain model."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.sources import tables
from tributary.streaming import state


def play(seqs, slots):
    nxt, lost, held, out = None, False, {}, []
    for s in seqs:
        nxt, lost, done = state.release(nxt, held, lost, s, 1, slots)
        out += done
        assert len(held) <= slots
    return out + state.flush(nxt or 0, held, lost)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.integers(1, 16))
def test_order_and_marks(seqs, slots):
    out = [r[0] for r in play(seqs, slots)]
    assert out == sorted(set(out)) and set(out) <= set(seqs)
    for (a, _, _), (b, _, mark) in zip(play(seqs, slots), play(seqs, slots)[1:], strict=False):
        assert mark == (b != a + 1)


def test_window_holds_back_and_jumps():
    assert [r[0] for r in play([0, 2, 1, 3], 4)] == [0, 1, 2, 3]
    assert play([0, 9], 4) == [(0, 1, False), (9, 1, True)]


def test_stream_equals_batch(spark, tmp_path):
    rows = tables.arrivals(spark, "/root/testdata/sf0.001").select("ssrc", "ext_seq", "size", "arrival")
    ordered = rows.orderBy("arrival").toPandas()
    for i, at in enumerate(range(0, len(ordered), 300)):
        spark.createDataFrame(ordered[at : at + 300]).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    # processing-time timeouts would otherwise run batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.reordered_stream(stream, 8, "1 hour").writeStream.format("memory").queryName("reordered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table("reordered").toPandas().sort_values(["ssrc", "ext_seq"])
    want = state.reordered_batch(rows, 8).toPandas()
    both = want.merge(got, on=["ssrc", "ext_seq"], how="left", suffixes=("", "_s"))
    released = both.dropna()
    assert len(released) == len(got) and len(got) > 0.9 * len(want)
    assert (released["after_loss"] == released["after_loss_s"]).all()


def test_windowed_rates_drop_late_rows(spark, tmp_path):
    events = tables.table(spark, "/root/testdata/sf0.001", "events").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = state.windowed_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("rates").selectExpr("sum(packets)").first()[0] == events.count()
