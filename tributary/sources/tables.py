"""Table loaders, and the views of them that stand in for media data.

The tables hold no video. Packets, blocks, rate points and clips are derived from them by fixed
rules, so that the operators have deterministic input that DuckDB can derive in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST_SEQ = 65530


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent packets: a stream per user, sequence numbers that wrap early, receive time, size."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    ext = F.row_number().over(order).cast("long") - 1 + FIRST_SEQ
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ssrc"), "event_id", ext.alias("ext_seq"), F.pmod(ext, F.lit(65536)).alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("recv_us"), F.floor(F.col("value") * 10).cast("long").alias("size"), "event_type",
    )


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that were not lost on the way."""
    return packets(spark, sf_dir).filter("event_id % 13 <> 5")


def lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ssrc, seq) of the packets that were lost."""
    return packets(spark, sf_dir).filter("event_id % 13 = 5").select("ssrc", F.col("ext_seq").alias("seq"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received packets in disorder, some of them twice; ``arrival`` orders them."""
    copies = F.when(F.col("event_id") % 17 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = received(spark, sf_dir).withColumn("copy", F.explode(copies))
    return rows.withColumn("arrival", (F.col("event_id") + (F.col("event_id") % 4) * 2) * 2 + F.col("copy"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitstream units: type and temporal and spatial layer."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 16).alias("type"), (F.col("user_id") % 4).alias("t"), (F.col("user_id") % 3).alias("s"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 blocks of samples 0..255, one per vector."""
    sample = lambda x: F.least(F.greatest(F.round(x.cast("double") * 255 + 128).cast("int"), F.lit(0)), F.lit(255))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", sample).alias("q"))


def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block and the one after it, its reference."""
    rows = blocks(spark, sf_dir)
    return rows.select("vec_id", F.col("q").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("b")), "vec_id")


def rate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and metric of each (clip, encoder, target)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("o_orderpriority").alias("clip"), F.col("l_returnflag").alias("encoder"), F.col("l_linenumber").alias("target")).agg(
        F.sum("l_extendedprice").alias("rate"), F.round(F.avg("l_quantity"), 6).alias("metric"))


#: The same views for DuckDB, as common table expressions.
PACKETS = """pk as (select user_id as ssrc, event_id, row_number() over (partition by user_id order by event_id) - 1 + 65530 as ext_seq,
  (row_number() over (partition by user_id order by event_id) - 1 + 65530) % 65536 as seq, epoch_us(ts) as recv_us, cast(floor(value * 10) as bigint) as size, event_type from events),
rx as (select * from pk where event_id % 13 <> 5),
lost as (select ssrc, ext_seq as seq from pk where event_id % 13 = 5),
arr as (select *, (event_id + (event_id % 4) * 2) * 2 + copy as arrival from (select rx.*, unnest(case when event_id % 17 = 3 then [0, 1] else [0] end) as copy from rx))"""
UNITS = "ob as (select event_id, user_id, event_type, event_id % 16 as type, user_id % 4 as t, user_id % 3 as s from events)"
BLOCKS = """bl as (select vec_id, label, list_transform(embedding, lambda x: cast(least(greatest(round(cast(x as double) * 255 + 128), 0), 255) as int)) as q from embeddings),
pr as (select x.vec_id, x.q as a, y.q as b from bl x join bl y on y.vec_id = x.vec_id + 1)"""
POINTS = """rp as (select o_orderpriority as clip, l_returnflag as encoder, l_linenumber as target, sum(l_extendedprice) as rate, round(avg(l_quantity), 6) as metric
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3)"""
