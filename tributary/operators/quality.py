"""Rate and quality analysis: curves, curve differences, run statistics, completeness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.functions.columns import normal_category

POINTS = 4


def curve_pairs(points: DataFrame, anchor: str) -> DataFrame:
    """The anchor's points beside every other encoder's, by clip and target."""
    a = points.filter(F.col("encoder") == anchor).select("clip", "target", F.col("rate").alias("anchor_rate"), F.col("metric").alias("anchor_metric"))
    return points.filter(F.col("encoder") != anchor).join(a, ["clip", "target"]).select("clip", "encoder", "target", F.round("rate", 4).alias("rate"), "metric", F.round("anchor_rate", 4).alias("anchor_rate"), "anchor_metric")


def _fit(prefix: str) -> list[Column]:
    """Coefficients of the least-squares cubic from power sums, by Cramer's rule."""
    s = [F.col(f"{prefix}s{i}") for i in range(7)]
    t = [F.col(f"{prefix}t{i}") for i in range(4)]

    def det(m: list[list[Column]]) -> Column:
        if len(m) == 1:
            return m[0][0]
        out = None
        for k in range(len(m)):
            part = m[0][k] * det([[row[j] for j in range(len(m)) if j != k] for row in m[1:]])
            out = part if out is None else out + part if k % 2 == 0 else out - part
        return out

    normal = [[s[i + j] for j in range(4)] for i in range(4)]
    base = det(normal)
    return [det([[t[i] if j == k else normal[i][j] for j in range(4)] for i in range(4)]) / base for k in range(4)]


def _sums(points: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    x, y = (F.col("metric") - F.col("centre")) / F.col("scale"), F.ln("rate")
    return points.groupBy(*keys, "centre", "scale", "low", "high").agg(
        F.count(F.lit(1)).alias(f"{prefix}n"), *[F.sum(F.pow(x, F.lit(i))).alias(f"{prefix}s{i}") for i in range(7)], *[F.sum(F.pow(x, F.lit(i)) * y).alias(f"{prefix}t{i}") for i in range(4)])


def bd_rate(points: DataFrame, anchor: str) -> DataFrame:
    """Mean rate difference to the anchor at equal quality, in percent.

    Log rate is fitted by a cubic of the metric, centred and scaled over both curves, and the
    difference of the integrals over the common range of metrics is turned into a percentage. Every
    pair of a clip and another encoder has a row with a status: no anchor, too few points on a curve,
    an invalid point (a rate that is not positive, or no number), a repeated metric, no common range,
    or ok.
    """
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))
    sound = F.coalesce(number(F.col("rate")) & number(F.col("metric")) & (F.col("rate") > 0), F.lit(False))
    a = points.filter(F.col("encoder") == anchor).select("clip", "rate", "metric")
    c = points.filter(F.col("encoder") != anchor).select("clip", "encoder", "rate", "metric")

    def judged(curve: DataFrame, of: list[str], p: str) -> DataFrame:
        return curve.groupBy(*of).agg(F.count(F.lit(1)).alias(f"{p}_n"), F.count_if(~sound).alias(f"{p}_bad"), F.count_distinct("metric").alias(f"{p}_different"), F.min("metric").alias(f"{p}_low"), F.max("metric").alias(f"{p}_high"))

    all_ = judged(c, ["clip", "encoder"], "c").join(judged(a, ["clip"], "a"), "clip", "left")
    fault = F.when(F.col("a_n").isNull(), "no anchor").when((F.col("a_n") < POINTS) | (F.col("c_n") < POINTS), "too few points").when((F.col("a_bad") > 0) | (F.col("c_bad") > 0), "invalid point").when((F.col("a_different") < F.col("a_n")) | (F.col("c_different") < F.col("c_n")), "repeated metric")
    low, high = F.greatest("a_low", "c_low"), F.least("a_high", "c_high")
    all_ = all_.withColumn("status", F.coalesce(fault, F.when(high <= low, "no overlap"), F.lit("ok"))).withColumn("low", F.when(F.col("a_n").isNotNull(), low)).withColumn("high", F.when(F.col("a_n").isNotNull(), high))
    ranges = all_.filter("status = 'ok'").select("clip", "encoder", "low", "high", ((F.least("a_low", "c_low") + F.greatest("a_high", "c_high")) / 2).alias("centre"), ((F.greatest("a_high", "c_high") - F.least("a_low", "c_low")) / 2).alias("scale"))
    keys = ["clip", "encoder"]
    both = _sums(c.join(ranges, keys), "c", keys).join(_sums(a.join(ranges, "clip"), "a", keys).drop("centre", "scale", "low", "high"), keys)
    lo, hi = (F.col("low") - F.col("centre")) / F.col("scale"), (F.col("high") - F.col("centre")) / F.col("scale")

    def area(k: list[Column]) -> Column:
        return sum(((F.pow(hi, F.lit(i + 1)) - F.pow(lo, F.lit(i + 1))) * k[i] / (i + 1) for i in range(4)), F.lit(0.0))

    gain = (F.exp((area(_fit("c")) - area(_fit("a"))) / (hi - lo)) - 1) * 100
    gains = both.select("clip", "encoder", F.round(gain, 3).alias("bd_rate"))
    return all_.join(gains, keys, "left").select("clip", "encoder", "low", "high", "bd_rate", "status")


def bd_rate_groups(rates: DataFrame) -> DataFrame:
    """Equal-weight mean over clips, by encoder and over all; a clip that isn't ok makes the group an error."""
    out = rates.groupingSets([("encoder",), ()], "encoder").agg(F.round(F.avg("bd_rate"), 2).alias("mean"), F.count(F.lit(1)).alias("clips"), F.count_if(F.col("status") != "ok").alias("failed"))
    return out.select(F.coalesce("encoder", F.lit("all")).alias("encoder"), F.when(F.col("failed") == 0, F.col("mean")).alias("mean"), "clips", "failed")


def bd_rate_categories(rates: DataFrame, clips: DataFrame) -> DataFrame:
    """Equal-weight means over all clips (``overall``) and over those of each category, by encoder; one that isn't ok makes its group an error.

    ``clips`` has clip and category; categories are taken in lower case with single spaces, and a clip without one
    counts for the whole only.
    """
    named = clips.select("clip", normal_category(F.coalesce("category", F.lit(""))).alias("category")).distinct()
    labels = F.array_compact(F.array(F.lit("overall"), F.when(F.col("category") != "", F.concat(F.lit("category:"), "category"))))
    rows = rates.join(named, "clip").withColumn("label", F.explode(labels))
    out = rows.groupBy("label", "encoder").agg(F.round(F.avg("bd_rate"), 2).alias("mean"), F.count(F.lit(1)).alias("clips"), F.count_if(F.col("status") != "ok").alias("failed"))
    return out.withColumn("mean", F.when(F.col("failed") == 0, F.col("mean")))


#: Buckets of a group's values.
BUCKETS = 1 << 10


def order_statistics(runs: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Minimum, quartiles at n/4, n/2 and 3n/4 of the ordered values (upper median) and maximum.

    Values are counted, equal ones together, in buckets of their group's range; only the buckets that hold a quartile are put
    in order, by their different values. No group is sorted as a whole. Null values aren't counted.
    """
    counted = runs.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    spans = counted.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("size"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    width = F.col("b.high").cast("double") - F.col("b.low").cast("double")
    at = F.when(width > 0, F.least(F.floor((F.col("a.v").cast("double") - F.col("b.low").cast("double")) / width * buckets), F.lit(buckets - 1))).otherwise(0)
    placed = counted.alias("a").join(spans.alias("b"), same).select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.v", "a.n", "b.size", at.alias("bucket"))
    sums = placed.groupBy(*keys, "bucket").agg(F.sum("n").alias("held"), F.first("size").alias("size"))
    ahead = F.sum("held").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("held")  # a row for each bucket
    ranks = F.array(*[F.struct(F.lit(k).alias("q"), F.floor(F.col("size") * k / 4).alias("rank")) for k in (1, 2, 3)])
    wanted = sums.withColumn("ahead", ahead).withColumn("ranks", F.filter(ranks, lambda r: (r["rank"] >= F.col("ahead")) & (r["rank"] < F.col("ahead") + F.col("held")))).filter(F.size("ranks") > 0)
    inside = placed.alias("a").join(wanted.select(*keys, "bucket", "ahead", "ranks").alias("b"), [*same, F.col("a.bucket") == F.col("b.bucket")]).select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.bucket", "a.v", "a.n", "b.ahead", "b.ranks")
    upto = F.col("ahead") + F.sum("n").over(Window.partitionBy(*keys, "bucket").orderBy("v"))
    found = inside.withColumn("upto", upto).select(*keys, "v", F.explode(F.filter("ranks", lambda r: (r["rank"] < F.col("upto")) & (r["rank"] >= F.col("upto") - F.col("n")))).alias("r"))
    quarters = found.groupBy(*keys).agg(*[F.max(F.when(F.col("r.q") == k, F.col("v"))).alias(name) for k, name in ((1, "q1"), (2, "median"), (3, "q3"))])
    out = spans.alias("a").join(quarters.alias("b"), same).select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.low", "b.q1", "b.median", "b.q3", "a.high")
    return out.withColumn("iqr", F.round(F.col("q3") - F.col("q1"), 6))


def nearest(jobs: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """For each job the candidate nearest to its target, ties to values below it and then to the smaller level.

    Jobs and candidates are put in order of values, upwards and downwards, and each job looks at the last candidate before it: no pairs are made,
    and no frame ends behind its row (Spark works such a frame out again for each row). A candidate without a value is none.
    """
    levels = candidates.filter(F.col("value").isNotNull()).groupBy(*keys, F.round(F.col("value").cast("double"), 9).alias("at")).agg(F.min("level").alias("level"))
    both = levels.select(*keys, "at", F.struct("at", "level").alias("here"), F.lit(None).cast(jobs.schema["goal"].dataType).alias("goal")).unionByName(
        jobs.select(*keys, F.round(F.col("goal").cast("double"), 9).alias("at"), F.lit(None).cast(levels.select(F.struct("at", "level").alias("x")).schema["x"].dataType).alias("here"), "goal"))

    def before(order: Column) -> Column:
        return F.last("here", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order, F.col("here").isNull()).rowsBetween(Window.unboundedPreceding, 0))

    found = both.withColumn("below", before(F.col("at").asc())).withColumn("above", before(F.col("at").desc())).filter("goal is not null")
    options = F.filter(F.array("below", "above"), lambda c: c.isNotNull())
    best = F.array_min(F.transform(options, lambda c, i: F.struct(F.round(F.abs(c["at"] - F.col("goal")), 9).alias("gap"), (c["at"] > F.col("goal")).alias("over"), c["level"].alias("level"))))
    return found.withColumn("b", best).filter("b is not null").select(*keys, "goal", "b.level", F.col("b.gap").alias("gap"))


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required keys that are not present."""
    return required.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def deterministic(runs: DataFrame, keys: list[str], digest: Column) -> DataFrame:
    """Whether all runs of a group have one digest."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.count_distinct(digest).alias("digests")).withColumn("same", F.col("digests") <= 1)


def summary_grid(summaries: DataFrame, groups: DataFrame, encoders: list[str], metrics: list[str]) -> DataFrame:
    """Every (clip, encoder, metric) with its summary; one that is missing is an error row."""
    grid = groups.select("clip", F.explode(F.array(*map(F.lit, encoders))).alias("encoder")).withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    found = grid.join(summaries, ["clip", "encoder", "metric"], "left")
    return found.withColumn("status", F.when(F.col("status").isNull(), "missing clip summary").otherwise(F.col("status")))


def parallelism_by_bitrate(jobs: DataFrame, encoder: str, value: Column, order: str) -> DataFrame:
    """The parallelism that the last sound job of each bitrate was seen with."""
    sound = jobs.filter((F.col("encoder") == encoder) & (F.col("status") == "ok")).withColumn("value", value).filter((F.col("value") > 0) & ~F.isnan("value") & (F.col("value") < float("inf")))
    return sound.groupBy("bitrate").agg(F.max_by("value", order).alias("parallelism"))


def accumulated(rows: DataFrame, keys: list[str], counters: str) -> DataFrame:
    """Sums of arrays of counters, place by place."""
    places = rows.select(*keys, F.posexplode(counters).alias("place", "value"))
    return places.groupBy(*keys, "place").agg(F.sum("value").alias("total"))


def decoder_summary(runs: DataFrame, decoder: str, value: str, base: str) -> DataFrame:
    """Upper median of each decoder's runs, and its ratio to that of the base decoder."""
    medians = order_statistics(runs, [decoder], value).select(decoder, "median")
    one = F.max(F.when(F.col(decoder) == base, F.col("median"))).over(Window.partitionBy(F.lit(0)))  # a row per decoder
    return medians.select(decoder, "median", (F.col("median") / one).alias("ratio"))


def run_order(jobs: DataFrame, keys: list[str], passes: int, seed: int) -> DataFrame:
    """Every job once a pass, shuffled within the pass by a digest of seed, pass and job."""
    rows = jobs.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pass").cast("string"), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("pass").orderBy(digest, *keys)))


def shared_paths(artifacts: DataFrame, path: str, label: str) -> DataFrame:
    """Paths that more than one artifact would be written to, with their labels."""
    return artifacts.groupBy(path).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels")).filter("n > 1")
