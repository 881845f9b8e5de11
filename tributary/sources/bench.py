"""Benchmark files: clip manifests, metric logs, result tables, raw video and length-prefixed records.

Faults are data: a row that breaks a rule keeps its place and says why in ``error``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.sources.containers import _le, _scan, _take, ivf_frames, joined_bytes

# Names that a manifest's columns go by.
COLUMNS = {
    "clip": ("clip", "name"), "input": ("input",), "width": ("width",), "height": ("height",), "frames": ("frames",), "fps": ("fps",), "pix_fmt": ("pix_fmt", "pixfmt", "pixel_format"), "bit_depth": ("bit_depth", "bitdepth", "input_bit_depth"),
    "chroma": ("chroma", "chroma_format"), "sha256": ("sha256", "source_sha256", "input_sha256"), "source_id": ("source_id", "source"), "source_url": ("source_url", "url"), "source_license": ("source_license", "license"), "category": ("category", "content_category"),
}
REQUIRED = ("input", "width", "height", "frames")
# The columns of a result row, in order.
RESULT = (
    "clip", "width", "height", "frames", "fps", "encoder", "target_bps", "actual_bps", "encode_fps", "encode_wall_sec", "cpu_user_sec", "cpu_system_sec", "cpu_total_sec", "observed_parallelism", "bytes", "psnr_avg", "ssim_all", "xpsnr_y", "vmaf", "status", "error",
)


def read_manifest(spark: SparkSession, path: str, default_fps: int = 30) -> DataFrame:
    """The clips of the manifests under ``path``, with their row numbers in a single file's order."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True)
    return clips(rows.withColumn("_row", F.monotonically_increasing_id() + 2), "_row", default_fps)


def clips(rows: DataFrame, row: str, default_fps: int = 30) -> DataFrame:
    """One row per manifest row: its columns under one name each, defaults put in, and the first fault in ``error``.

    Sizes are even and at least 16; a name is the clip's, else the last part of its input, else made
    from the row. The second row of a name, or of a folder name made from it, is a fault.
    """
    named = {c.strip().lower(): c for c in rows.columns if c != row}
    absent = [c for c in REQUIRED if c not in named]
    if absent:
        raise ValueError(f"manifest without columns {', '.join(absent)}")

    def text(field: str) -> Column:
        found = [named[a] for a in COLUMNS[field] if a in named]
        return F.coalesce(F.trim(F.col(f"`{found[0]}`").cast("string")), F.lit("")) if found else F.lit("")

    def positive(value: Column) -> Column:
        return F.when(value.rlike("^[+]?[0-9]+$") & (F.regexp_replace(value, r"^\+", "").try_cast("int") > 0), F.regexp_replace(value, r"^\+", "").try_cast("int"))

    name = F.when(text("clip") != "", text("clip")).when(text("input") != "", F.regexp_extract(text("input"), "([^/]*)/*$", 1)).otherwise(F.concat(F.lit("clip"), F.col(row).cast("string")))
    out = rows.select(
        F.col(row).alias("row"), name.alias("clip"), text("input").alias("input"), *[positive(text(f)).alias(f) for f in ("width", "height", "frames")],
        F.when(text("fps") == "", default_fps).otherwise(positive(text("fps"))).alias("fps"), (text("fps") != "").alias("fps_given"), F.when(text("bit_depth") == "", 0).otherwise(positive(text("bit_depth"))).alias("bit_depth"),
        *[text(f).alias(f) for f in ("pix_fmt", "chroma", "sha256", "source_id", "source_url", "source_license", "category")],
    )
    out = out.withColumn("folder", F.when(F.col("clip") == "", "clip").otherwise(F.regexp_replace("clip", "[^A-Za-z0-9._-]", "_")))
    first = lambda *keys: F.min("row").over(Window.partitionBy(*keys))
    error = None
    for field in ("width", "height", "frames", "fps", "bit_depth"):
        fault = F.concat(F.lit(f"{field} is not a positive integer"))
        error = F.when(F.col(field).isNull(), fault) if error is None else error.when(F.col(field).isNull(), fault)
    error = error.when((F.col("width") < 16) | (F.col("height") < 16) | (F.col("width") % 2 != 0) | (F.col("height") % 2 != 0), "frame size is not even and at least 16")
    error = error.when(first("clip") < F.col("row"), "clip name is repeated").when(first(F.lower("folder")) < F.col("row"), "folder name collides")
    return out.withColumn("error", error)


def frame_values(lines: DataFrame, line: str, pattern: str) -> DataFrame:
    """The lines of a metric log that have a frame number (``n:``) and a value: frame, from 0, value, and infinite."""
    raw = F.regexp_extract(line, pattern, 1)
    number = F.regexp_extract(line, r"\bn:\s*([0-9]+)", 1)
    rows = lines.withColumn("_n", number.try_cast("int")).withColumn("_v", raw).filter((F.col("_v") != "") & F.col("_n").isNotNull())
    infinite = F.lower("_v") == "inf"
    return rows.withColumn("frame", F.greatest(F.col("_n") - 1, F.lit(0))).withColumn("value", F.when(~infinite, F.col("_v").try_cast("double"))).withColumn("infinite", infinite).drop("_n", "_v", line)


def contiguous(values: DataFrame, keys: list[str], expected: Column) -> DataFrame:
    """Whether the frames of each group are just 0 to ``expected`` - 1, and the fault if not."""
    out = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frame").alias("different"), F.min("frame").alias("low"), F.max("frame").alias("high")).withColumn("expected", expected)
    error = F.when(F.col("n") != F.col("expected"), "count").when((F.col("low") < 0) | (F.col("high") >= F.col("expected")), "range").when(F.col("different") != F.col("n"), "repeated")
    return out.select(*keys, "n", error.alias("error"))


def pooled_mean(json: Column, expected: Column, metric: str = "vmaf") -> dict[str, Column]:
    """The pooled mean of a metric report and its fault: no report, another number of frames, or no mean."""
    found = F.from_json(json, "frames array<string>, pooled_metrics map<string, map<string, double>>")
    mean = F.try_element_at(F.try_element_at(found["pooled_metrics"], F.lit(metric)), F.lit("mean"))
    size = F.coalesce(F.size(found["frames"]), F.lit(0))
    sound = json.rlike(r"^\s*\{[\s\S]*\}\s*$")
    error = F.when(json.isNull() | ~sound, "no report").when((expected > 0) & (size != expected), "frame count").when(mean.isNull(), "no mean")
    return {"mean": F.when(error.isNull(), mean), "error": error}


def benchmark_lines(lines: DataFrame, line: str) -> DataFrame:
    """The rows of a benchmark log: name, cpus, and its measurements as (value, unit). A count of processors that is zero or no int makes a line none."""
    fields = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    token = F.get(fields, 0)
    shape = r"^(Benchmark.+)-([0-9]+)$"
    rest = F.slice(fields, 3, F.greatest(F.size(fields), F.lit(1)))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(rest) - 2, F.lit(0))), lambda i: (i % 2 == 0) & (F.size(rest) >= 2)), lambda i: F.struct(F.get(rest, i).try_cast("double").alias("value"), F.get(rest, i + 1).alias("unit")))
    rows = lines.withColumn("_f", token).filter(F.col("_f").rlike(shape))
    return rows.select(*[c for c in lines.columns if c != line], F.regexp_extract("_f", shape, 1).alias("name"), F.regexp_extract("_f", shape, 2).try_cast("int").alias("cpus"), pairs.alias("measures")).filter("cpus > 0")


def benchmark_rows(lines: DataFrame, line: str) -> DataFrame:
    """Samples and the different processor counts of each benchmark."""
    return benchmark_lines(lines, line).groupBy("name").agg(F.count(F.lit(1)).alias("samples"), F.array_sort(F.collect_set("cpus")).alias("cpus"))


def result_line(row: dict[str, Column]) -> Column:
    """A result row as a line of a comma-separated file."""
    return F.to_csv(F.struct(*[row.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in RESULT]))


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as comma-separated files with a header."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in RESULT]).write.csv(path, header=True)


# The columns of an encoder's statistics, in order.
STATS = (
    "clip", "width", "height", "frames", "fps", "encoder", "target_bps", "actual_bps", "encoded_frames", "keyframes", "inter_frames", "tiles", "partition_decisions", "blocks", "inter_blocks", "intra_blocks", "skip_blocks", "coded_blocks",
    "compound_blocks", "split_tx_blocks", "single_tx_blocks", "luma_txbs", "primary_last", "primary_golden", "block_8x8", "block_16x16", "block_32x32", "block_64x64", "block_16x8", "block_8x16", "block_32x16", "block_16x32",
    "tx_dct_dct", "tx_adst_dct", "tx_dct_adst", "tx_adst_adst", "tx_idtx", "non_dct_txbs", "status", "error",
)


def stats_line(row: dict[str, Column]) -> Column:
    """A row of statistics as a line of a comma-separated file; what isn't given is empty."""
    return F.to_csv(F.struct(*[row.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in STATS]))


def write_stats(rows: DataFrame, path: str) -> None:
    """Statistics as comma-separated files with a header."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in STATS]).write.csv(path, header=True)


def flattened(rows: DataFrame, counters: dict[str, int]) -> DataFrame:
    """Arrays of counters as columns of their own, named by the array and the place."""
    keys = [c for c in rows.columns if c not in counters]
    return rows.select(*keys, *[F.get(F.col(c), F.lit(i)).alias(f"{c}_{i}") for c, n in counters.items() for i in range(n)])


def metadata_json(rows: DataFrame, keys: list[str], clip: list[str], most: int = 100_000) -> DataFrame:
    """A document per group of keys: its keys, and its clips in order; a group of more than ``most`` clips has several, one behind the other."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*clip)) - 1
    listed = F.array_sort(F.collect_list(F.struct(*clip)))
    parts = rows.withColumn("_part", F.floor(place / most)).groupBy(*keys, "_part").agg(listed.alias("clips"))
    return parts.select(*keys, F.to_json(F.struct(*keys, "clips")).alias("document"))


def i420_frames(files: DataFrame, width: int, height: int, bytes_per_sample: int = 1, content: str = "content") -> DataFrame:
    """One row per frame of raw files with half-size chroma: frame, y, u and v; one row with ``error`` for a file of another size."""
    keys = [c for c in files.columns if c != content]
    y, c = width * height * bytes_per_sample, (width // 2) * (height // 2) * bytes_per_sample
    whole = y + 2 * c
    n = (F.octet_length(content) / whole).cast("int")
    fault = (F.octet_length(content) % whole != 0) | (n == 0)
    rows = files.withColumn("error", F.when(fault, F.lit("size is not a number of frames"))).withColumn("frame", F.explode(F.when(fault, F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))))
    at = F.col("frame") * whole
    return rows.select(*keys, "frame", F.substring(F.col(content), at + 1, F.lit(y)).alias("y"), F.substring(F.col(content), at + y + 1, F.lit(c)).alias("u"), F.substring(F.col(content), at + y + c + 1, F.lit(c)).alias("v"), "error")


def samples(plane: Column, bytes_per_sample: int = 1) -> Column:
    """The samples of a plane's bytes; those of two bytes have the low one first."""
    n = (F.octet_length(plane) / bytes_per_sample).cast("int")

    def read(digits: Column) -> Column:
        def one(i: Column) -> Column:
            nibbles = [F.call_function("locate", F.substring(digits, i * 2 * bytes_per_sample + k + 1, F.lit(1)), F.lit("0123456789ABCDEF")) - 1 for k in range(2 * bytes_per_sample)]
            return sum((nibbles[2 * k] * 16 + nibbles[2 * k + 1]) * (256**k) for k in range(bytes_per_sample)).cast("int")

        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)

    # the digits are made once a plane
    return F.when(n > 0, F.get(F.transform(F.array(F.hex(plane)), read), F.lit(0))).otherwise(F.array().cast("array<int>"))


def frame_md5(y: Column, u: Column, v: Column, chroma: Column | int, bytes_per_sample: int = 1, bit_depth: int = 8) -> Column:
    """The digest of a picture's visible planes, one behind the other; a picture without chroma counts ``chroma`` neutral samples a plane."""
    samples_ = chroma if isinstance(chroma, Column) else F.lit(chroma)
    middle = F.hex(_le(F.lit(1 << (bit_depth - 1)), bytes_per_sample))
    neutral = F.unhex(F.repeat(middle, samples_.cast("int")))
    return F.when(y.isNotNull(), F.md5(F.concat(y, F.coalesce(u, neutral), F.coalesce(v, neutral))))


def plane_bytes(values: Column, bytes_per_sample: int = 1) -> Column:
    """Samples as the bytes of a plane."""
    return joined_bytes(F.transform(values, lambda x: _le(x, bytes_per_sample)))


def _records(data: bytes) -> Iterator[dict]:
    at, i = 0, 0
    if not data:
        raise ValueError("no payloads")
    while at < len(data):
        size = struct.unpack("<I", _take(data, at, 4, "length"))[0]
        if not size:
            raise ValueError("empty payload")
        yield {"idx": i, "payload": _take(data, at + 4, size, "payload")}
        at, i = at + 4 + size, i + 1


def length_prefixed(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per record of files whose records have four bytes of length, low byte first, before them."""
    return _scan(files, content, "idx int, payload binary", _records)


def record_bytes(payload: Column) -> Column:
    return F.concat(_le(F.octet_length(payload), 4), payload)


def ivf_at(files: DataFrame, wanted: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """The wanted frames (keys, idx) of files: an index of places and sizes is joined, and only those bytes are cut out."""
    index = ivf_frames(files, content).filter("error is null").select(*keys, "idx", "offset", F.octet_length("payload").alias("size"))
    places = index.join(wanted.select(*keys, "idx").distinct(), [*keys, "idx"]).groupBy(*keys).agg(F.collect_list(F.struct("idx", "offset", "size")).alias("places"))
    cut = F.transform("places", lambda p: F.struct(p["idx"].alias("idx"), F.substring(F.col(content), p["offset"].cast("int") + 1, p["size"]).alias("payload")))
    return files.join(places, keys).select(*keys, F.explode(cut).alias("x")).select(*keys, "x.idx", "x.payload")
