"""Benchmark decontamination by Wu-Manber search for many patterns at once, over words.

The patterns are the windows of the test items. For the patterns of one length, a table gives for a
block of words how far the search may move on: a block that no pattern holds lets it skip nearly a
whole pattern. Where a block ends some pattern, the patterns of that suffix, and of the same first
word, are compared with the text directly.

Patterns are searched in blocks of bounded size, each sent to all tasks; a larger benchmark takes
more passes, so nothing that grows with it is held at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm.native import let, running
from tributary.llm.scratch import keyed_by, written

#: A block of patterns has about so many windows and bytes at most.
BLOCK_WINDOWS, BLOCK_BYTES = 100_000, 16 << 20

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of digits, letters a-z and all characters beyond ASCII, with A-Z lower-cased."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    """Each window of ``window`` words, or the whole of fewer words, joined by spaces."""
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


class _Length:
    """Search tables for the patterns of one length, in words."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, dict[tuple[bytes, ...], int]]] = {}

    def add(self, words: tuple[bytes, ...], number: int) -> None:
        for end in range(self.block, self.length + 1):
            block = words[end - self.block : end]
            self.shift[block] = min(self.shift.get(block, self.skip), self.length - end)
        self.buckets.setdefault(words[-self.block :], {}).setdefault(words[0], {})[words] = number

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of each occurrence."""
        length, skip, shift, buckets, block = self.length, self.skip, self.shift.get, self.buckets, self.block
        end, n = length, len(words)
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            move = shift(key, skip)
            if move:
                end += move
                continue
            same = buckets[key].get(words[end - length])
            if same is not None:
                number = same.get(tuple(words[end - length : end]))
                if number is not None:
                    yield end - length, number
            end += 1


class WuManber:
    """Patterns of any lengths; finds all occurrences in a list of words."""

    def __init__(self, patterns: list[bytes]):
        lengths: dict[int, _Length] = {}
        for number, pattern in enumerate(patterns):
            words = tuple(pattern.split(b" "))
            lengths.setdefault(len(words), _Length(len(words))).add(words, number)
        self.lengths = [lengths[k] for k in sorted(lengths)]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans (start, end) of words inside occurrences, and the patterns that occur."""
        found, spans = set(), []
        for table in self.lengths:
            for start, number in table.search(words):
                found.add(number)
                if spans and spans[-1][0] <= start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], start + table.length)
                else:
                    spans.append([start, start + table.length])
        return merged((a, b) for a, b in spans), found


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pattern_rows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, pattern) for each window of each item."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = sorted(windows_of(words_of(text), window))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.string()), pa.array(rows, pa.binary())], names=["item", "pattern"])

    rows = benchmark.select(F.col(id_col).cast("string"), text_col).filter(F.col(id_col).isNotNull()).mapInArrow(build, "item string, pattern binary")
    return rows.distinct()


class _Patterns:
    """Patterns as they are sent to all tasks; a worker builds the search tables once."""

    def __init__(self, patterns: list[bytes]):
        self.patterns, self.tables = patterns, None

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        if self.tables is None:
            self.tables = WuManber(self.patterns)
        spans, found = self.tables.search(words)
        return spans, sorted(found)

    def __getstate__(self) -> dict:
        return {"patterns": self.patterns, "tables": None}


def _search(docs: DataFrame, patterns: list[bytes]) -> DataFrame:
    """(id, name, n_words, spans, hits) of every row of (id, name, text), for one block of patterns; hits are numbers of patterns."""
    shared = docs.sparkSession.sparkContext.broadcast(_Patterns(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, all_spans, hits = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                spans, found = known.search(words)
                n.append(len(words))
                all_spans.append([{"start": a, "end": b} for a, b in spans])
                hits.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(all_spans, _SPANS), pa.array(hits, pa.list_(pa.int32()))], names=["id", "name", "n_words", "spans", "hits"])

    kind = docs.schema["name"].dataType.simpleString()
    return docs.mapInArrow(run, f"id long, name {kind}, n_words long, spans array<struct<start:long,end:long>>, hits array<int>")


def _merged_spans(parts: Column) -> Column:
    """Spans of several searches, in order, those that touch or overlap made one."""

    def joined(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(-1).cast("long"))

        def opened(e: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["start"] > F.get(e, i))
            return let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i)["start"].alias("start"), F.get(e, F.coalesce(F.get(f, k + 1), F.size(s))).alias("end"))))

        return let(ends, opened)

    return let(F.array_sort(F.flatten(parts)), joined)


def _windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame, int]:
    """The different patterns (pattern, block, number), the items that have them (item, pattern), and the number of blocks."""
    pairs = written(_pattern_rows(benchmark, item_col, text_col, window), "pairs")
    patterns = pairs.select("pattern").distinct()
    size = patterns.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("pattern")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_WINDOWS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    numbers = F.row_number().over(Window.partitionBy("block").orderBy("pattern")) - 1  # of one block
    return written(patterns.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks))).withColumn("number", numbers), "patterns"), pairs, blocks


def _found(docs: DataFrame, patterns: DataFrame, blocks: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(id, name, n_words, spans) of every row under a number of its own, and what each block found: (id, block, hits) beside others."""
    named = docs.select(F.monotonically_increasing_id().alias("id"), F.col(id_col).alias("name"), F.col(text_col).alias("text"))

    def block_of(k: int) -> list[bytes]:
        return [bytes(r["pattern"]) for r in patterns.filter(F.col("block") == k).orderBy("number").collect()]

    if blocks == 1:
        part = written(_search(named, block_of(0)).withColumn("block", F.lit(0)), "found")
        return part.select("id", "name", "n_words", "spans"), [part]
    rows = written(named, "searched")
    parts = []
    for k in range(blocks):
        found = _search(rows, block_of(k)).withColumn("block", F.lit(k))
        # the first block's rows bring the name and the number of words of every text
        parts.append(written(found if k == 0 else found.filter(F.size("hits") > 0), "found"))
    whole = reduce(DataFrame.unionByName, [p.select("id", "spans") for p in parts]).groupBy("id").agg(_merged_spans(F.collect_list("spans")).alias("spans"))
    return parts[0].select("id", "name", "n_words").join(whole, "id"), parts


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Benchmark windows in documents: id, n_words, spans (of words, end exclusive) and items per row.

    ``items`` are the ids, as sorted strings, of the items of which a window occurs. Null and empty
    texts have no words; an item without words or without an id has no windows; a shorter item is
    one window as a whole. Repeated items count once. One row comes back for each input row, however
    often its id occurs; an empty table gives an empty one. A very long text is searched whole. Other columns aren't read.

    What goes to the tasks are the different windows, in blocks of bounded size; the items that share a window
    stay in a table, which only the hits are joined with. Beyond one block the rows are written once, and each
    block scans them.
    """
    patterns, pairs, blocks = _windows(benchmark, item_col, item_text_col, window)
    found, parts = _found(docs, patterns, blocks, id_col, text_col)
    hits = reduce(DataFrame.unionByName, [p.select("id", "block", F.explode("hits").alias("number")) for p in parts])
    postings = written(pairs.join(patterns, "pattern").select("block", "number", "item"), "postings")
    items = hits.join(postings, ["block", "number"]).select("id", "item").distinct().groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = found.join(items, "id", "left")
    return out.select(F.col("name").alias(id_col), "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, share: float = 0.0) -> DataFrame:
    """The rows of which at most ``share`` of the words lie in benchmark windows, with all columns as they were.

    Each row is judged by its own text: null and repeated ids are rows like any other, so ``id_col``
    decides nothing.
    """
    key = keyed_by(docs)
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    patterns, _, blocks = _windows(benchmark, "item_id", "text", window)
    found, _ = _found(rows, patterns, blocks, key, text_col)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    leaked = found.withColumn("n_hit", hit).filter((F.col("n_hit") > 0) & (F.col("n_hit") > F.col("n_words") * share)).select(F.col("name").alias(key))
    return rows.join(leaked, key, "left_anti").select(docs.columns)
