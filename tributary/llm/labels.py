"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled ids that a classifier is fitted on, at most: the bound of what is sent to all tasks.
LABELLED = 20_000


def labelled(docs: DataFrame, labels: DataFrame, label_cols: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = LABELLED) -> DataFrame:
    """(id, text, labels) of the ``sample`` labelled ids with the least hashes, or of all if there are no more.

    The draw is alike at every size. The drawn ids are few enough to be broadcast, so that no text is
    moved. Of repeated labels the largest counts; rows without an id or without any label are left
    out; each document of a drawn id is a row. Empty tables give an empty one.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.coalesce(*label_cols).isNotNull()).groupBy(id_col).agg(*[F.max(c).alias(c) for c in label_cols])
    drawn = known.orderBy(F.xxhash64(F.lit("label"), id_col), id_col).limit(sample)
    return docs.select(id_col, text_col).join(F.broadcast(drawn), id_col)
