"""Faults that spread over references: which pictures can't be trusted once some are lost.

What a picture does to the state of the reference slots (sound or not, a bit each) is a map: a refreshed slot is
faulty if the picture is lost or any slot that it refers to is faulty. Such maps compose, so each piece of a stream is
composed on its own, pieces are composed again, and the states are then handed down: the number of rounds
is the logarithm of the length of the longest stream, whatever the references are, and no stream is held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.scans import levels_of, states_before

#: Pictures, or pieces of them, that are composed at once.
PIECE = 256


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k.cast("int"))


def _held(slots: Column) -> Column:
    """Slot numbers as bits."""
    return F.aggregate(slots, F.lit(0), lambda s, k: s.bitwiseOR(_bit(k)))


def _after(rows: Column, state: Column, slots: int) -> Column:
    """The state that a map makes of a state. A map has a mask for each slot: the slots that it depends on, and the bit ``slots`` if it is faulty anyway."""
    known = state.bitwiseOR(F.lit(1 << slots))
    return F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), F.lit(0), lambda s, k: s.bitwiseOR(F.when(F.get(rows, k).bitwiseAND(known) != 0, _bit(k)).otherwise(0)))


def _composed(first: Column, then: Column, slots: int) -> Column:
    """The map that does one and then the other."""

    def row(mask: Column) -> Column:
        held = F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: mask.bitwiseAND(_bit(k)) != 0)
        return F.aggregate(held, mask.bitwiseAND(F.lit(1 << slots)), lambda s, k: s.bitwiseOR(F.get(first, k)))

    return F.transform(then, row)


def spread_faults(pictures: DataFrame, stream: str, picture: str, references: str, refreshes: str, lost: Column, slots: int = 8, piece: int = PIECE) -> DataFrame:
    """Pictures with ``faulty_slots`` (the slots referred to that can't be trusted) and ``faulty``.

    ``picture`` is a whole number from 0 that orders the pictures of a stream, each of which occurs once; ``references`` and ``refreshes`` are arrays
    of slot numbers. A lost picture is faulty and leaves its slots so. A slot that nothing refreshed yet
    is faulty, so a reference that is missing spreads. A picture that shows an existing one refers to its
    slot, and refreshes slots only if that is a key picture. Null arrays are empty. Pictures without a number are left out. The columns of the input come along.
    """
    named = lambda c: F.coalesce(F.col(c), F.array().cast("array<int>"))
    depends = _held(named(references)).bitwiseOR(F.when(F.coalesce(lost, F.lit(False)), 1 << slots).otherwise(0))
    rows = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.when(F.array_contains(named(refreshes), k), depends).otherwise(_bit(k)))
    known = pictures.filter(F.col(picture).isNotNull())
    last = known.agg(F.max(picture)).first()[0] or 0
    maps = known.select(F.col(stream).alias("stream"), F.col(picture).alias("at"), rows.alias("map"))
    same = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), _bit)
    before = states_before(maps, lambda m, s: _after(m, s, slots), lambda m, n: _composed(m, n, slots), same, F.lit((1 << slots) - 1), "int", levels_of(last, piece), piece).select(F.col("stream").alias("_stream"), F.col("at").alias("_at"), "state")
    out = known.join(before, known[stream].eqNullSafe(before["_stream"]) & (known[picture] == before["_at"]))
    bad = F.filter(F.array_distinct(named(references)), lambda k: F.col("state").bitwiseAND(_bit(k)) != 0)
    return out.select(*pictures.columns, F.array_sort(bad).alias("faulty_slots"), (F.coalesce(lost, F.lit(False)) | (F.size(bad) > 0)).alias("faulty"))
