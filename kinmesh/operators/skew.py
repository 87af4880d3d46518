"""Joins that stand up to hot keys, and bitmaps of keys that keep rows without a partner out of a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.storage import stash

#: A hot key has more than one in so many of all rows, so there are fewer hot keys than this.
MOST_HOT = 20_000
#: A bitmap has so many parts of 32,768 bits: 8 MB, whatever it is made of.
PARTS, BITS = 2048, 32_768


def join_hot(rows: DataFrame, side: DataFrame, on: Sequence[str], *, n: str = "n", least: int = 10_000, how: str = "inner") -> DataFrame:
    """`rows` joined with `side`, which has one row of fixed size for each key, with the key's count `n` among the rows.

    Keys of more than `least` rows and more than one in MOST_HOT of them are broadcast, which their number bounds, and
    the rows that have them stay where they are; all others meet by a shuffle.  Both inputs are read more than once.
    A left join needs keys that are not null, as null keys are one key to a shuffle.
    """
    total = side.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    bound = max(least, total // MOST_HOT)
    hot = side.where(F.col(n) > bound)
    if hot.isEmpty():
        return rows.join(side, list(on), how)
    cold = rows.join(F.broadcast(hot.select(*on)), list(on), "left_anti")
    return rows.join(F.broadcast(hot), list(on)).unionByName(cold.join(side.where(F.col(n) <= bound), list(on), how))


def _place(on: Sequence[str]) -> tuple[Column, Column]:
    h = F.hash(*on)
    return F.pmod(h, F.lit(PARTS)), F.pmod(F.shiftright(h, 11), F.lit(BITS)).cast("long")


def key_bitmap(keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """A bitmap of the keys' hashes, for within(); the columns must have the same types there."""
    part, bit = _place(on)
    return stash(keys.select(part.alias("__part"), bit.alias("__bit")).groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits")), "bitmap")


def within(rows: DataFrame, bits: DataFrame, on: Sequence[str], name: str = "__within") -> DataFrame:
    """The rows with a boolean column: whether the bitmap may hold the row's key.  False is certain, true is not."""
    part, bit = _place(on)
    met = rows.withColumn("__part", part).join(F.broadcast(bits), "__part", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    return met.withColumn(name, hit).drop("__part", "__bits")
