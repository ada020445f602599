"""Dropping listed keys from a wide table without shuffling the rows that stay.

The listed keys become a bitmap over a hash prefix. Its size follows the number of keys up to
``MOST_BITS``, so what is broadcast never exceeds ``MOST_BITS / 8`` bytes. Rows whose bit is clear
are surely not listed and pass where they are; the few others are compared with the list in
full, by a merge that may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB at most are broadcast.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 26
#: Bits per key while there is room: one row in so many is compared in vain.
SPARSE = 64
#: Bits of one bitmap value.
_PAGE = 1 << 15


def without(df: DataFrame, key: Column, keys: DataFrame, n_keys: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in the one column of ``keys`` (``n_keys`` rows).

    A null key is never listed. ``df`` is read twice, so it should be a table; no column of
    ``df`` is named ``__key``, ``__page`` or ``__bits``.
    """
    if not n_keys:
        return df
    listed = keys.toDF("listed").filter("listed is not null")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SPARSE * n_keys - 1).bit_length()))
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    at = listed.select(place(F.col("listed")).alias("at"))
    pages = at.groupBy(F.shiftright("at", 15).alias("__page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(_PAGE - 1))).alias("__bits"))
    keyed = df.withColumn("__key", key)
    spot = place(F.col("__key"))
    marked = keyed.join(F.broadcast(pages), F.shiftright(spot, 15) == pages["__page"], "left")
    within = spot.bitwiseAND(F.lit(_PAGE - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(within, 3) + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.col("__key").isNotNull() & (byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), within.bitwiseAND(F.lit(7)))) != 0), F.lit(False))
    sure = marked.filter(~maybe).select(*[f"`{c}`" for c in df.columns])
    rest = marked.filter(maybe).join(listed.hint("merge"), F.col("__key") == F.col("listed"), "left_anti")
    return sure.unionByName(rest.select(*[f"`{c}`" for c in df.columns]))
