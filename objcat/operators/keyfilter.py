"""A bitmap of keys that cuts a large table before anything of it is moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of one bitmap; fixed by Spark's bitmap functions (4 KiB).
PIECE_BITS = 32_768
# 8 MiB for all bitmaps together: with a million keys, one other key in 65 passes; with ten million, one in 7.
FILTER_BITS = 1 << 26


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    """The bitmap a key falls in, and its bit there."""
    hashed = F.xxhash64(key)
    piece = F.pmod(hashed, F.lit(max(1, bits // PIECE_BITS)).cast("long"))
    return piece, F.shiftrightunsigned(hashed, 40).bitwiseAND(F.lit(PIECE_BITS - 1).cast("long"))


def bitmaps(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """(piece, bitmap): one bit set for each key, in at most `bits` / PIECE_BITS rows of 4 KiB, whatever the number of keys."""
    piece, bit = _place(keys[column], bits)
    placed = keys.filter(keys[column].isNotNull()).select(piece.alias("_piece"), bit.alias("_bit"))
    return placed.groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def may_be_in(df: DataFrame, column: str, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of `df` whose column is among the keys, and few others; no row whose key is among them is lost.

    The bitmaps have a fixed largest size, so they go to every task and `df` is cut where it is read: nothing of it crosses a
    shuffle. With more keys than the bits are made for, more other rows pass, which a join on the key removes.
    """
    piece, bit = _place(df[column], bits)
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    is_set = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return df.join(F.broadcast(bitmaps(keys, key, bits)), (piece == F.col("_piece")) & is_set, "left_semi")
