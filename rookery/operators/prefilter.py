"""Exact semi joins behind a bitmap, so that rows without a partner are not shuffled.

The hashes of the ids become a bitmap of about `BITS_PER_ID` bits per id, in pieces of 4 KB. The pieces are broadcast, each row looks its
own bit up, and only rows whose bit is set go on to the join that decides. The bitmap's size is checked before it is built: beyond
`MOST_BITS` it is not, and all rows are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per id: about a tenth of the other ids share a set bit.
BITS_PER_ID = 10
#: Bits of the largest bitmap that is broadcast, 32 MB.
MOST_BITS = 1 << 28
#: Bits of a piece, as the bitmap functions cut them.
PIECE = 1 << 15


def _number(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def id_bitmap(ids: DataFrame, column: str, bits: int) -> DataFrame:
    """(piece, bits): the pieces of the bitmap that have a bit set."""
    number = _number(F.col(column), bits)
    places = ids.select(F.floor(number / PIECE).alias("piece"), (number % PIECE).alias("bit"))
    return places.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))


def with_hit(df: DataFrame, column: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """`df` with a column `_hit`: whether the row's bit is set. It is for all rows with a partner, and for few others."""
    pieces = F.broadcast(bitmap.toDF("_piece", "_bits"))
    rows = df.withColumn("_number", _number(F.col(column), bits))
    rows = rows.join(pieces, F.floor(F.col("_number") / PIECE) == F.col("_piece"), "left")
    place = (F.col("_number") % PIECE).cast("int")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("_hit", F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))).drop("_number", "_piece", "_bits")


def may_match(df: DataFrame, column: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """The rows whose bit is set: all rows with a partner, and few others."""
    return with_hit(df, column, bitmap, bits).filter("_hit").drop("_hit")


def bitmap_bits(n: int, most_bits: int = MOST_BITS, least_bits: int = BITS_PER_ID) -> int | None:
    """The bits of a bitmap of `n` ids, or None where it would have fewer than `least_bits` for each."""
    if n * least_bits > most_bits:
        return None
    return min(max(PIECE, 1 << max(n * BITS_PER_ID - 1, 1).bit_length()), max(PIECE, most_bits))


def restrict_by_bitmap(df: DataFrame, ids: DataFrame, column: str, most_bits: int = MOST_BITS, least_bits: int = BITS_PER_ID) -> DataFrame:
    """`df` without the rows that surely have no partner in `ids`; counts the ids first. With fewer than `least_bits` bits for each id there is no bitmap."""
    kind = df.schema[column].dataType
    # Equal ids of different types hash differently.
    known = ids.select(F.col(column).cast(kind).alias(column)).filter(F.col(column).isNotNull())
    bits = bitmap_bits(known.count(), most_bits, least_bits)
    return df if bits is None else may_match(df, column, id_bitmap(known, column, bits), bits)
