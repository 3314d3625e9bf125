"""A bitmap of fixed size that tells which rows need not meet a list of keys.

Rows whose bit is not set are surely not in the list, so only the others are
shuffled for the exact join. The bitmap never holds more than ``BITS`` bits,
whatever the list's length, so it may always be broadcast; a longer list lets
more rows through, and the exact join decides as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketclime.session import cut_lineage

BITS = 1 << 22  # 65,536 rows of 64 bits


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """word and mask of the bits that the 64-bit column ``key`` sets; at most ``BITS / 64`` rows."""
    bit = F.pmod(F.col(key), F.lit(BITS))
    words = keys.select(F.floor(bit / 64).cast("int").alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("m"))
    return cut_lineage(words.groupBy("_word").agg(F.bit_or("m").alias("_mask")), "bitmap")


def with_maybe(df: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """Add ``_maybe``: whether ``key`` may be in the list."""
    bit = F.pmod(key, F.lit(BITS))
    named = df.withColumn("_word", F.floor(bit / 64).cast("int")).withColumn("_bit", (bit % 64).cast("int"))
    joined = named.join(F.broadcast(bits), "_word", "left")
    maybe = F.call_function("shiftrightunsigned", F.col("_mask"), F.col("_bit")).bitwiseAND(F.lit(1).cast("long")) == 1
    return joined.withColumn("_maybe", F.coalesce(maybe, F.lit(False))).drop("_word", "_bit", "_mask")
