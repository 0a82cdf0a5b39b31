"""Row bitmaps: the columns of a row as bits of built-in bitmap buckets, a compact form of dense relations.

A bucket holds 32,768 ids, so a relation takes 4 KB for each row and bucket that has a cell, however
many cells these are, and unions of rows are one ``bitmap_or_agg``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids in a bucket, and bits in a byte.
BUCKET, BYTE = 32_768, 8


def to_bitmaps(pairs: DataFrame) -> DataFrame:
    """row, bucket, bits from distinct or repeated pairs (row, col) of non-negative ids."""
    at = F.col("col") + 1  # the built-in numbering puts 0 into a bucket of its own
    return pairs.groupBy("row", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def union(bitmaps: DataFrame) -> DataFrame:
    """One bitmap for each row and bucket."""
    return bitmaps.groupBy("row", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """The Boolean product of pairs ``left`` with bitmaps ``right``, as bitmaps."""
    mid = right.select(F.col("row").alias("mid"), "bucket", "bits")
    met = left.join(mid, left["col"] == mid["mid"])
    return union(met.select("row", "bucket", "bits"))


def cardinality(bitmaps: DataFrame) -> DataFrame:
    """The number of pairs as ``n``, without making them."""
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n"))


def to_pairs(bitmaps: DataFrame) -> DataFrame:
    """The pairs (row, col) of bitmaps, without Python: their non-zero bytes, then the bits of these."""
    pieces = F.split(F.hex("bits"), r"(?<=\G.{2})")  # two hex digits each
    found = bitmaps.select("row", "bucket", F.posexplode(pieces).alias("byte", "digits")).where("digits != '00' AND digits != ''")
    value = F.conv("digits", 16, 10).cast("int")
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BYTE - 1)), lambda k: F.col("value").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) > 0))
    rows = found.select("row", "bucket", "byte", value.alias("value")).select("row", "bucket", "byte", bit.alias("bit"))
    return rows.select("row", ((F.col("bucket") - 1) * BUCKET + F.col("byte") * BYTE + F.col("bit")).cast("long").alias("col"))
