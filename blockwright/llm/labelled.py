"""Which rows may be among some keys: a map of bits of a fixed size, so that most other rows need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map; it has at most BITS / 8 bytes, whatever the keys are.
BITS = 1 << 26

_BIT = "shiftright(cast(conv(hex(substring(_map, cast(bitmap_bit_position(_pos) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(_pos) % 8 as int)) & 1 = 1"


def _joined(docs: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    pos = (F.pmod(F.xxhash64(key), F.lit(BITS)) + 1).alias("_pos")
    maps = keys.select(pos).groupBy(F.expr("bitmap_bucket_number(_pos)").alias("_at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_pos))").alias("_map"))
    return docs.select("*", pos).join(F.broadcast(maps), F.expr(f"bitmap_bucket_number(_pos) = _at and {_BIT}"), how).drop("_pos")


def maybe_labelled(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key may be one of ``keys``: all that are, and the few whose bit is set by another key."""
    return _joined(docs, keys, key, "left_semi")


def never_labelled(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All other rows of ``docs``."""
    return _joined(docs, keys, key, "left_anti")
