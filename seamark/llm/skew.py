"""Joins of rows with their groups where one group may hold much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot beyond this many rows and one part in this many of all rows.
HOT_ROWS, HOT_GROUPS = 1000, 1000
#: Bits of the bitmap of keys.
KEY_BITS = 26


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, inner: bool = False, hot_rows: int | None = None) -> DataFrame:
    """``rows`` with the columns of their group, null where ``groups`` has none (with ``inner``: left out).

    ``groups`` has one row per key, with the number of the group's rows in
    ``size``. Groups of more than ``total / HOT_GROUPS`` rows are fewer than
    ``HOT_GROUPS``, so these are broadcast and their rows stay where they are;
    the rest is joined by a shuffle. A group is never hot with fewer rows than
    ``hot_rows`` (``HOT_ROWS`` if not given).
    """
    limit = max(HOT_ROWS if hot_rows is None else hot_rows, total // HOT_GROUPS)
    if total <= limit:  # no group can be hot
        return rows.join(groups, keys, "inner" if inner else "left")
    hot = groups.where(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(groups, keys, "inner" if inner else "left")
    stay = rows.join(F.broadcast(hot), keys)
    move = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(size) <= limit), keys, "inner" if inner else "left")
    return stay.unionByName(move)


def with_maybe(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``groups`` has no such ``key``.

    By a bitmap of ``2**KEY_BITS`` bits, 8 MB at any data size, so that rows
    without a group need not be shuffled to find that out.
    """

    def place(column: str):
        return F.pmod(F.xxhash64(column), F.lit(1 << KEY_BITS)) + 1

    bits = groups.groupBy(F.bitmap_bucket_number(place(key)).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(key))).alias("_bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, _bit) & 1") == 1
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(place(key))).join(F.broadcast(bits), "_bucket", "left")
    marked = marked.withColumns({"_byte": byte, "_bit": (at % 8).cast("int")})
    return marked.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_bucket", "_bits", "_byte", "_bit")
