"""As-of joins: for each row the next row of another table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str], strict: bool = False, width: int = 86_400_000_000) -> DataFrame:
    """``left`` with ``hit``: the first row of ``right`` with equal ``on`` that comes at or after the left row in ``order`` (``strict``: after it); null if there is none.

    Both sides are put in one sequence for each key, and a window carries the
    next right row back, so no pairs are made. A key is cut where the first
    column of ``order``, a whole number, passes a multiple of ``width``; what
    comes first in later stretches is looked up in a table of stretches. So a
    key with much of the table is many groups. Columns of ``order`` may be
    null, which comes first. Null keys meet null keys. Order from the greatest
    down by negating the columns.
    """
    on, order = list(on), list(order)

    def side(df: DataFrame, rank: int, name: str, other: DataFrame, other_name: str) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
        none = F.lit(None).cast(other.schema).alias(other_name)
        stretch = F.floor(F.coalesce(F.col(order[0]), F.lit(0)) / width)
        return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], stretch.alias("_b"), F.lit(rank).alias("_side"), row, none)

    keys = [f"_k{i}" for i in range(len(on))]
    both = side(left, 2 if strict else 0, "l", right, "r").unionByName(side(right, 1, "r", left, "l"))
    latest = [F.col(c).desc_nulls_last() for c in [*(f"_o{i}" for i in range(len(order))), "_side"]]
    ahead = Window.partitionBy(*keys, "_b").orderBy(*latest).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("r", ignorenulls=True).over(ahead)).where("l is not null").select(*keys, "_b", "l", "near")
    # the first right row of each stretch, carried back over the stretches before it
    firsts = side(right, 1, "r", left, "l").groupBy(*keys, "_b").agg(F.min_by("r", F.struct(*[f"_o{i}" for i in range(len(order))])).alias("first"))
    wanted = near.where("near is null").select(*keys, "_b").distinct()
    stretches = wanted.withColumn("first", F.lit(None).cast(right.schema)).unionByName(firsts)
    stretches = stretches.groupBy(*keys, "_b").agg(F.first("first", ignorenulls=True).alias("first"))
    later = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.withColumn("far", F.last("first", ignorenulls=True).over(later)).select(*[F.col(c).alias(f"{c}_") for c in keys], F.col("_b").alias("_b_"), "far")
    same = F.col("_b") == F.col("_b_")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return near.join(carried, same, "left").select("l.*", F.coalesce("near", "far").alias("hit"))
