"""Sums of long numpy vectors that tasks emit, merged in levels."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.scratch import materialize

SCHEMA = "part long, chunk int, payload binary"


def to_rows(part: int, vector: np.ndarray, chunk_size: int) -> list[tuple[int, int, bytes]]:
    """The vector as rows of ``SCHEMA``."""
    return [(part, i, zlib.compress(vector[at : at + chunk_size].tobytes(), 1)) for i, at in enumerate(range(0, len(vector), chunk_size))]


def tree_sum(rows: DataFrame, dtype: str, fan: int = 64, most: int | None = None) -> np.ndarray | None:
    """The sum of all tasks' vectors.

    ``fan`` parts are added in one group, level by level, so that no group
    grows with the number of tasks. Only the sum, which is as long as one
    task's vector, comes to the driver; with ``most``, as unsigned 32-bit
    numbers of that size at most.
    """
    width = 0

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for p in sorted(group["payload"]):  # in an order that no shuffle changes
            v = np.frombuffer(zlib.decompress(p), dtype)
            total = v.copy() if total is None else total + v
        if most is not None and width == 1:
            total = np.minimum(total, most).astype("u4")
        return pd.DataFrame({"part": [group["part"].iloc[0]], "chunk": [group["chunk"].iloc[0]], "payload": [zlib.compress(total.tobytes(), 1)]})

    top = rows.agg(F.max("part")).first()[0]
    if top is None:
        return None
    width = top + 1
    while True:
        width = -(-width // fan)
        rows = rows.withColumn("part", F.floor(F.col("part") / fan)).groupBy("chunk", "part").applyInPandas(add, SCHEMA)
        if width == 1:
            break
        rows = materialize(rows, "tree-sum")
    parts = {r["chunk"]: r["payload"] for r in rows.collect()}
    return np.concatenate([np.frombuffer(zlib.decompress(parts.pop(k)), dtype if most is None else "u4") for k in sorted(parts)])
