"""Best-fit packing of documents into fixed-length sequences by large-item matching.

A piece longer than a third of the capacity is large: a sequence holds at most
two of them. The plan pairs each large piece, longest first, with the longest
large piece that fits beside it, then lets the smaller pieces, longest first,
go to the sequence with the smallest gap that takes them.

Pieces of one length are interchangeable, so the plan is made on the histogram
of lengths. That has at most ``capacity`` entries at any data size; Spark
counts it, numbers the pieces of each length, and places them by a join with
the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.scratch import materialize
from seamark.llm.tokenizing import encoder


@dataclass(frozen=True)
class Run:
    """Pieces ``first`` to ``last`` (exclusive) of ``length``: ``each`` per sequence from ``sequence`` on, at ``offset``."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def plan_sequences(counts: dict[int, int], capacity: int) -> list[Run]:
    """Where the pieces of each length go. ``counts``: number of pieces by length, 1 to ``capacity``.

    Every step ends a length or splits one group of equal sequences, so time
    and result are bounded by the number of lengths, not of pieces.
    """
    runs: list[Run] = []
    used = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, how many)]
    open_gaps: list[int] = []
    next_sequence = 0

    def add_gap(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    def put(length: int, n: int, sequence: int, each: int, gap: int) -> None:
        runs.append(Run(length, used[length], used[length] + n, sequence, each, capacity - gap))
        used[length] += n

    large = sorted(x for x in counts if 3 * x > capacity and counts[x])
    left = {x: counts[x] for x in large}
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b is not None and b == a and left[a] < 2:
            b = large[at - 1] if at > 0 else None
        if b is None:
            n = left[a]
            put(a, n, next_sequence, 1, capacity)
            add_gap(capacity - a, next_sequence, n)
            left[a] = 0
        else:
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, next_sequence, 1, capacity)
            put(b, n, next_sequence, 1, capacity - a)
            add_gap(capacity - a - b, next_sequence, n)
            left[a] -= n
            left[b] -= n
        next_sequence += n
        large = [x for x in large if left[x]] if not left[a] or (b is not None and not left[b]) else large

    for length in sorted((x for x in counts if 3 * x <= capacity and counts[x]), reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                gap, first, have = capacity, next_sequence, -(-n // (capacity // length))
                next_sequence += have
            else:
                gap = open_gaps[at]
                first, have = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            each = gap // length
            full = min(have, n // each)
            if full:
                put(length, full * each, first, each, gap)
                add_gap(gap - each * length, first, full)
                n -= full * each
            rest = have - full
            if rest and n:
                part = min(n, each)
                put(length, part, first + full, each, gap)
                add_gap(gap - part * length, first + full, 1)
                n -= part
                full, rest = full + 1, rest - 1
            add_gap(gap, first + full, rest)
    return runs


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``, on demand) of every piece.

    A document's ids end with ``end_id``; only documents longer than
    ``capacity`` are cut.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced=False).encode
        end = int(end_id).to_bytes(4, "little")
        step = 4 * capacity

        def table(ids: pa.Array, rows: list[list]) -> pa.RecordBatch:
            out = [ids, pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(rows[5], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            for row, ids, offsets in encode(batch.column(1)):  # a slice of the batch, handed on at once
                rows: list[list] = [[], [], [], [], [], []]
                bounds = offsets.tolist()
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False), row):
                    own = ids[a:b].tobytes() + end
                    for k, at in enumerate(range(0, len(own), step)):
                        part = own[at : at + step]
                        for col, v in zip(rows, (i, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                            col.append(v)
                yield table(batch.column(0).take(pa.array(rows[0], pa.int64())), rows)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``.

    A null or empty text is the end id alone. Repeated rows are packed once
    each. Ids may be null; they only order pieces of equal length. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = materialize(
        token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, keep_ids).withColumn("_part", F.spark_partition_id()),
        "pack-pieces",
    )
    local = materialize(pieces.groupBy("_part", "length").agg(F.count("*").alias("_n")), "pack-lengths")
    counts = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    runs = [(r.length, r.first, r.last, r.sequence, r.each, r.offset) for r in plan_sequences(counts, capacity)]
    plan = spark.createDataFrame(runs, "length long, _first long, _last long, _sequence long, _each long, _offset long")

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    shifts = local.select("_part", "length", (F.sum("_n").over(before) - F.col("_n")).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("_part", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("_own", rank).join(shifts, ["_part", "length"]).withColumn("_rank", F.col("_own") - 1 + F.col("_shift"))
    placed = ranked.join(F.broadcast(plan), "length").where("_rank >= _first and _rank < _last")
    at = F.col("_rank") - F.col("_first")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (at % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences than this."""
    return int(-(-int(np.sum(lengths)) // capacity))
