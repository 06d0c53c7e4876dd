"""Token ids in files of Simple-8b words.

Format ``SMK8``: a dataset is a folder of Parquet files whose rows are blocks,
in ascending order of (``shard``, ``block``); documents follow each other in
ascending id order. A block's ``payload`` holds whole documents:

    header   magic, number of documents, ids, frames, words, escapes
    lengths  u32 per document
    frames   u32 per frame: its first word (a frame is 1024 ids, the last one less)
    words    u64: selector in the top 4 bits, below it as many ids as the
             selector says, lowest first
    escapes  u32 position and u32 id for each id of 2**20 or more, which has
             a 0 in the words

The encoder takes the selector with the most ids that fits. Ids below 2**20
never need the selectors of 30 and 60 bits, so those are for the decoder only.
The document ids stand beside the payload in ``doc_ids``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamark.llm.tokenizing import encoder

# The selectors of Simple-8b as (ids in a word, bits of each).
SELECTORS = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
FRAME = 1024
ESCAPE_BITS = 20
#: The most ids in a word.
_REACH = 240
_COUNTS = np.array([c for c, _ in SELECTORS], np.int64)
_BIT_LENGTH = np.array([x.bit_length() for x in range(1 << ESCAPE_BITS)], np.uint8)
_HEADER = struct.Struct("<4sIQIQI")
_MAGIC = b"SMK8"


def _window_max(bits: np.ndarray, widest: int) -> dict[int, np.ndarray]:
    """The largest of the next ``c`` entries, for every count ``c`` of a selector up to ``widest``."""
    by_width = {1: bits}
    for count in sorted({c for c, _ in SELECTORS if 1 < c <= widest} | {2**k for k in range(1, widest.bit_length())}):
        half = max(w for w in by_width if w <= count // 2 or 2 * w >= count)
        base, shift = by_width[half], count - half
        out = base.copy()
        np.maximum(base[:-shift], base[shift:], out=out[:-shift])
        by_width[count] = out
    return by_width


def pack_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each frame, positions and values of the escapes."""
    n = len(ids)
    rows = -(-n // FRAME)
    big = np.flatnonzero(ids >> ESCAPE_BITS)
    flat = np.zeros(rows * FRAME, np.uint32)
    flat[:n] = ids
    flat[big] = 0
    # zeros after each frame let its last word reach over the end
    grid = np.zeros((rows, FRAME + _REACH), np.uint32)
    grid[:, :FRAME] = flat.reshape(rows, FRAME)
    end = np.full(rows, FRAME)
    if rows:
        end[-1] = n - (rows - 1) * FRAME

    values = grid.reshape(-1)
    widths = _window_max(_BIT_LENGTH[values], _REACH)
    pick = np.zeros(len(values), np.uint8)
    for k in range(len(SELECTORS) - 1, -1, -1):  # few ids first; a selector with more ids that fits replaces it
        count, bits = SELECTORS[k]
        np.copyto(pick, np.uint8(k), where=widths[count] <= bits)

    begins = np.zeros(len(values), bool)
    at = np.arange(rows) * (FRAME + _REACH)
    stop = at + end
    while len(at):
        begins[at] = True
        at = at + _COUNTS[pick[at]]
        more = at < stop
        at, stop = at[more], stop[more]
    starts = np.flatnonzero(begins)
    selector = pick[starts]
    words = selector.astype(np.uint64) << np.uint64(60)
    for k in np.unique(selector).tolist():
        count, bits = SELECTORS[k]
        own = np.flatnonzero(selector == k)
        here, word = starts[own], words[own]
        for j in range(count if bits else 0):
            word |= values[here + j].astype(np.uint64) << np.uint64(j * bits)
        words[own] = word
    first = np.searchsorted(starts, np.arange(rows) * (FRAME + _REACH)).astype(np.uint32)
    return words, first, big.astype(np.uint32), ids[big].astype(np.uint32)


def unpack_ids(words: np.ndarray, first: np.ndarray, n: int, positions: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The ids again; all frames are decoded together, a selector at a time."""
    rows = len(first)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNTS[selector]
    upto = np.concatenate([[0], np.cumsum(count)])
    frame = np.repeat(np.arange(rows), np.diff(np.append(first.astype(np.int64), len(words))))
    begin = upto[:-1] - upto[first.astype(np.int64)][frame] + frame * FRAME if rows else np.zeros(0, np.int64)
    limit = np.minimum((frame + 1) * FRAME, n)
    out = np.zeros(n, np.uint32)
    for k, (each, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(selector == k)
        if not len(own) or not bits:
            continue
        mask = np.uint64((1 << bits) - 1)
        for j in range(each):
            to = begin[own] + j
            ok = to < limit[own]
            out[to[ok]] = ((words[own[ok]] >> np.uint64(j * bits)) & mask).astype(np.uint32)
    out[positions] = values
    return out


def encode_block(documents: list[bytes]) -> bytes:
    """One payload of the documents' ids (little-endian unsigned 32-bit)."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    words, first, positions, values = pack_ids(ids)
    lengths = np.array([len(d) // 4 for d in documents], "<u4")
    head = _HEADER.pack(_MAGIC, len(documents), len(ids), len(first), len(words), len(positions))
    return b"".join([head, lengths.tobytes(), first.astype("<u4").tobytes(), words.astype("<u8").tobytes(), positions.astype("<u4").tobytes(), values.astype("<u4").tobytes()])


def decode_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the documents and all their ids."""
    magic, n_docs, n_ids, n_frames, n_words, n_escapes = _HEADER.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    at, parts = _HEADER.size, []
    for n, kind in ((n_docs, "<u4"), (n_frames, "<u4"), (n_words, "<u8"), (n_escapes, "<u4"), (n_escapes, "<u4")):
        parts.append(np.frombuffer(payload, kind, n, at))
        at += parts[-1].nbytes
    lengths, first, words, positions, values = parts
    return lengths, unpack_ids(words, first, n_ids, positions, values)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 16) -> None:
    """Encode every whole text and write the blocks to ``path`` in ascending id order.

    A null or empty text is the end id alone; null ids come first; rows that
    repeat an id, or all else, follow each other and are written one by one.
    An empty table writes no block. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("payload", T.BinaryType()),
    ])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced=True).encode
        end = int(end_id).to_bytes(4, "little")
        shard, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        names: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, names, size, number
            arrays = [
                pa.array([shard], pa.int32()),
                pa.array([number], pa.int64()),
                pa.array([size], pa.int64()),
                pa.array([names], pa.list_(kind)),
                pa.array([encode_block(held)], pa.binary()),
            ]
            held, names, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for row, ids, offsets in encode(batch.column(1)):
                raw, bounds = ids.tobytes(), (4 * offsets).tolist()
                for name, a, b in zip(batch.column(0).slice(row, len(bounds) - 1).to_pylist(), bounds, bounds[1:], strict=False):
                    held.append(raw[a:b] + end)
                    names.append(name)
                    size += len(held[-1]) // 4
                    if size >= block_ids:
                        yield flush()
        if held:
            yield flush()

    ordered = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    ordered.mapInArrow(blocks, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, id_type: str = "bigint", keep_ids: bool = False) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (and ``ids``, on demand).

    One row for each row that was written, null and repeated ids included; a
    document of a null or empty text has its end id alone. A folder without
    blocks gives an empty result.
    """
    table = spark.read.schema(f"shard int, block long, n_ids long, doc_ids array<{id_type}>, payload binary").parquet(path)
    schema = f"shard int, block long, doc_id {id_type}, at long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                lengths, ids = decode_block(batch.column(3)[i].as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(own)
                arrays = [
                    pa.array(np.full(n, batch.column(0)[i].as_py(), np.int32)),
                    pa.array(np.full(n, batch.column(1)[i].as_py(), np.int64)),
                    batch.column(2)[i].values,
                    pa.array(ends - lengths),
                    pa.array(lengths.astype(np.int64)),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                ]
                names = ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(own, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    decoded = table.select("shard", "block", "doc_ids", "payload").mapInArrow(documents, schema)
    sizes = table.select("shard", "block", "n_ids")
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(upto) - F.col("n")).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.withColumn("block_start", F.sum("n_ids").over(within) - F.col("n_ids")).join(shards, "shard")
    return decoded.join(starts.drop("n_ids"), ["shard", "block"]).select(
        "doc_id", (F.col("shard_start") + F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])
    )
