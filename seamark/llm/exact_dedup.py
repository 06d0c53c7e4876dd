"""Exact deduplication by content hash with a byte check.

Two texts are equal when they are identical after the ASCII white space
``[\\x20\\x09-\\x0D]`` is deleted. Rows are grouped by the 128-bit MD5 of that
normal form; inside each group of two or more the bytes of all members are
compared, and a group whose members differ (a hash collision) is regrouped by
SHA-256.

Nothing depends on how a plan deals its rows: rows are told apart by hash,
length and id, and only the narrow digests are numbered. Texts that stand alone
are not shuffled, as far as a bitmap of the hashes of groups tells. Groups with much of
the table stay where they are in joins (see ``join_groups``), and bytes are
compared by the least and the greatest text of a group, which tasks find for
their own rows first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.scratch import materialize, numbered, passing
from seamark.llm.skew import join_groups, with_maybe

ASCII_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def without_space(text: Column) -> Column:
    """``text`` without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in ASCII_SPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def _digests(docs: DataFrame, id_col: str, text_col: str, hash_fn) -> DataFrame:
    """``_row``, ``_id``, ``_len``, ``_hash``, ``_sha`` of every row, written."""
    text = F.col(text_col)
    norm = without_space(text)
    return numbered(docs, [F.col(id_col).alias("_id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_len"), hash_fn(norm).alias("_hash"), F.sha2(norm, 256).alias("_sha")], "exact-digests")


def _groups(digests: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of two or more rows: ``keys``, ``_size``, the length ``_l``, id ``_i`` and row ``_r`` of the row that stays, and how many rows share that length and id.

    The longest original stays, then the smallest id (null last), then the first row.
    """
    same = digests.groupBy(*keys, "_len", "_id").agg(F.count("*").alias("_n"), F.min("_row").alias("_row"))
    order = F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"), F.col("_n").alias("c"))
    best = same.groupBy(*keys).agg(F.sum("_n").alias("_size"), F.min(order).alias("_b")).where("_size > 1")
    return best.select(*keys, "_size", (-F.col("_b.l")).alias("_l"), F.col("_b.i").alias("_i"), F.col("_b.r").alias("_r"), F.col("_b.c").alias("_ties"))


def _checked_groups(docs: DataFrame, digests: DataFrame, text_col: str, hash_fn) -> tuple[DataFrame, list[str], int]:
    """The groups with their bytes compared, the columns that name them, and the number of all rows."""
    groups, total = materialize(_groups(digests, ["_hash"]), "exact-groups"), digests.count()
    norm = without_space(F.col(text_col))
    texts = docs.select(hash_fn(norm).alias("_hash"), norm.alias("_norm"))
    texts = with_maybe(texts, groups, "_hash").where("_maybe").drop("_maybe")
    met = join_groups(texts, groups.select("_hash", "_size"), ["_hash"], "_size", total, inner=True)
    ends = met.groupBy("_hash").agg(F.min("_norm").alias("least"), F.max("_norm").alias("greatest"))
    mixed = materialize(ends.where("least <> greatest").select("_hash"), "exact-collisions")
    if mixed.isEmpty():
        return groups, ["_hash"], total
    # hashes that stand for different texts: all groups are named by both digests
    return materialize(_groups(digests, ["_hash", "_sha"]), "exact-groups"), ["_hash", "_sha"], total


def classify_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=F.md5) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the most code points in its original text
    stays, then the smallest id (a null id comes last); of rows that agree in
    both exactly one stays. Null and empty texts are equal to each other. An
    empty table gives an empty result. Other columns of ``docs`` are not read,
    so their names cannot clash. ``hash_fn`` is the grouping hash and can be
    weakened in tests.
    """
    with passing() as keep:
        digests = keep(_digests(docs, id_col, text_col, hash_fn))
        groups, keys, total = _checked_groups(docs, digests, text_col, hash_fn)
        keep(groups)
    return join_groups(digests, groups, keys, "_size", total).select(
        F.col("_id").alias(id_col),
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_i")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_r"), F.lit(True)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=F.md5) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Exactly one row of every group of equal texts stays, chosen as in
    ``classify_copies``; null and empty texts are one group. Of rows that
    agree in text, length and id, repeated ones too, any one stays. ``docs``
    may be any plan that gives the same rows whenever it is read, dealt in
    whatever way. An empty table gives an empty result, and no column name can
    clash.
    """
    with passing() as keep:
        groups, keys, total = _checked_groups(docs, _digests(docs, id_col, text_col, hash_fn), text_col, hash_fn)
        keep(groups)
    # rows travel as one struct, so that no name of theirs can clash
    text = F.col(text_col)
    digest = {"_hash": hash_fn(without_space(text)), "_sha": F.sha2(without_space(text), 256)}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_len"), F.col(id_col).alias("_id"), *[digest[k].alias(k) for k in keys])
    rows = with_maybe(rows, groups, "_hash")
    alone = rows.where("not _maybe").select("_doc.*")
    best = join_groups(rows.where("_maybe"), groups, keys, "_size", total).where(F.col("_size").isNull() | ((F.col("_len") == F.col("_l")) & F.col("_id").eqNullSafe(F.col("_i"))))
    if groups.where("_ties > 1").isEmpty():
        return alone.unionByName(best.select("_doc.*"))
    one = best.where("_ties > 1").dropDuplicates(keys)
    return alone.unionByName(best.where("_ties is null or _ties = 1").unionByName(one).select("_doc.*"))
