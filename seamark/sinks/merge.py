"""Keyed merges and dead letters, for batches and for ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; the order's columns decide, as no arrival order is kept."""
    values = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def latest_known(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key and column the last value that is not null."""
    by = F.struct(*order)
    values = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(c) for c in values])


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], create_only: Sequence[str] = (), keep_known: bool = False) -> DataFrame:
    """``table`` after the merge of ``batch`` (one row a key).

    Columns in ``create_only`` keep their first value; the others take the new
    one, or, with ``keep_known``, keep the old one where the new one is null.
    """
    old = table.select(*[F.col(c).alias(f"_o_{c}") for c in table.columns], F.lit(True).alias("_old"))
    new = batch.select(*[F.col(c).alias(f"_n_{c}") for c in table.columns], F.lit(True).alias("_new"))
    on = [F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in keys]
    joined = old.join(new, on, "full_outer")

    def pick(c: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in keys or c in create_only:
            return F.when(F.col("_old"), o).otherwise(n)
        if keep_known:
            return F.coalesce(n, o)
        return F.when(F.col("_new"), n).otherwise(o)

    return joined.select(*[pick(c).alias(c) for c in table.columns])


def split_valid(rows: DataFrame, rules: dict[str, Column], source: str) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and dead letters (source, error, raw) for the others.

    A rule that is null counts as broken.
    """
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    checked = rows.withColumn("_errors", errors)
    good = checked.where(F.size("_errors") == 0).drop("_errors")
    bad = checked.where(F.size("_errors") > 0).select(F.lit(source).alias("source"), F.array_join("_errors", ",").alias("error"), F.to_json(F.struct(*rows.columns)).alias("raw"))
    return good, bad


def table_writer(path: str, keys: Sequence[str], order: Sequence[str], create_only: Sequence[str] = ()):
    """A ``foreachBatch`` function that keeps the newest version of a keyed table under ``path``.

    Each batch writes a new version and then the pointer to it; a batch that
    is run again finds its version and leaves it, so retries are harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
        versions = sorted(int(s.getPath().getName()[8:]) for s in fs.listStatus(files) if s.getPath().getName().startswith("version=")) if fs.exists(files) else []
        done = [v for v in versions if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/_SUCCESS"))]
        before = [v for v in done if v < batch_id]
        new = latest(batch, keys, order)
        if before:
            new = upsert(spark.read.parquet(f"{path}/version={before[-1]}"), new, keys, create_only)
        new.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write
