"""Merges into a graph of several tables: nodes by a key chosen per row, edges with both ends."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen_key(keys: Sequence[str]) -> Column:
    """The name of the first of ``keys`` that a row has; null if it has none."""
    return F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys])


def merge_nodes(nodes: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], set_columns: Sequence[str] = (), create_columns: Sequence[str] = ()) -> DataFrame:
    """``nodes`` (``node`` and columns) after ``rows`` are merged by the first key that each has.

    A row meets every node with its key's value, or else makes one. Nodes that
    are met take the ``set_columns`` of the last row by ``order``; a new node
    also has the ``create_columns`` of its first row, and the key. Rows without
    a key are left out. Rows with the first key are merged before those with
    the next, as no order of arrival is kept: what they create can be met. A
    new node is named by its key, so that a repeated batch makes it again.
    """
    by = F.struct(*order)
    keyed = rows.withColumn("_key", chosen_key(keys))
    for key in keys:
        own = keyed.where(F.col("_key") == key)
        values = F.struct(*[F.col(c) for c in (*set_columns, *create_columns)]) if (*set_columns, *create_columns) else F.struct(F.lit(1))
        per = own.groupBy(F.col(key).alias("_value")).agg(F.max_by(values, by).alias("_last"), F.min_by(values, by).alias("_first"))
        met = nodes.join(per.select("_value", "_last"), F.col(key) == F.col("_value"), "left")
        met = met.select(*[(F.when(F.col("_value").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)) if c in set_columns else F.col(c)).alias(c) for c in nodes.columns])
        new = per.join(nodes.select(F.col(key).alias("_have")).where("_have is not null").distinct(), F.col("_value") == F.col("_have"), "left_anti")

        def column(c: str, key: str = key) -> Column:
            if c == "node":
                return F.concat(F.lit(f"{key}:"), F.col("_value").cast("string"))
            if c == key:
                return F.col("_value")
            if c in set_columns:
                return F.col(f"_last.{c}")
            return F.col(f"_first.{c}") if c in create_columns else F.lit(None)

        types = dict(nodes.dtypes)
        nodes = met.unionByName(new.select(*[column(c).cast(types[c]).alias(c) for c in nodes.columns]))
    return nodes


def node_edges(nodes: DataFrame, rows: DataFrame, keys: Sequence[str], target: str, kind: str) -> DataFrame:
    """Edges ``src``, ``dst``, ``kind`` from every node that a row's key meets to the row's ``target``, each once."""
    keyed = rows.where(F.col(target).isNotNull()).withColumn("_key", chosen_key(keys))
    out = None
    for key in keys:
        own = keyed.where(F.col("_key") == key).select(F.col(key).alias("_value"), F.col(target).cast("string").alias("dst"))
        part = own.join(nodes.select(F.col(key).alias("_have"), "node"), F.col("_value") == F.col("_have")).select(F.col("node").alias("src"), "dst", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def with_both_ends(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (``src``, ``dst``) whose ends are there (``node`` of either table), and those that lack one."""
    here = edges.join(sources.select(F.col("node").alias("src"), F.lit(True).alias("_s")).distinct(), "src", "left").join(targets.select(F.col("node").alias("dst"), F.lit(True).alias("_d")).distinct(), "dst", "left")
    whole = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    return here.where(whole).select(*edges.columns), here.where(~whole).select(*edges.columns)


def graph_writer(path: str, step: Callable[[Mapping[str, DataFrame], DataFrame], Mapping[str, DataFrame]], empty: Mapping[str, str]):
    """A ``foreachBatch`` function that keeps the newest version of several tables under ``path``.

    ``step`` takes the tables and a batch and returns the tables after it;
    ``empty`` has their schemas. All tables of a batch are one version: it
    counts once its last mark is written, so readers and retries never see
    some tables new and others old. A batch that is run again is written anew
    from the version before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = last_version(spark, path, batch_id)
        tables = {n: spark.createDataFrame([], s) if before is None else spark.read.schema(s).parquet(f"{path}/version={before}/{n}") for n, s in empty.items()}
        for name, table in step(tables, batch).items():
            table.write.mode("overwrite").parquet(f"{path}/version={batch_id}/{name}")
        spark.createDataFrame([(batch_id,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={batch_id}/whole")

    return write


def last_version(spark, path: str, before: int | None = None) -> int | None:
    """The newest whole version under ``path``, or the newest one before ``before``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    top = hadoop(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    found = [int(s.getPath().getName()[8:]) for s in fs.listStatus(top) if s.getPath().getName().startswith("version=")]
    return max((v for v in found if (before is None or v < before) and fs.exists(hadoop(f"{path}/version={v}/whole/_SUCCESS"))), default=None)
