"""Readers for the landed formats: explicit schemas, aliases of columns, nested records.

Collecting over HTTP is left to whatever lands the files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Canonical columns from whichever candidates exist: exact names first, then ignoring case; null where none does."""
    exact = set(df.columns)
    folded = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name, candidates in aliases.items():
        hit = next((c for c in candidates if c in exact), None) or next((folded[c.lower()] for c in candidates if c.lower() in folded), None)
        out.append(F.col(f"`{hit}`").alias(name) if hit else F.lit(None).cast("string").alias(name))
    return df.select(*out)


def ais_parquet(spark: SparkSession, path: str, renames: Mapping[str, str]) -> DataFrame:
    """Positions of a folder tree of Parquet files: valid nine-digit MMSIs, sentinels for unknown heading and status."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path).withColumnsRenamed(dict(renames))
    df = df.where("mmsi is not null and lat is not null and lon is not null").withColumn("mmsi", F.col("mmsi").cast("string"))
    return df.where(F.col("mmsi").rlike("^[0-9]{9}$")).fillna({"heading": 511, "nav_status": 15})


def scaled_ais(df: DataFrame) -> DataFrame:
    """Scaled integers of the raw feed to degrees, knots and metres."""
    def coord(c: str, limit: int) -> Column:
        return F.when(F.abs(c) > limit, F.col(c) / 600000.0).otherwise(F.col(c).cast("double"))

    return df.select(
        "mmsi", coord("lat", 180).alias("lat"), coord("lon", 360).alias("lon"), (F.col("sog") / 10.0).alias("speed_kts"), (F.col("cog") / 10.0).alias("course"), (F.col("draught") / 10.0).alias("draft_m"), (F.col("a") + F.col("b")).alias("length_m")
    ).where(F.length("mmsi") == 9)


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header-less tab-separated files with a fixed schema; short rows get nulls."""
    return spark.read.csv(path, sep="\t", schema=schema, quote="", mode="PERMISSIVE")


def json_lines(spark: SparkSession, path: str, schema: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """One entity a line; broken lines are skipped."""
    df = spark.read.json(path, schema=schema, mode="DROPMALFORMED")
    return df.where(F.col("schema").isin(list(kinds))) if kinds else df


def entities(df: DataFrame) -> DataFrame:
    """First name, other names as aliases, and first values of an entity's properties."""
    names = F.coalesce(F.col("properties")["name"], F.array().cast("array<string>"))
    weak = F.coalesce(F.col("properties")["weakAlias"], F.array().cast("array<string>"))
    def first(key: str) -> Column:
        return F.try_element_at(F.coalesce(F.col("properties")[key], F.array().cast("array<string>")), F.lit(1)).alias(key)

    return df.select("id", "schema", F.try_element_at(names, F.lit(1)).alias("name"), F.concat(F.slice(names, 2, 1000), weak).alias("aliases"), first("country"), first("topics"))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row per element of the name; large files are split by it."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def unpivot_owners(df: DataFrame, groups: int = 4) -> DataFrame:
    """Positional owner columns (``owner_1`` to ``owner_n`` and ``reg_1`` ...) as rows; empty ones are dropped."""
    owners = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"owner_{i}").alias("owner"), F.col(f"reg_{i}").alias("reg_no")) for i in range(1, groups + 1)])
    keep = [c for c in df.columns if not c.startswith(("owner_", "reg_"))]
    return df.select(*keep, F.explode(owners).alias("o")).select(*keep, "o.*").where("owner is not null and trim(owner) <> ''")


def multi_format_date(c: Column, formats: Sequence[str] = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")) -> Column:
    """The date by the first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def lenient_number(c: Column, missing: float | None = None) -> Column:
    """A number without thousands separators and currency signs; bad ones become ``missing``."""
    n = F.regexp_replace(c, r"[,$\s]", "").try_cast("double")
    return n if missing is None else F.coalesce(n, F.lit(missing))


def drone_frames(frames: DataFrame) -> DataFrame:
    """Remote-id frames: message type, unit and position by bit arithmetic on the bytes."""
    hexed = F.hex("frame")

    def byte(i: int) -> Column:
        return F.conv(F.substring(hexed, 2 * i + 1, 2), 16, 10).cast("int")

    def le32(i: int) -> Column:
        raw = sum((byte(i + k).cast("long") * (1 << (8 * k)) for k in range(4)), F.lit(0).cast("long"))
        return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw)

    kind = F.shiftright(byte(0), 4)
    long_enough = F.length("frame") >= 25
    return frames.where(F.length("frame") >= 2).select(
        *[c for c in frames.columns if c != "frame"],
        F.when(kind == 0, "BASIC_ID").when(kind == 1, "LOCATION").when(kind == 5, "OPERATOR_ID").otherwise("OTHER").alias("message"),
        F.when(kind == 0, F.trim(F.regexp_replace(F.substring("frame", 3, 20).cast("string"), "\x00+$", ""))).alias("uas_id"),
        F.when((kind == 1) & long_enough, le32(5) * 1e-7).alias("lat"),
        F.when((kind == 1) & long_enough, le32(9) * 1e-7).alias("lon"),
        F.when((kind == 1) & long_enough, (byte(13) + byte(14) * 256) * 0.5 - 1000).alias("altitude_m"),
    )
