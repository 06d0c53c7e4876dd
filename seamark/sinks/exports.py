"""Exports as text: STIX bundles, Turtle triples and Cursor-on-Target events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the URL name space of UUIDs, as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The version 5 UUID of a name in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def xml_text(c: Column) -> Column:
    for ch, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(ch), F.lit(ref))
    return c


def stix_indicators(vessels: DataFrame, created: str) -> DataFrame:
    """One STIX 2.1 indicator per vessel as JSON, with a deterministic id."""
    ident = F.concat(F.lit("indicator--"), uuid5(F.concat(F.lit("https://vessel/"), F.col("mmsi"))))
    body = F.to_json(F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), ident.alias("id"), F.lit(created).alias("created"), F.col("name"),
        F.concat(F.lit("[x-vessel:mmsi = '"), F.col("mmsi"), F.lit("']")).alias("pattern"), F.lit("stix").alias("pattern_type"),
        F.array(F.lower("sanctions_status")).alias("labels"), F.round(F.col("risk_score") * 10).cast("int").alias("confidence"),
    ))
    return vessels.select("vessel_id", ident.alias("stix_id"), body.alias("body"))


def vessel_turtle(vessels: DataFrame) -> DataFrame:
    """Turtle triples of each vessel."""
    s = F.concat(F.lit("<urn:vessel:"), F.col("mmsi"), F.lit(">"))
    name = F.regexp_replace("name", r'(["\\])', r"\\$1")
    return vessels.select("vessel_id", F.concat(s, F.lit(' a eucise:Vessel ; eucise:name "'), name, F.lit('" ; eucise:flag "'), F.col("flag"), F.lit('" ; eucise:risk "'), F.format_string("%.2f", "risk_score"), F.lit('"^^xsd:decimal .')).alias("turtle"))


def cot_event(uid: Column, kind: Column, lat: Column, lon: Column, at: Column, remarks: Column) -> Column:
    """A Cursor-on-Target event."""
    return F.concat(
        F.lit('<event version="2.0" uid="'), uid, F.lit('" type="'), kind, F.lit('" time="'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"><point lat="'), F.format_string("%.4f", lat), F.lit('" lon="'), F.format_string("%.4f", lon),
        F.lit('"/><detail><remarks>'), xml_text(remarks), F.lit("</remarks></detail></event>"),
    )


def search_documents(vessels: DataFrame) -> DataFrame:
    """Search documents with the id that the mirror uses: MMSI, else 'unknown'."""
    return vessels.select(F.coalesce("mmsi", F.lit("unknown")).alias("_id"), F.to_json(F.struct("name", "flag", "risk_score", "sanctions_status")).alias("doc"))
