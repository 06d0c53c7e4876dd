"""Substring joins by an index of short pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters of ``text``."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size)))))


def contains_join(terms: DataFrame, texts: DataFrame, term: str, text: str, size: int = 4) -> DataFrame:
    """Rows of ``terms`` and ``texts`` where the column ``text`` contains the column ``term``.

    Each distinct text is listed under its pieces of ``size`` characters, and
    each distinct term looks under the one of its own pieces that fewest texts
    have, which is an equi-join; what meets is verified once. Terms shorter
    than ``size`` are pieces themselves: as many shorter lengths are listed as
    terms have. Null and empty terms, and null texts, join nothing. Columns of
    both sides must have different names.
    """
    words = terms.select(F.col(term).alias("_term")).where(F.length("_term") > 0).distinct()
    bodies = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    sizes = sorted(r[0] for r in words.select(F.least(F.length("_term"), F.lit(size))).distinct().collect())  # ``size`` numbers at most
    if not sizes:
        sizes = [size]
    own = F.concat(*[F.coalesce(grams(F.col("_text"), s), F.array().cast("array<string>")) for s in sizes])
    listed = bodies.select(F.explode(own).alias("_gram"), "_text")
    asked = F.lit(None).cast("array<string>")
    for s in sizes:
        asked = F.when(F.least(F.length("_term"), F.lit(size)) == s, grams(F.col("_term"), s)).otherwise(asked)
    asked = words.select("_term", F.explode(asked).alias("_gram"))
    # how many texts have each piece that a term asks for; a piece that none has ends its term
    often = listed.join(asked.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = asked.join(often, "_gram", "left").groupBy("_term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_r"))
    rarest = rarest.where("_r.n > 0").select("_term", F.col("_r.g").alias("_gram"))
    met = rarest.join(listed, "_gram").where(F.contains("_text", "_term")).select("_term", "_text")
    return terms.join(met, F.col(term) == F.col("_term")).join(texts, F.col("_text") == F.col(text)).drop("_term", "_text")
