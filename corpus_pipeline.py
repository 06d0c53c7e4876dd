"""The corpus pipeline: from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamark.llm import exact_dedup, mixing, ngram_join, packing, quality_rules, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules keep.

    A null, empty or short text goes. A null language is a stratum of its own,
    a null id has no label, repeated rows stay or go together, and languages
    with too few labels lose only what the base rules reject. Very long texts
    are measured whole. An empty table stays empty; no column name can clash.
    """
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), joint=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts.

    The longest original stays, then the smallest id (null last), of repeated
    rows any one. Null and empty texts are one group. An empty table stays
    empty; no column name can clash.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8.

    The smallest id of a component stays (null last), one row of those that
    share it. Texts without words, null ones too, all stay. An empty table
    stays empty; no column name can clash.
    """
    return ngram_join.keep_one_per_group(docs, size=5, similarity=(4, 5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own. A text without words is taken 0
    times and goes; repeated rows are taken alike. An empty table stays empty;
    no column name can clash.
    """
    return mixing.repeat_to_mix(docs, weights=(5, 2, 1), cap=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences.

    A null or empty text is the end id alone, repeated rows are packed once
    each, ids may be null, only texts beyond 4096 tokens are cut. An empty
    table gives an empty result; other columns are not read.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: SQL can't express the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.materialize(docs, f"pipeline-{k}")
    return docs
