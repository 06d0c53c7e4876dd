"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import conversation_repair, exact_dedup, html_extract, lm_scoring, mixing, ngram_join, packing, periodic_runs, pii, quality_rules, scratch, sharding, token_output, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), joint=True)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "token-files")
    token_output.write_token_files(_table(spark, sf_dir, "documents"), path, _vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_output.read_token_files(spark, path)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), size=5, similarity=(4, 5))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify_copies(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), shards=24, points=128)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document in ten gets a periodic tail, by the checksum of its id."""
    word = r"[^\x20\x09-\x0D]+"
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("w"), F.floor(mark / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("w", F.when(i < a, i + 1).otherwise(a + (i - a) % p + 1).cast("int")))
    chosen = (mark % 10 == 0) & F.col("text").rlike(word)
    split = docs.withColumn("w", F.when(chosen, F.regexp_extract_all("text", F.lit(word), F.lit(0))))
    found = periodic_runs.find_runs(split.select("doc_id", F.when(F.col("w").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text")), least_length=6, least_exponent=4)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.select("doc_id", "runs", "collapsed", best.alias("b"), F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("").alias("lines"))
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("b.s").alias("start"),
        (-F.col("b.l")).alias("length"),
        F.col("b.p").alias("period"),
        F.floor(-1000 * F.col("b.l") / F.col("b.p")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return conversation_repair.digest(conversation_repair.repair(conversation_repair.damage(conversations)), conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_lm_scoring,
        op3_token_output,
        op4_packing,
        op5_url_filter,
        op6_pii,
        op7_ngram_join,
        op8_exact_dedup,
        op9_mixing,
        op10_html_extract,
        op11_sharding,
        op12_periodic_runs,
        op13_conversation_repair,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": url_filter.oracle(),
    "op11_sharding": sharding.oracle(shards=24, points=128),
    "op13_conversation_repair": conversation_repair.oracle(),
    "op7_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                   ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh
            FROM w),
        g AS (SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
        u AS (SELECT rep, n, unnest(sh) AS x FROM g),
        p AS (
            SELECT a.rep AS a, b.rep AS b FROM u AS a JOIN u AS b ON a.x = b.x AND a.rep < b.rep
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT rep AS node, rep AS low FROM g UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node),
        c AS (SELECT node, min(low) AS component FROM r GROUP BY node)
        SELECT s.doc_id, len(s.sh) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE c.component END AS component_id
        FROM s JOIN g ON g.sh = list_sort(s.sh) JOIN c ON c.node = g.rep
    """,
    "op8_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n
    """,
}
