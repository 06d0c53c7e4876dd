"""The pipeline's stages and its whole against brute force on the small documents, and on awkward rows."""

import random
from collections import Counter

import corpus_pipeline
from test_text_operators import brute_components, brute_copies, brute_metrics, check_packing

from seamark.llm import mixing, scratch


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    kept = scratch.materialize(corpus_pipeline.quality(spark, docs, small), "t")
    metrics = {i: brute_metrics(r.text) for i, r in rows.items()}
    # too few labels here to certify a cutoff: the base rules decide
    want = {i for i, m in metrics.items() if not (m[0] < 50 or 100 * m[4] > 50 * m[0])}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == columns

    first = scratch.materialize(corpus_pipeline.exact(spark, kept, small), "t")
    pairs = [(i, rows[i].text) for i in sorted(want)]
    assert {r.doc_id for r in first.collect()} == {k for _, k, *_ in brute_copies(pairs)} and first.columns == columns

    one = scratch.materialize(corpus_pipeline.near(spark, first, small), "t")
    pairs = [(r.doc_id, r.text) for r in first.collect()]
    assert {r.doc_id for r in one.collect()} == {c for _, _, c in brute_components(pairs)} and one.columns == columns

    mixed = scratch.materialize(corpus_pipeline.mix(spark, one, small), "t")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in one.collect()} and mixed.columns == columns
    assert copies == Counter({r.doc_id: r.copies for r in mixing.mix(one).collect() if r.copies})

    rows2 = [(r.doc_id, r.text) for r in mixed.collect()]
    check_packing(corpus_pipeline.pack(spark, mixed, small).collect(), rows2, 4096)
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, small).collect()} == {tuple(r)[:5] for r in corpus_pipeline.pack(spark, mixed, small).collect()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def run_on(spark, path, docs, labels):
    """All stages over tables with columns whose names a stage might use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _doc string, k string, stratum string, copies long"
    spark.createDataFrame([(*d, 0, "r", "d", "k", "s", 7) for d in docs], schema).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    kept, tables = spark.read.parquet(f"file://{path}/documents.parquet"), []
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, f"file://{path}")
        if name != "best-fit packing":
            assert kept.columns == columns, name
        kept.write.parquet(f"file://{path}/{name}")
        kept = spark.read.parquet(f"file://{path}/{name}")
        tables.append([r.asDict() for r in kept.collect()])
    return tables


def test_certified_rules_reject_in_the_pipeline(spark, tmp_path):
    rng = random.Random(1)
    good = [(i, words(rng, 60), "en", "abc"[i % 3]) for i in range(320)]
    junk = [(1000 + i, " ".join(w + "#" * (i % 3 + 1) for w in words(rng, 60).split()), "en", "a") for i in range(20)]
    other = [(2000, " ".join(w + "##" for w in words(rng, 60).split()), "xx", "a")]  # no labels: only the base rules
    odd = [(3000, None, "en", "a"), (3001, "", "en", None), (None, words(rng, 70), None, None), (3002, "short text", "en", "a"), (5, good[5][1], "en", "c"), (6, good[6][1] + " ", "en", "a")]
    odd += [(3003, words(rng, 30_000), "en", "b"), (3004, " ".join(good[9][1].split()[:-1]), "en", "b")]
    quality, exact, near, mixed, packed = run_on(spark, tmp_path, good + junk + other + odd, [(i, 1, 0) for i in range(320)] + [(1000 + i, 0, 0) for i in range(20)])
    ids = Counter(r["doc_id"] for r in quality)
    assert not any(1000 <= (i or 0) < 1020 for i in ids)  # the certificate rejects what the base rules pass
    assert ids[2000] == 1 and ids[None] == 1 and ids[5] == 2 and ids[6] == 2 and not ids.keys() & {3000, 3001, 3002}
    assert all(ids[i] for i in range(320))
    assert Counter(r["doc_id"] for r in exact) == Counter(ids.keys()) and max(r["text"].endswith(" ") for r in exact if r["doc_id"] == 6)
    gone = {r["doc_id"] for r in exact} - {r["doc_id"] for r in near}
    assert gone == {3004} and len(near) == len(exact) - 1
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near} and max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)


def test_empty_pipeline(spark, tmp_path):
    assert all(not rows for rows in run_on(spark, tmp_path, [], []))
