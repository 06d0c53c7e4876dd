"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document when its score lies above a cutoff. For each stratum
(a language by default) and rule, the good documents among the labelled ones
are a holdout: with ``k`` of ``n`` above a cutoff, the cutoff is certified when
a binomial with ``n`` trials and the allowed rate would show ``k`` or fewer
with probability ``delta / m`` at most (the exact, Clopper-Pearson, bound).
``m`` is the number of strata times rules (Bonferroni); within a rule the
cutoffs are tried from lax to strict in a fixed order, which needs no further
correction. The allowed rate of a stratum, ``alpha``, is shared by its rules, so
with confidence ``1 - delta`` no stratum loses more than ``alpha`` of its good
documents. A stratum with too few labels certifies nothing and its documents
are kept.

With ``joint``, as the registered queries have it, half of ``delta`` goes
to one nested sequence of joint cutoffs per stratum: all rules together, lax to
strict, each step tested with the whole ``alpha`` and corrected over strata
only. The other half goes to the rules one by one as above. Both hold at once,
so a stratum takes the set whose cutoffs are stricter in sum: the sequence
where labels are few, the rules by themselves where one of them would stop the
sequence. Everything is DataFrame code.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.scratch import materialize, passing

SPACE = r"[\x20\x09-\x0D]"
#: Cutoffs of each rule, lax to strict.
CUTOFFS: Mapping[str, Sequence[float]] = {
    "symbols_per_word": (2.0, 1.0, 0.5, 0.25, 0.1),
    "other_share": (0.8, 0.6, 0.5, 0.4, 0.3),
    "repeat_share": (0.5, 0.4, 0.3),
    "dup_line_share": (0.8, 0.5, 0.3),
    "mean_word_chars": (20.0, 15.0, 12.0, 10.0),
}
#: Part of ``delta`` that the sequence of joint cutoffs has: even parts, set without looking at any labels.
SEQUENCE_SHARE = 0.5
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_other")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more."""

    def windows(ws: Column) -> Column:
        hashed = F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
        return _let(F.slice(hashed, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))), covered)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, in_pairs))

    def in_pairs(placed: Column) -> Column:
        twice = F.filter(placed, lambda x, i: (x["h"] == F.get(placed, i - 1)["h"]) | (x["h"] == F.get(placed, i + 1)["h"]))
        return _let(F.transform(twice, lambda x: x["p"]), spread)

    def spread(at: Column) -> Column:
        return F.size(F.array_distinct(F.concat(at, F.transform(at, lambda p: p + 1), F.transform(at, lambda p: p + 2))))

    return _let(words, windows)


def metrics(text: Column) -> Column:
    """A struct of the counts ``METRICS`` of a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    per_words = _let(
        words,
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n"),
            F.length(F.array_join(ws, "")).cast("long").alias("c"),
            _repeated_words(ws).cast("long").alias("r"),
        ),
    )
    per_lines = _let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("d")))
    raw = F.struct(
        per_words.alias("w"),
        per_lines.alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("s"),
        F.regexp_count(text, F.lit(r"[^\p{Ll}\x20\x09-\x0D]")).cast("long").alias("o"),
    )

    def named(m: Column) -> Column:
        values = (m["w"]["n"], m["w"]["c"], m["s"], m["l"]["d"], m["w"]["r"], m["l"]["n"], m["o"])
        return F.struct(*[v.alias(name) for name, v in zip(METRICS, values, strict=True)])

    return _let(raw, named)


def base_failed(of=F.col) -> Column:
    """``of`` gives a count by its name."""
    n, r = of("n_words"), of("n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def scores(of=F.col) -> dict[str, Column]:
    """Score of each rule; 0 where there is nothing to measure."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(of(a).cast("double"), of(b).cast("double")), F.lit(0.0))

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "other_share": share("n_other", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "mean_word_chars": share("word_chars", "n_words"),
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial, for k below n * p; 1 from there on (no cutoff is certified there)."""
    start = n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)
    first = F.struct(start.alias("t"), F.exp(start).alias("s"))

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] + F.log((n - j + 1) / j) + F.lit(odds)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    js = F.when(k < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), k.cast("int")), lambda j: j.cast("double")))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(js, first, step, lambda acc: acc["s"]))


def joint_steps(cutoffs: Mapping[str, Sequence[float]] = CUTOFFS) -> list[dict[str, int]]:
    """The nested sequence of joint cutoffs: the place of each rule's cutoff, step by step, all strictest in the last."""
    steps = max(map(len, cutoffs.values()))
    return [{rule: -(-(t + 1) * len(cs) // steps) - 1 for rule, cs in cutoffs.items()} for t in range(steps)]


def certify(labelled: DataFrame, alpha: float, delta: float, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS, joint: bool = False) -> DataFrame:
    """Per ``stratum``: ``n_good`` and the strictest certified cutoff of each rule (null: none).

    ``labelled`` has ``stratum``, ``good`` and the scores. Only documents that
    pass the base rules belong here.
    """

    def above(reject: Column, name: str) -> Column:
        return F.sum(F.when(reject, 1).otherwise(0)).cast("double").alias(name)

    steps = joint_steps(cutoffs) if joint else []
    counts = [above(F.col(rule) > c, f"{rule}_{i}") for rule, cs in cutoffs.items() for i, c in enumerate(cs)]
    counts += [above(F.greatest(*[F.col(rule) > cutoffs[rule][i] for rule, i in step.items()]), f"joint_{t}") for t, step in enumerate(steps)]
    per = materialize(labelled.where("good").groupBy("stratum").agg(F.count("*").cast("double").alias("n_good"), *counts), "quality-counts")
    strata = max(1, per.count())
    level = delta * (1 - SEQUENCE_SHARE if joint else 1) / (strata * len(cutoffs))
    rate = alpha / len(cutoffs)

    def places(name: str, n: int, rate: float, level: float) -> Column:
        """How many of ``n`` cutoffs are certified; counts never fall from lax to strict, so these are the first ones."""
        passed = [F.when(binomial_cdf(F.col(f"{name}_{i}"), F.col("n_good"), rate) <= level, F.lit(i + 1)).otherwise(0) for i in range(n)]
        return F.array_max(F.array(*passed))

    alone = {rule: places(rule, len(cs), rate, level) for rule, cs in cutoffs.items()}
    per = per.select("stratum", F.col("n_good").cast("long").alias("n_good"), *[c.alias(f"own_{r}") for r, c in alone.items()], *([places("joint", len(steps), alpha, delta * SEQUENCE_SHARE / strata).alias("step")] if joint else []))
    chosen = {rule: F.col(f"own_{rule}") for rule in cutoffs}
    if joint:
        at = {rule: F.element_at(F.array(F.lit(0), *[F.lit(step[rule] + 1) for step in steps]), F.col("step") + 1) for rule in cutoffs}
        together = sum(at.values(), F.lit(0)) >= sum(chosen.values(), F.lit(0))
        chosen = {rule: F.when(together, at[rule]).otherwise(own) for rule, own in chosen.items()}
    return per.select("stratum", "n_good", *[F.when(c > 0, F.element_at(F.array(*[F.lit(float(x)) for x in cutoffs[rule]]), F.greatest(c, F.lit(1)))).alias(f"cut_{rule}") for rule, c in chosen.items()])


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float, joint: bool = False) -> DataFrame:
    """The certified cutoffs from a measured table with ``doc_id`` and ``stratum``."""
    good = labels.groupBy(F.col("doc_id").alias("_label_id")).agg((F.min("quality") == 1).alias("good"))
    holdout = measured.where(~base_failed()).select("doc_id", "stratum", *[s.alias(r) for r, s in scores().items()])
    return materialize(certify(holdout.join(good, F.col("doc_id") == F.col("_label_id")), alpha, delta, joint=joint), "quality-cutoffs")


def _with_cutoffs(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (``stratum``) with ``cut_`` columns of their stratum."""
    return rows.join(cuts.withColumnRenamed("stratum", "_stratum"), F.col("stratum").eqNullSafe(F.col("_stratum")), "left").drop("_stratum")


def _rejected(of=F.col) -> Column:
    reject = base_failed(of)
    for rule, score in scores(of).items():
        reject = reject | F.coalesce(score > F.col(f"cut_{rule}"), F.lit(False))
    return reject


def _measured(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """``doc_id``, ``stratum`` and the counts of every row, written."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), metrics(F.col(text_col)).alias("m"))
    return materialize(named.select("doc_id", "stratum", "m.*"), "quality-metrics")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = 0.02, delta: float = 0.1, joint: bool = False) -> DataFrame:
    """One row per document: id, the counts, ``base_failed``, ``kept``, the stratum's cutoffs.

    ``labels`` has ``doc_id`` and ``quality`` (1: good); a document whose
    labels disagree counts as not good. A null text has no words and fails the
    base rules; a null stratum is a stratum; a null id has no label. Repeated
    rows are judged one by one. Empty tables give empty results; without
    labels only the base rules reject.
    """
    with passing() as keep:
        measured = keep(_measured(docs, id_col, text_col, stratum_col))
        cuts = keep(cutoffs(measured, labels, alpha, delta, joint))
    judged = _with_cutoffs(measured, cuts)
    return judged.select("doc_id", *METRICS[:5], base_failed().alias("base_failed"), (~_rejected()).alias("kept"), *[f"cut_{r}" for r in CUTOFFS])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = 0.02, delta: float = 0.1, joint: bool = False) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    Rows are judged as in ``judge``: a null, empty or short text goes, a null
    stratum is a stratum, a null id has no label, and rows that repeat stay or
    go together. Texts are measured twice, for the cutoffs and for the
    verdicts, so that they are neither shuffled nor written in between. An
    empty table gives an empty result, and no column name can clash.
    """
    with passing() as keep:
        cuts = keep(cutoffs(_measured(docs, id_col, text_col, stratum_col), labels, alpha, delta, joint))
    # rows travel as one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(stratum_col).alias("stratum"))
    # one expression, so that a text is measured once however often a count is used
    kept = _let(metrics(F.col("_doc").getField(text_col)), lambda m: ~_rejected(lambda name: m[name]))
    return _with_cutoffs(rows, cuts).where(kept).select("_doc.*")
