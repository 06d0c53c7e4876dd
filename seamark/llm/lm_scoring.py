"""Documents scored by masked pseudo-likelihood of a bidirectional window network.

The network predicts every word from two words on either side: position-wise
embeddings are summed through a tanh layer, and a two-level softmax (class,
then member) gives the probability of the word's id. A document's score is the
sum of its words' conditional log-probabilities.

Vocabulary: the words of all documents are counted; the most frequent have ids
of their own and the others share hashed ids, the buckets. A word of a bucket
has the probability of the bucket times its share of the bucket's words. The
shares of up to ``KNOWN`` words, the more frequent ones, go to the tasks with
the network; those of all others stay distributed and are added by a join on
the word.

Training: a hash of id and text gives every document its round, one of
``ROUNDS``, and its slice, which has ``TASK_WORDS`` words on average. In each
round AdaGrad runs over every slice from the same start, the documents in the
order of their hashes, and the weights and sums of squares, weighted by words,
are averaged in a tree of sums and start the next round. So the network depends
on the documents alone, not on how they are dealt to tasks. It has a fixed size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm import merge
from seamark.llm.scratch import discard, materialize, passing
from seamark.llm.words import word_hashes

GROUPS = 32
WORDS = GROUPS * GROUPS
#: Words with ids of their own; the other ids are hashed.
FREQUENT = WORDS - 128
#: Other words whose shares are broadcast, at most: 16 bytes each.
KNOWN = 200_000
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
BATCH = 4096
RATE = 0.3
#: Averaging rounds; each has its share of the documents.
ROUNDS = 4
#: Words that are gathered before they are learned.
CHUNK = 16 * BATCH
#: Words of a slice on average.
TASK_WORDS = 250_000

_SHAPES = {"embed": (len(OFFSETS), WORDS + 1, WIDTH), "bias": (WIDTH,), "group": (WIDTH, GROUPS), "group_bias": (GROUPS,), "member": (GROUPS, WIDTH, GROUPS), "member_bias": (GROUPS, GROUPS)}


class WindowNetwork:
    """The network's weights, its gradient steps and its scores."""

    def __init__(self, weights: dict[str, np.ndarray], seen: dict[str, np.ndarray] | None = None):
        self.w = weights
        self.seen = seen or {k: np.full_like(v, 1e-5) for k, v in weights.items()}

    @classmethod
    def start(cls, seed: int = 11) -> "WindowNetwork":
        rng = np.random.default_rng(seed)
        weights = {k: (rng.standard_normal(s) * (0.1 if len(s) > 1 else 0.0)).astype(np.float32) for k, s in _SHAPES.items()}
        weights["embed"][:, WORDS] = 0
        return cls(weights)

    def flat(self) -> np.ndarray:
        """The weights, then the sums of squares of their slopes."""
        return np.concatenate([part[k].reshape(-1) for part in (self.w, self.seen) for k in _SHAPES]).astype(np.float64)

    @classmethod
    def from_flat(cls, vector: np.ndarray) -> "WindowNetwork":
        parts, at = ({}, {}), 0
        for out in parts:
            for k, s in _SHAPES.items():
                n = int(np.prod(s))
                out[k] = vector[at : at + n].reshape(s).astype(np.float32)
                at += n
        return cls(*parts)

    def copy(self) -> "WindowNetwork":
        return WindowNetwork.from_flat(self.flat())

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        z = self.w["embed"][0][around[0]]
        for o in range(1, len(OFFSETS)):
            z += self.w["embed"][o][around[o]]
        z += self.w["bias"]
        return np.tanh(z, out=z)

    @staticmethod
    def _log_softmax(x: np.ndarray) -> np.ndarray:
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    def _run(self, words: np.ndarray, around: np.ndarray, learn: bool) -> np.ndarray:
        """Log-probability of each word; with ``learn`` also one step."""
        order = np.argsort(words, kind="stable")
        own = words[order]
        h = self._hidden(around[:, order])
        groups, members = own // GROUPS, own % GROUPS
        rows = np.arange(len(own))
        coarse = self._log_softmax(h @ self.w["group"] + self.w["group_bias"])
        logp = coarse[rows, groups]
        back = np.zeros_like(h)
        grads = {}
        if learn:
            slope = np.exp(coarse)
            slope[rows, groups] -= 1
            grads["group"], grads["group_bias"] = h.T @ slope, slope.sum(axis=0)
            back += slope @ self.w["group"].T
            grads["member"], grads["member_bias"] = np.zeros_like(self.w["member"]), np.zeros_like(self.w["member_bias"])
        ends = np.searchsorted(groups, np.arange(GROUPS + 1))
        for g in range(GROUPS):
            a, b = ends[g], ends[g + 1]
            if a == b:
                continue
            fine = self._log_softmax(h[a:b] @ self.w["member"][g] + self.w["member_bias"][g])
            logp[a:b] += fine[np.arange(b - a), members[a:b]]
            if learn:
                slope = np.exp(fine)
                slope[np.arange(b - a), members[a:b]] -= 1
                grads["member"][g], grads["member_bias"][g] = h[a:b].T @ slope, slope.sum(axis=0)
                back[a:b] += slope @ self.w["member"][g].T
        if learn:
            back *= 1 - h * h
            grads["bias"] = back.sum(axis=0)
            grads["embed"] = np.zeros_like(self.w["embed"])
            for o in range(len(OFFSETS)):
                near = around[o][order]
                by = np.argsort(near, kind="stable")
                sorted_near = near[by]
                first = np.flatnonzero(np.r_[True, sorted_near[1:] != sorted_near[:-1]])
                grads["embed"][o][sorted_near[first]] = np.add.reduceat(back[by], first, axis=0)
                grads["embed"][o][WORDS] = 0
            for k, g in grads.items():
                g /= len(own)
                self.seen[k] += g * g
                self.w[k] -= RATE * g / np.sqrt(self.seen[k])
        out = np.empty(len(own), np.float32)
        out[order] = logp
        return out

    def score(self, words: np.ndarray, around: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(words[i : i + 16 * BATCH], around[:, i : i + 16 * BATCH], False) for i in range(0, len(words), 16 * BATCH)]) if len(words) else np.zeros(0, np.float32)

    def learn(self, words: np.ndarray, around: np.ndarray) -> None:
        for i in range(0, len(words), BATCH):
            self._run(words[i : i + BATCH], around[:, i : i + BATCH], True)


def windows(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The neighbours of every word inside its own text; ``WORDS`` where there is none."""
    n = len(words)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    out = np.full((len(OFFSETS), n), WORDS, np.uint16)
    for k, o in enumerate(OFFSETS):
        if abs(o) < n:
            here, there = (slice(-o, n), slice(0, n + o)) if o < 0 else (slice(0, n - o), slice(o, n))
            out[k, here] = np.where(text[here] == text[there], words[there], WORDS)
    return out


def ids_of(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Word ids. ``frequent``: hashes of the frequent words, most frequent first."""
    ids = (FREQUENT + (hashes >> np.uint64(40)) % np.uint64(WORDS - FREQUENT)).astype(np.uint16)
    if len(frequent):
        by = np.argsort(frequent)
        at = np.minimum(np.searchsorted(frequent[by], hashes), len(frequent) - 1)
        known = frequent[by][at] == hashes
        ids[known] = by[at[known]].astype(np.uint16)
    return ids


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (hash), ``n``: how often each word stands in all documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for _, h, _ in word_hashes(batch.column(0))]
            words, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select(text_col).mapInArrow(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bucket_rows(counts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``word``, ``n``, ``bucket`` of the words that have no ids of their own."""
    known = counts.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT numbers at most

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_numpy(zero_copy_only=False)
            rest = ~np.isin(words.view(np.uint64), known.value)
            ids = ids_of(words.view(np.uint64)[rest], known.value).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(words[rest]), pa.array(batch.column(1).to_numpy(zero_copy_only=False)[rest]), pa.array(ids)], ["word", "n", "bucket"])

    return counts.select("word", "n").mapInArrow(buckets, "word long, n long, bucket int")


def known_from(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that no more than ``most`` words are counted as often."""
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("words")).collect()  # 64 rows at most
    level, total = 64, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["words"]
        if total > most:
            break
        level = r["level"]
    return 1 << min(level, 62)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, WindowNetwork, DataFrame]:
    """The frequent words, the network and the counts of all words, from all documents."""
    spark = docs.sparkSession
    counts = materialize(count_words(docs, text_col), "lm-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(frequent)
    slices = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // ROUNDS // TASK_WORDS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, hashes, before in word_hashes(batch.column(1)):
                raw, bounds = ids_of(hashes, shared.value).tobytes(), (2 * before).tolist()
                ids = pa.array([raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(ids)), ids], ["hash", "ids"])

    # by a hash of id and text, so that copies of a text spread over the slices
    named = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"), F.col(text_col))
    words = named.mapInArrow(encoded, "hash long, ids binary").where(F.length("ids") > 0)
    place = F.pmod(F.xxhash64("hash"), F.lit(ROUNDS * slices))
    words = materialize(words.select("hash", "ids", F.pmod(place, F.lit(ROUNDS)).cast("int").alias("round"), F.floor(place / ROUNDS).alias("slice")), "lm-words")
    network = WindowNetwork.start()
    for turn in range(ROUNDS):
        begin = spark.sparkContext.broadcast(network)

        def rows(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            for part, texts in _by_slice(batches):
                network, total = begin.value.copy(), 0
                for ids, before in _chunks(texts):
                    network.learn(ids, windows(ids, before))
                    total += len(ids)
                part, chunk, payload = zip(*merge.to_rows(part, np.append(network.flat() * total, float(total)), 1 << 14), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(chunk, pa.int32()), pa.array(payload, pa.binary())], ["part", "chunk", "payload"])

        own = words.where(F.col("round") == turn).select("slice", "hash", "ids").repartition(slices, "slice").sortWithinPartitions("slice", "hash", "ids")
        written = materialize(own.mapInArrow(rows, merge.SCHEMA), "lm-weights")
        total = merge.tree_sum(written, "f8")
        if total is not None:
            network = WindowNetwork.from_flat(total[:-1] / total[-1])
        discard(written)
    discard(words)
    return frequent, network, counts


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """The texts of each slice, from rows in the order of slices; one batch is held."""
    texts = ((s, ids) for batch in batches for s, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
    for part, group in itertools.groupby(texts, key=lambda x: x[0]):
        yield part, (ids for _, ids in group)


def _chunks(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts of ``CHUNK`` words together, the last ones less: ids, and where each text begins."""
    held: list[np.ndarray] = []
    size = 0
    for raw in texts:
        held.append(np.frombuffer(raw, np.uint16))
        size += len(held[-1])
        if size >= CHUNK:
            yield np.concatenate(held), np.concatenate([[0], np.cumsum([len(h) for h in held])])
            held, size = [], 0
    if held:
        yield np.concatenate(held), np.concatenate([[0], np.cumsum([len(h) for h in held])])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``log_likelihood`` (sum), ``mean_log_likelihood`` (null without words).

    Words are runs of ``[^\\x20\\x09-\\x0D]`` of the whole text with A-Z
    lower-cased; a null or empty text has none and sums to 0. Ids pass
    through, null or repeated; other columns are not read. An empty table
    gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    with passing() as keep:
        frequent, network, counts = train(docs, id_col, text_col)
        rest = materialize(_bucket_rows(counts, frequent), "lm-buckets")
        totals = {r["bucket"]: r["total"] for r in rest.groupBy("bucket").agg(F.sum("n").alias("total")).collect()}  # WORDS - FREQUENT rows at most
        least = known_from(rest, KNOWN)
        known = rest.where(F.col("n") >= least).select("word", "n", "bucket").toPandas().sort_values("word")  # KNOWN rows at most
        shares = np.log(known["n"].to_numpy(np.float64) / known["bucket"].map(totals).to_numpy(np.float64)) if len(known) else np.zeros(0)
        shared = spark.sparkContext.broadcast((frequent, network.w, known["word"].to_numpy(np.int64), shares))  # bounded by KNOWN and the network's size

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent, weights, known, shares = shared.value
            own = WindowNetwork(weights)
            for batch in batches:
                for row, hashes, before in word_hashes(batch.column(2)):
                    words = ids_of(hashes, frequent)
                    logp = own.score(words, windows(words, before)).astype(np.float64)
                    rare = np.flatnonzero(words >= FREQUENT)
                    own_hash = hashes[rare].view(np.int64)
                    at = np.minimum(np.searchsorted(known, own_hash), max(0, len(known) - 1))
                    hit = known[at] == own_hash if len(known) else np.zeros(len(rare), bool)
                    logp[rare[hit]] += shares[at[hit]]
                    upto = np.concatenate([[0.0], np.cumsum(logp)])
                    left = rare[~hit]
                    cut = np.searchsorted(left, before)
                    others = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(hashes[left].view(np.int64)))
                    n = len(before) - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(before).astype(np.int64)), pa.array(upto[before[1:]] - upto[before[:-1]]), others], ["row", "doc_id", "n_words", "s", "others"]
                    )

        numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        scored = keep(materialize(numbered.mapInArrow(rows, f"row long, doc_id {id_type}, n_words long, s double, others array<long>"), "lm-scored"))
        sums = spark.createDataFrame([(int(b), int(t)) for b, t in totals.items()], "bucket int, total long")
        shares_of_others = rest.where(F.col("n") < least).join(F.broadcast(sums), "bucket").select("word", F.log(F.col("n") / F.col("total")).alias("share"))
        words = scored.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
        within = keep(materialize(words.join(shares_of_others, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("share")).alias("within")), "lm-within"))
    total = F.col("s") + F.coalesce("within", F.lit(0.0))
    return scored.join(within, "row", "left").select(
        "doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood")
    )
