"""Near-duplicate join on word n-grams with exact Jaccard similarity.

A text is the set of its distinct word shingles. Equal sets form one class; the
join runs over classes.

1.  All documents' shingles are counted in a sketch of ``2**SKETCH_BITS``
    counters. It orders shingles rare first; any order gives a correct join,
    so the sketch's collisions cost speed only.
2.  Prefix filter: two sets of similarity t or more share a shingle among the
    first ``n - ceil(t * n) + 1`` of each. Classes meet on those prefix
    shingles, subject to the length filter, the positional filter and a suffix
    filter (what is left behind the shared shingle, split by hash, bounds the
    overlap).
3.  Postings are dealt by shingle and sorted once; each task streams its lists.
    Short lists give their pairs at once. On longer ones classes are compared
    with a hub first, one candidate per class a round; what links is merged
    into components. Lists whose classes are all in one component are done.
    The lists that still mix components when hub rounds bring nothing new are
    joined with themselves across components, a pair on the first list that it
    shares, so no link between components is lost, and large groups of copies
    never become all their pairs.
4.  Bitmap filter: each set has the parities of its shingles over 256 buckets,
    and again over as many buckets as it has shingles, or some more. Two sets
    differ in as many shingles at least as their bitmaps differ in bits, which
    bounds the overlap. The short bitmaps go with the postings of long lists,
    the wide ones are looked up for pairs.
5.  Every candidate pair that is left is verified once, on the whole sets. Of
    the pairs of short lists each class first meets one partner; pairs inside
    the components that come of it need no more.

Sets are read again only for texts that some pair needs. A bitmap of
``2**WANTED_BITS`` bits, the same at any data size, tells tasks which texts to
pass over; what it lets through is joined exactly.

Shingles and classes are named by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm import merge
from seamark.llm.components import FEW_ROWS, components
from seamark.llm.scratch import discard, materialize, passing
from seamark.llm.skew import join_groups
from seamark.llm.words import shingle_sets

SKETCH_BITS = 22
#: Bits of the bitmap of wanted texts.
WANTED_BITS = 26
#: Lists of up to this many classes give their pairs at once; longer ones go through hubs.
SHORT_LIST = 8
#: Hub rounds at most; lists that still mix components go to the join of all their cross pairs.
HUB_ROUNDS = 3
#: Lists before a posting's own that it knows of its class.
BEFORE = 64


def _class_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _needed(n: Column, m: Column, num: int, den: int) -> Column:
    """Overlap ``i`` reaches similarity num/den when ``i * (num + den) >= num * (n + m)``."""
    return F.lit(num) * (n + m)


BITMAP = ("b0", "b1", "b2", "b3")


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount(((hashes >> np.uint64(20)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide_bitmap(hashes: np.ndarray) -> bytes:
    """The parities over a power of two of buckets, no fewer than there are shingles."""
    buckets = 1 << max(8, (len(hashes) - 1).bit_length())
    odd = np.bincount(((hashes >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _wide_differences(a: bytes, b: bytes) -> int:
    """Bits in which two wide bitmaps differ; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _differences(a: str, b: str) -> Column:
    """Shingles that stand in one of two sets only, at least."""
    return sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in BITMAP), F.lit(0))


def _bitmaps_agree(a: str, b: str, num: int, den: int) -> Column:
    """Whether the overlap that the bitmaps leave possible reaches the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (n + m - _differences(a, b)) * (num + den) >= 2 * _needed(n, m, num, den)


def describe(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row ``doc_id``, ``n``, ``k`` (class; null when empty), bitmaps, ``th`` (hash of the text), and the tasks' sketches in ``part``, ``chunk``, ``payload``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, th long, n long, k long, b0 long, b1 long, b2 long, b3 long, wide binary, part long, chunk int, payload binary"
    names = ["doc_id", "th", "n", "k", *BITMAP, "wide", "part", "chunk", "payload"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint64)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            ns, ks, bits, wide = [], [], [], []
            buckets: list[np.ndarray] = []
            for hashes in shingle_sets(batch.column(2), size):
                ns.append(len(hashes))
                ks.append(_class_of(hashes) if len(hashes) else None)
                bits.append(_bitmap(hashes))
                wide.append(_wide_bitmap(hashes) if len(hashes) else None)
                buckets.append(hashes >> np.uint64(64 - SKETCH_BITS))
            if not bits:
                continue
            counts += np.bincount(np.concatenate(buckets).astype(np.int64), minlength=len(counts)).astype(np.uint64)
            nulls = [pa.nulls(len(batch), t) for t in (pa.int64(), pa.int32(), pa.binary())]
            marks = [pa.array(b) for b in np.stack(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(ks, pa.int64()), *marks, pa.array(wide, pa.binary()), *nulls], names)
        if kind is not None:
            sketch = merge.to_rows(TaskContext.get().partitionId(), counts, 1 << 16)
            part, chunk, payload = zip(*sketch, strict=True)
            m = len(sketch)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, kind), *[pa.nulls(m, pa.int64())] * 7, pa.nulls(m, pa.binary()), pa.array(part, pa.int64()), pa.array(chunk, pa.int32()), pa.array(payload, pa.binary())],
                names,
            )

    return docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"), F.col(text_col)).mapInArrow(rows, schema)


def postings(docs: DataFrame, frequency, size: int, num: int, den: int, text_col: str) -> DataFrame:
    """``token``, ``k``, ``n``, ``pos``, ``left`` for the prefix shingles of every class a task sees.

    ``left``: shingles behind ``pos`` in the rare-first order whose hash has its top bit clear.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = frequency.value
        seen: set[int] = set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for hashes in shingle_sets(batch.column(0), size):
                n = len(hashes)
                if not n:
                    continue
                k = _class_of(hashes)
                if k in seen:
                    continue
                seen.add(k)
                order = np.argsort(counts[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                prefix = n - -(-num * n // den) + 1
                low = hashes[order] < np.uint64(1 << 63)
                left = int(low.sum()) - np.cumsum(low[:prefix])
                for col, v in zip(out, (hashes[order[:prefix]].view(np.int64), np.full(prefix, k, np.int64), np.full(prefix, n, np.int64), np.arange(prefix), left), strict=True):
                    col.append(v)
            if out[0]:
                token, ks, ns, pos, left = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(ks), pa.array(ns.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(left.astype(np.int32))],
                    ["token", "k", "n", "pos", "left"],
                )

    return docs.select(text_col).mapInArrow(rows, "token long, k long, n int, pos int, left int")


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Length, positional and suffix filter for two postings of one shingle.

    At the first shingle that two sets share in the rare-first order, nothing
    before it is shared, so its rests bound the overlap.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(F.col(f"{a}.left"), F.col(f"{b}.left"))
    right = F.least(*[F.col(f"{s}.n") - F.col(f"{s}.pos") - 1 - F.col(f"{s}.left") for s in (a, b)])
    enough = (left + right + 1) * (num + den) >= _needed(n, m, num, den)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & enough


def _pairs_of(token: np.ndarray, k: np.ndarray, n: np.ndarray, pos: np.ndarray, left: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (smaller class first) that meet on one of these lists and pass the length, positional and suffix filters (see ``_may_link``)."""
    n, pos, left = n.astype(np.int64), pos.astype(np.int64), left.astype(np.int64)
    right = n - pos - 1 - left
    found = []
    for o in range(1, SHORT_LIST):
        i = np.flatnonzero(token[o:] == token[:-o]) if o < len(token) else np.zeros(0, np.int64)
        if not len(i):
            break
        j = i + o
        enough = (np.minimum(left[i], left[j]) + np.minimum(right[i], right[j]) + 1) * (num + den) >= num * (n[i] + n[j])
        i, j = i[ok := enough & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)], j[ok]
        found.append(np.stack([np.minimum(k[i], k[j]), np.maximum(k[i], k[j])]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, h = np.concatenate(found, axis=1)
    by = np.lexsort((h, x))
    x, h = x[by], h[by]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (h[1:] != h[:-1])]) if len(x) else by
    return x[new], h[new]


def meetings(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs and long lists from all postings, dealt by shingle and sorted: one exchange.

    Rows with ``h`` are pairs ``k``, ``h`` that pass the filters on a list of up
    to ``SHORT_LIST`` classes, repeated where they meet on several. The others
    are the postings of longer lists, each class once a list. A task holds one
    batch and one short list at most, however long a list is.
    """
    names = ["token", "k", "h", "n", "pos", "left"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32)]
        sent: tuple[int, int] | None = None  # last posting sent on of a long list
        for batch in itertools.chain(batches, [None]):
            cols = held if batch is None else [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            token, k = cols[:2]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (k[1:] != k[:-1])
            if sent is not None and len(token):
                fresh[0] = (token[0], k[0]) != sent
            token, k, n, pos, left = cols = [c[fresh] for c in cols]
            if not len(token):
                continue
            begins = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.append(begins, len(token)))
            long = sizes > SHORT_LIST
            if sent is not None and token[0] == sent[0]:
                long[0] = True
            # the last list may go on in the next batch: a short one waits
            end = len(token) if batch is None or long[-1] else int(begins[-1])
            member = np.repeat(long, sizes)[:end]
            if member.any():
                t, c, *rest = (v[:end][member] for v in cols)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c), pa.nulls(len(t), pa.int64()), *map(pa.array, rest)], names)
            x, h = _pairs_of(*(v[:end][~member] for v in cols), num, den)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(x), pa.array(h), *[pa.nulls(len(x), pa.int32())] * 3], names)
            sent = (token[-1], k[-1]) if end == len(token) and long[-1] else None
            held = [v[end:] for v in cols]

    return lists.repartition("token").sortWithinPartitions("token", "k").mapInArrow(rows, "token long, k long, h long, n int, pos int, left int")


def _bits_of(wanted: DataFrame) -> np.ndarray:
    """The bitmap of the hashes in ``wanted`` (``th``): ``2**WANTED_BITS`` bits."""
    place = F.pmod("th", F.lit(1 << WANTED_BITS)) + 1
    chunks = wanted.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << WANTED_BITS) // 8, np.uint8)
    for b, bits in chunks.collect():  # 4 KB each, 2**WANTED_BITS bits together
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, size: int, text_col: str) -> DataFrame:
    """``k``, ``shingles`` of the classes in ``wanted`` (``k``, and ``th``, the hash of a text of the class)."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits_of(wanted.select("th")))  # 8 MB at any data size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known = bits.value
        for batch in batches:
            place = batch.column(0).to_numpy() & ((1 << WANTED_BITS) - 1)
            passed = np.flatnonzero((known[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            for at in range(0, len(passed), 512):
                ks, sets = [], []
                for hashes in shingle_sets(batch.column(1).take(pa.array(passed[at : at + 512])), size):
                    k = _class_of(hashes)
                    if len(hashes) and k not in seen:
                        seen.add(k)
                        ks.append(k)
                        sets.append(hashes.view(np.int64))
                if ks:
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
                    yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), lists], ["k", "shingles"])

    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(rows, "k long, shingles array<long>").join(wanted.select("k"), "k", "left_semi").dropDuplicates(["k"])


def _with_ends(pairs: DataFrame, table: DataFrame, value: Column) -> DataFrame:
    """``x``, ``h`` and ``v``, the list of ``value`` of the two ends, from ``table`` (``k``).

    One join for both ends: a table of few pairs is broadcast by its size, and
    ``table`` stays where it is.
    """
    ends = pairs.select("x", "h", F.explode(F.array("x", "h")).alias("k"))
    return ends.join(table, "k").groupBy("x", "h").agg(F.collect_list(value).alias("v"))


def _near_by_bitmap(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (``x``, ``h``) with ``near``: whether their wide bitmaps leave the similarity possible."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(len(batch), np.int64)
            apart = np.zeros(len(batch), np.int64)
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                total[i] = a["n"] + b["n"]
                apart[i] = _wide_differences(a["wide"], b["wide"])
            near = (total - apart) * (num + den) >= 2 * num * total
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["x", "h", "near"])

    ends = {end: classes.select(F.col("k").alias(end), F.struct("n", "wide").alias(f"of_{end}")) for end in ("x", "h")}
    both = pairs.join(ends["x"], "x").join(ends["h"], "h").select("x", "h", "of_x", "of_h")
    return both.mapInArrow(rows, "x long, h long, near boolean")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (``x``, ``h``) with ``linked``: whether their whole sets reach the similarity."""
    joined = _with_ends(pairs, sets, F.col("shingles")).select("x", "h", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return joined.select("x", "h", (shared * (num + den) >= _needed(F.size("a"), F.size("b"), num, den)).alias("linked"))


def _first_meetings(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (``x``, ``h``) of postings with different labels that pass all filters on the first list they share.

    Shingles have one order in all sets, so two classes that share an earlier
    list meet there, and the filters decide there. A posting knows the last
    ``BEFORE`` lists of its class; pairs that share none of these but an
    earlier one are found more than once.
    """
    earlier = Window.partitionBy("k").orderBy("pos").rowsBetween(-BEFORE, -1)
    rows = rows.withColumn("before", F.collect_list("token").over(earlier))
    of = F.struct("k", "n", "pos", "left", *BITMAP, "before")
    p = rows.select("token", "lab", of.alias("p"))
    q = rows.select("token", F.col("lab").alias("lab2"), of.alias("q"))
    pairs = p.join(q, "token").where((F.col("lab") < F.col("lab2")) & _may_link("p", "q", num, den) & _bitmaps_agree("p", "q", num, den) & ~F.arrays_overlap("p.before", "q.before"))
    return pairs.select(F.least("p.k", "q.k").alias("x"), F.greatest("p.k", "q.k").alias("h"))


def _candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (``x``, ``h``) of postings with different labels on one list that pass all filters, once each; ``rows`` are whole lists."""
    return _first_meetings(rows, num, den).distinct()


def _shared_if_few(table: DataFrame, n: int) -> DataFrame:
    """``table`` of two keys with ``n`` rows, broadcast to its joins if these are few."""
    return F.broadcast(table) if n <= FEW_ROWS else table


class _Links:
    """Pairs tested so far and the components of what linked."""

    def __init__(self, classes: DataFrame, num: int, den: int):
        self.classes, self.num, self.den = classes, num, den
        self.tested: DataFrame | None = None
        self.n_tested = 0
        self.labels: DataFrame | None = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("lab", F.col("k"))
        return rows.join(self.labels, "k", "left").withColumn("lab", F.coalesce("lab", "k"))

    def untested(self, pairs: DataFrame) -> DataFrame:
        if self.tested is None:
            return pairs
        done = _shared_if_few(self.tested.select("a", "b"), self.n_tested)
        return pairs.join(done, (F.least("x", "h") == F.col("a")) & (F.greatest("x", "h") == F.col("b")), "left_anti")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in two components."""
        if self.labels is None:
            return pairs
        for end in ("x", "h"):
            labels = self.labels.select(F.col("k").alias(end), F.col("lab").alias(f"_{end}"))
            pairs = pairs.join(labels, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
        return pairs.where("_x <> _h").select("x", "h")

    def test(self, pairs: DataFrame, sets: DataFrame) -> int:
        """Verify the pairs, a written table; the number that links."""
        if pairs.isEmpty():
            return 0
        judged = materialize(_near_by_bitmap(pairs, self.classes, self.num, self.den), "ngram-pairs")
        checked = _verify(judged.where("near"), sets, self.num, self.den).union(judged.where("not near"))
        found = materialize(checked.select(F.least("x", "h").alias("a"), F.greatest("x", "h").alias("b"), "linked"), "ngram-verified")
        n_found, n_links = found.agg(F.count("*"), F.count_if("linked")).first()
        if n_found:
            self.tested = found if self.tested is None else self.tested.union(found)
            self.n_tested += n_found
        if n_links:
            edges = found.where("linked").select("a", "b")
            if self.labels is not None:
                edges = edges.union(self.labels.select(F.col("k").alias("a"), F.col("lab").alias("b")))
            labels = components(edges)
            self.labels = _shared_if_few(labels, labels.count())
        return n_links


def _mixed(links: _Links, lists: DataFrame, total: int) -> DataFrame:
    """The lists that hold more than one component."""
    held = links.labelled(lists).groupBy("token").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.count("*").alias("c"))
    return join_groups(lists, held.where("lo <> hi").select("token", "c"), ["token"], "c", total, inner=True).drop("c")


def link_pairs(links: _Links, pairs: DataFrame, sets: DataFrame) -> None:
    """Every class with one partner, then the pairs that these links leave in two components."""
    both = pairs.select(F.col("x").alias("a"), F.col("h").alias("b")).union(pairs.select("h", "x"))
    first = both.groupBy("a").agg(F.min("b").alias("b")).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("h")).distinct()
    links.test(materialize(first, "ngram-pairs"), sets)
    links.test(materialize(links.apart(links.untested(pairs)), "ngram-pairs"), sets)


def link_long_lists(links: _Links, lists: DataFrame, sets: DataFrame, num: int, den: int) -> None:
    """Hub rounds over the long lists, then all that is left across components."""
    total = lists.count()
    live = materialize(_mixed(links, lists, total), "ngram-lists")
    for turn in range(HUB_ROUNDS):
        rows = links.labelled(live)
        # every list draws its own hub anew, so that no class is the hub of all
        order = F.xxhash64("token", "k", F.lit(turn))
        hubs = rows.groupBy("token").agg(F.min(F.struct(order.alias("o"), "k", "n", "pos", "left", "lab", *BITMAP)).alias("hub"), F.count("*").alias("c"))
        p = rows.select("token", F.struct("k", "n", "pos", "left", "lab", *BITMAP).alias("p"))
        near = join_groups(p, materialize(hubs, "ngram-hubs"), ["token"], "c", total, inner=True).where(F.col("p.lab") != F.col("hub.lab"))
        near = near.where(_may_link("p", "hub", num, den) & _bitmaps_agree("p", "hub", num, den))
        near = links.untested(near.groupBy(F.col("p.k").alias("x"), F.col("hub.k").alias("h")).agg(F.count("*").alias("c")))
        # of a class's hubs the one with the most lists in common; a pair chosen from both ends is verified once
        best = near.groupBy("x").agg(F.max(F.struct("c", "h")).alias("m")).select("x", F.col("m.h").alias("h"))
        pairs = materialize(best.select(F.least("x", "h").alias("x"), F.greatest("x", "h").alias("h")).distinct(), "ngram-pairs")
        if not links.test(pairs, sets):
            break
        fewer = materialize(_mixed(links, live, total), "ngram-lists")
        discard(live)
        live = fewer
    rows = materialize(links.labelled(live), "ngram-rest")
    links.test(materialize(links.untested(_candidates(rows, num, den)), "ngram-pairs"), sets)


def near_duplicates(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. A text with
    fewer than ``size`` words is one shingle; one without words, empty or null,
    has none and is linked with nothing. ``component_id`` is the smallest id
    that links reach (null ids are passed over; a component of null ids only
    has null). Repeated rows are in one component. An empty table gives an
    empty result; other columns are not read.
    """
    rows, by_class = _rows_and_components(docs, size, similarity, id_col, text_col)
    if by_class is None:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.join(by_class, "k", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component.id")).alias("component_id")
    )


def _rows_and_components(docs: DataFrame, size: int, similarity: tuple[int, int], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id``, ``n``, ``k``, ``th`` and bitmaps of every row, and the component of every class (None for an empty table)."""
    num, den = similarity
    with passing() as keep:
        seen = keep(materialize(describe(docs, size, id_col, text_col), "ngram-classes"))
        rows = seen.where("chunk is null").select("doc_id", "n", "k", "th", *BITMAP, "wide")
        sketch = merge.tree_sum(seen.where("chunk is not null").select("part", "chunk", "payload"), "u8", most=2**32 - 1)
        if sketch is None:
            return rows, None
        return rows, keep(materialize(_component_of_class(docs, rows, sketch, size, num, den, text_col), "ngram-components"))


def _named() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("th"))


def _component_of_class(docs: DataFrame, rows: DataFrame, sketch: np.ndarray, size: int, num: int, den: int, text_col: str) -> DataFrame:
    """``k``, ``component``: each class with the row of its component that has the smallest id (null last): ``none``, ``id``, ``th``."""
    frequency = docs.sparkSession.sparkContext.broadcast(sketch)  # 16 MB at any data size
    met = materialize(meetings(postings(docs, frequency, size, num, den, text_col), num, den), "ngram-met")
    per = rows.where("k is not null").groupBy("k").agg(F.min(F.struct("th", "n", *BITMAP, "wide")).alias("c"))
    classes = materialize(per.select("k", "c.*"), "ngram-classes")
    pairs = met.where("h is not null").select(F.col("k").alias("x"), "h").distinct()
    pairs = materialize(_near_by_bitmap(pairs, classes, num, den).where("near").drop("near"), "ngram-pairs")
    long = materialize(met.where("h is null").drop("h").join(classes.select("k", *BITMAP), "k"), "ngram-lists")
    discard(met)
    involved = pairs.select(F.col("x").alias("k")).union(pairs.select("h")).union(long.select("k")).distinct()
    wanted = materialize(classes.select("k", "th").join(involved, "k", "left_semi"), "ngram-wanted")
    sets = materialize(_sets(docs, wanted, size, text_col), "ngram-sets")
    links = _Links(classes, num, den)
    link_pairs(links, pairs, sets)
    if not long.isEmpty():
        those = materialize(sets.join(long.select("k").distinct(), "k", "left_semi"), "ngram-sets")
        discard(sets)
        link_long_lists(links, long, those, num, den)
    labels = links.labels
    if labels is None:
        labels = rows.select("k", F.col("k").alias("lab")).limit(0)
    lows = rows.where("k is not null").groupBy("k").agg(F.min(_named()).alias("low")).join(labels, "k", "left").withColumn("lab", F.coalesce("lab", "k"))
    lowest = lows.groupBy("lab").agg(F.min("low").alias("component"))
    return lows.join(lowest, "lab").select("k", "component")


def keep_one_per_group(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each component keeps one, with the columns of ``docs``.

    A component, as in ``near_duplicates``, keeps the row with the smallest
    id, a null id last; of rows that share it exactly one. Rows whose text has
    no words, or is null, all stay. ``docs`` may be any plan that gives the
    same rows whenever it is read, dealt in whatever way: rows are told apart
    by id and text. An empty table gives an empty result, and no column name
    can clash.
    """
    with passing() as keep:
        rows, by_class = _rows_and_components(docs, size, similarity, id_col, text_col)
        if by_class is None:
            return docs
        held = rows.join(by_class, "k").groupBy(_named().alias("own")).agg(F.count("*").alias("rows"), F.first("component").alias("component"))
        held = held.withColumn("stays", F.col("own") == F.col("component"))
        # of rows with one id and text one stays; all others of a component go
        judged = keep(materialize(held.where("not stays or rows > 1").select("own.id", "own.th", "stays"), "ngram-judged"))
    # rows travel as one struct, so that no name of theirs can clash
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(whole, F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th"))
    stay = rows.join(judged, same, "left_anti")
    if not judged.where("stays").isEmpty():
        stay = stay.unionByName(rows.join(judged.where("stays"), same, "left_semi").dropDuplicates(["_id", "_th"]))
    return stay.select("_doc.*")
