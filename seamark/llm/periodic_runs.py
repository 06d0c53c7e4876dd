"""Runs of a text's words: maximal stretches that repeat with a period.

The words of a text are ranked, and the longest Lyndon word that begins at each
place comes from the first phase of Baier's suffix sorter, which groups places
by exactly that word: groups are taken from the greatest down, and each place
of a group is appended to the nearest place before it that is not yet taken,
whose group is split by the number of appended words. It is run under the order
of the ranks and under the reverse one; every run has its Lyndon root in one of
the two. Roots are then extended to both sides by longest common extensions,
found for all roots at once by binary search over prefix hashes, and what
comes out is checked symbol by symbol, so that no hash decides a run.

A run that repeats ``least_exponent`` times holds each of its words at least
``floor(least_exponent)`` times and each pair of neighbours one time less, so
places with rarer words or pairs cut a text, and the sorter only sees what is
left between the cuts. That loses no run and leaves little of ordinary prose.

Texts are independent, so Spark deals them to tasks and nothing is shuffled; a
task holds one Arrow batch and the ranks of one text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
#: Bytes of text after which a task hands on what it has found.
SLICE_BYTES = 1 << 22


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place (Baier's phase one).

    ``open_left`` finds the nearest place to the left that is not yet taken, with
    path halving. A group's members are those of its list that still carry its
    number. ``below`` links groups from the greatest down; what is split off a
    group stands right above it.
    """
    n = len(ranks)
    length = [1] * n
    open_left = list(range(n + 1))  # place i is held at i + 1; 0 stands for none
    by_rank: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        by_rank.setdefault(r, []).append(i)
    members = [by_rank[r] for r in sorted(by_rank)]
    group = [0] * n
    for g, at in enumerate(members):
        for i in at:
            group[i] = g
    live = [len(at) for at in members]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    top = len(members) - 1
    while top >= 0:
        taken = [i for i in members[top] if group[i] == top] if live[top] else ()
        for i in taken:
            open_left[i + 1] = i
        appended: dict[int, int] = {}
        for i in taken:
            x = i + 1
            while open_left[x] != x:
                open_left[x] = open_left[open_left[x]]
                x = open_left[x]
            if x:
                appended[x - 1] = appended.get(x - 1, 0) + 1
        if appended:
            size = length[taken[0]]
            split: dict[int, dict[int, list[int]]] = {}
            for p, k in appended.items():
                split.setdefault(group[p], {}).setdefault(k, []).append(p)
                length[p] += k * size
            for g, by_count in split.items():
                for k in sorted(by_count, reverse=True):
                    moved = by_count[k]
                    if len(moved) == live[g]:  # nothing stays behind
                        members[g] = moved
                        break
                    new = len(members)
                    members.append(moved)
                    live.append(len(moved))
                    live[g] -= len(moved)
                    for p in moved:
                        group[p] = new
                    up = above[g]
                    below.append(g)
                    above.append(up)
                    above[g] = new
                    below[up] = new
        members[top] = []
        top = below[top]
    return length


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _extensions(ranks: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each place agrees with the one a period later: to the right from ``starts`` on, and to the left before them."""
    n = len(ranks)
    power = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((ranks.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * power[:n], out=sums[1:])

    def agree(a: np.ndarray, size: np.ndarray) -> np.ndarray:
        b = a + periods
        return (sums[a + size] - sums[a]) * power[periods] == sums[b + size] - sums[b]

    def longest(most: np.ndarray, at) -> np.ndarray:
        lo, hi = np.zeros_like(most), most
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = agree(at(mid), mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    return longest(n - starts - periods, lambda size: starts), longest(starts.copy(), lambda size: starts - size)


def maximal_runs(ranks: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``ranks`` of that length and exponent at least, by start and period."""
    n = len(ranks)
    if n < 2:
        return []
    found: dict[tuple[int, int], int] = {}  # a stretch that a lying hash has given to a multiple of its period keeps the smallest
    for order in (ranks, ranks.max() - ranks):
        periods = np.array(lyndon_lengths(order.tolist()), np.int64)
        starts = np.arange(n, dtype=np.int64)
        # the first root of such a run begins in its first period, so this much follows
        fits = starts + (least_exponent - 1) * periods < n
        starts, periods = starts[fits], periods[fits]
        same = ranks[starts] == ranks[starts + periods]
        starts, periods = starts[same], periods[same]
        if not len(starts):
            continue
        right, left = _extensions(ranks, starts, periods)
        length = left + right + periods
        long = length >= np.maximum(least_length, least_exponent * periods)
        claims = sorted(set(zip((starts - left)[long].tolist(), length[long].tolist(), periods[long].tolist())))
        for claim in claims:
            if found.get(claim[:2]) == claim[2]:
                continue
            for start, size, period in _checked(ranks, *claim, least_length, least_exponent):
                found[start, size] = min(period, found.get((start, size), period))
    return sorted(((start, size, period) for (start, size), period in found.items()), key=lambda r: (r[0], r[2]))


def _checked(ranks: np.ndarray, start: int, size: int, period: int, least_length: int, least_exponent: int) -> Iterator[tuple[int, int, int]]:
    """The runs of that period in a stretch that hashes call one run: itself, unless a hash has lied."""
    differs = np.flatnonzero(ranks[start : start + size - period] != ranks[start + period : start + size]).tolist()
    at = 0
    for stop in [*differs, size - period]:
        if stop - at + period >= max(least_length, least_exponent * period):
            yield start + at, stop - at + period, period
        at = stop + 1


def _stretches(codes: np.ndarray, least_length: int, least_exponent: int) -> Iterator[tuple[int, np.ndarray]]:
    """What is left of a text between words and pairs that no run can hold: (first place, codes); a code below 0 is a rare word."""
    inside = codes >= 0
    link = inside[1:] & inside[:-1]
    if least_exponent > 2 and link.any():
        pair = codes[:-1] * (int(codes.max()) + 1) + codes[1:]
        places = np.flatnonzero(link)
        _, name, count = np.unique(pair[places], return_inverse=True, return_counts=True)
        link[places] = count[name] >= least_exponent - 1
    edge = np.flatnonzero(np.diff(np.concatenate(([False], link, [False])).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b + 1 - a >= least_length:
            yield a, codes[a : b + 1]


def word_runs(words: list[bytes], least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a list of words."""
    if len(words) < max(least_length, least_exponent):
        return []
    often = [w for w, k in Counter(words).items() if k >= least_exponent]
    if not often:
        return []
    number = dict(zip(often, range(len(often))))
    codes = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
    runs = []
    for first, stretch in _stretches(codes, least_length, least_exponent):
        _, name, again = np.unique(stretch, return_inverse=True, return_counts=True)
        # words that are frequent in the text but not here cut once more
        at = 0
        for stop in [*np.flatnonzero(again[name] < least_exponent).tolist(), len(stretch)]:
            if stop - at >= least_length:
                runs += [(first + at + s, size, p) for s, size, p in maximal_runs(stretch[at:stop], least_length, least_exponent)]
            at = stop + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edges[start + period] += 1
        edges[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``runs`` (start, length, period, by start and period) and ``collapsed``, the text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with
    smallest period ``q``, as long as ``least_length`` and ``least_exponent *
    q`` at least, that no neighbouring word extends. ``collapsed`` holds the
    words that are in no run or in the first period of every run that holds
    them, joined by one space. A null or empty text has no runs and collapses
    to the empty string; rows with the same id are told one by one; an empty
    table gives an empty result; other columns are not read. ``least_length``
    and ``least_exponent`` are whole numbers of at least 2.
    """
    if least_length < 2 or least_exponent < 2:
        raise ValueError("least_length and least_exponent must be at least 2")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, room = batch.column(1), 0, SLICE_BYTES
            runs: list[list[dict]] = []
            collapsed: list[bytes] = []
            for i, text in enumerate(texts):
                words = (text.as_py() or "").encode().split()
                own = word_runs(words, least_length, least_exponent)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                collapsed.append(b" ".join(without_repeats(words, own)))
                room -= len(collapsed[-1]) + 64
                if room < 0 or i == len(texts) - 1:
                    ids = batch.column(0).slice(first, len(runs))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(runs, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())], names=[id_col, "runs", "collapsed"])
                    first, room, runs, collapsed = i + 1, SLICE_BYTES, [], []

    return narrow.mapInArrow(tell, schema)
