"""Token ids of whole texts, by the ``tokenizers`` library, each distinct piece once.

BPE never merges across pre-tokens, so a text may be cut between pre-tokens
and its pieces encoded on their own. Texts are cut only where every split in
use has such a boundary: at white space (see ``_cuts``), and between an ASCII
letter and a full stop or comma. What is not cut stays one piece, so the ids
are those of the whole text. A text that holds one of the tokenizer's added
tokens, such as an end mark, goes through the library as a whole.

A batch's pieces are hashed together (two 64-bit hashes), each distinct one is
looked up among those that the worker has encoded before, and only new ones go
through the library. The ids of the batch are then gathered by numpy.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from seamark.llm.words import slices, span_hashes

#: Distinct pieces a worker remembers at most (some 35 MB); later ones are encoded as they come.
KNOWN_PIECES = 1_000_000
#: Bytes of text looked up together.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# bytes that may begin a white space character that is not ASCII, and separators that engines class differently
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_BEGINS_TEXT = ~_SPACE & ~_DOUBTFUL
_PLAIN = _BEGINS_TEXT & (np.arange(256) < 0x80)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True

_encoders: dict[tuple[str, bool], "PieceEncoder"] = {}


@dataclass
class Known:
    """Pieces by two hashes, sorted by the first: where their ids begin in the pool and how many they are."""

    keys: np.ndarray
    checks: np.ndarray
    begin: np.ndarray
    count: np.ndarray

    @staticmethod
    def empty() -> Known:
        return Known(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32))

    def find(self, keys: np.ndarray, checks: np.ndarray, begin: np.ndarray, count: np.ndarray, known: np.ndarray) -> None:
        """Fill in ``begin``, ``count`` and ``known`` of the pieces that are here."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = np.flatnonzero((self.keys[at] == keys) & (self.checks[at] == checks) & ~known)
        begin[here], count[here], known[here] = self.begin[at[here]], self.count[at[here]], True

    def merged(self, new: Known) -> Known:
        """Both tables in one; a key that both have with different checks stays as it was here."""
        if not len(self.keys):
            return new
        at = np.minimum(np.searchsorted(self.keys, new.keys), len(self.keys) - 1)
        fresh = self.keys[at] != new.keys
        into = np.searchsorted(self.keys, new.keys[fresh])
        pairs = ((self.keys, new.keys), (self.checks, new.checks), (self.begin, new.begin), (self.count, new.count))
        return Known(*(np.insert(old, into, more[fresh]) for old, more in pairs))


class PieceEncoder:
    """Encodes batches of texts.

    ``spaced``: the split keeps a leading space with its word (byte-level
    BPE). Otherwise white space is dropped and letters are lower-cased.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):
            raise ValueError("added tokens that are looked for after normalising need whole texts")
        self.marks = [t.content.encode() for t in added]
        # ids that begin (spaced) or end a pre-token
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("Ġ") if spaced else token.endswith("</w>")
        #: ids of the known pieces, one after another, and how many of them are in use
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        #: a large table that is seldom merged anew, and a small one of the latest pieces
        self.known = [Known.empty(), Known.empty()]

    def _cuts(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of ``data``; texts begin at ``begins``."""
        size = len(data)
        first = np.zeros(size + 1, bool)
        first[begins[begins < size]] = True
        stop = np.zeros(size, bool)
        stop[1:] = _LETTER[data[:-1]] & ((data[1:] == 0x2E) | (data[1:] == 0x2C))
        first[:size] |= stop
        if not self.spaced:
            inside = ~_SPACE[data]
            first[:size] &= inside
            first[0] = inside[0]
            first[1:size] |= inside[1:] & ~inside[:-1]
            starts = np.flatnonzero(first[:size])
            last = np.zeros(size, bool)
            last[:-1] = inside[:-1] & (~inside[1:] | first[1:size])
            last[-1] = inside[-1]
            return starts, np.flatnonzero(last) + 1
        # a space joins the word behind it, whatever stands before
        good = _BEGINS_TEXT[data]
        first[: size - 1] |= (data[:-1] == 0x20) & good[1:]
        # a line break between plain text is a pre-token of its own
        alone = np.zeros(size, bool)
        alone[1:-1] = (data[1:-1] == 0x0A) & _PLAIN[data[:-2]] & good[2:]
        first[:size] |= alone
        first[1:] |= alone
        starts = np.flatnonzero(first[:size])
        return starts, np.append(starts[1:], size)

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 1024):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False)]
        return out

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of ASCII letters: they are encoded in rows and parted at their edges."""
        out: list[bytes] = []
        glue = "" if self.spaced else " "
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            flat = np.array(self.tokenizer.encode_batch_fast([glue.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.edge[flat])
            cut = np.append(cut[1:], len(flat)) if self.spaced else cut + 1
            if len(cut) != len(part):
                out += self._ids(part)
                continue
            raw, begin = flat.tobytes(), 0
            for end in (4 * cut).tolist():
                out.append(raw[begin:end])
                begin = end
        return out

    def _encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, joined, and how many each has."""
        skip = 1 if self.spaced else 0
        plain = [len(p) > skip and p[skip:].isalpha() and p.isascii() and (not skip or p[:1] == b" ") for p in pieces]
        words = iter(self._of_words([p.decode() for p, w in zip(pieces, plain, strict=True) if w]))
        others = iter(self._ids([p.decode("utf-8", "replace") for p, w in zip(pieces, plain, strict=True) if not w]))
        ids = [next(words) if w else next(others) for w in plain]
        return np.frombuffer(b"".join(ids), np.uint32), np.array([len(x) // 4 for x in ids], np.int64)

    def _marked(self, data: np.ndarray, begins: np.ndarray) -> list[int]:
        """The texts of the slice that may hold an added token."""
        raw, found = data.tobytes(), set()
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                found.add(int(np.searchsorted(begins, at, "right")) - 1)
                at = raw.find(mark, at + 1)
        return sorted(found)

    def _stretches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """Slices of the batch, parted at texts with added tokens: (row of its first text, bytes, where each text begins, whether it is such a text)."""
        for row, data, begins in slices(texts, SLICE_BYTES):
            first = 0
            for i in self._marked(data, begins):
                if i > first:
                    yield row + first, data[begins[first] : begins[i]], begins[first : i + 1] - begins[first], False
                yield row + i, data[begins[i] : begins[i + 1]], begins[i : i + 2] - begins[i], True
                first = i + 1
            if first < len(begins) - 1:
                yield row + first, data[begins[first] :], begins[first:] - begins[first], False

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of the batch: (row of its first text, ids, offsets of each text into the ids). Null counts as empty."""
        for row, data, begins, marked in self._stretches(texts):
            if marked:
                ids = np.frombuffer(self._ids([data.tobytes().decode("utf-8", "replace")])[0], np.uint32)
                yield row, ids, np.array([0, len(ids)], np.int64)
                continue
            if not len(data):
                yield row, np.zeros(0, np.uint32), np.zeros(len(begins), np.int64)
                continue
            starts, ends = self._cuts(data, begins)
            key, check = span_hashes(data, starts, ends, fold=not self.spaced)
            distinct, where, inverse = np.unique(key, return_index=True, return_inverse=True)
            clash = not (check == check[where][inverse]).all()
            if clash:  # two pieces share a hash: no lookup for this slice
                where, inverse = np.arange(len(key)), np.arange(len(key))
            begin, count, known = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64), np.zeros(len(where), bool)
            for table in () if clash else self.known:
                table.find(distinct, check[where], begin, count, known)
            new = np.flatnonzero(~known)
            if len(new):
                raw = data.tobytes()
                pieces = [raw[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
                ids, n = self._encode_new(pieces)
                begin[new], count[new] = self.used + np.cumsum(n) - n, n
                self._put(ids)
                if not clash and sum(len(t.keys) for t in self.known) + len(new) <= KNOWN_PIECES:
                    self.used += len(ids)
                    self._remember(Known(distinct[new], check[where[new]], begin[new].astype(np.uint32), n.astype(np.uint32)))
            lengths = count[inverse]
            upto = np.concatenate([[0], np.cumsum(lengths)])
            flat = self.pool[np.repeat(begin[inverse] - upto[:-1], lengths) + np.arange(upto[-1])]
            yield row, flat, upto[np.searchsorted(starts, begins)]

    def _put(self, ids: np.ndarray) -> None:
        """Write ``ids`` behind what the pool holds; it grows by halves."""
        need = self.used + len(ids)
        if need > len(self.pool):
            pool = np.zeros(max(need, len(self.pool) * 3 // 2), np.uint32)
            pool[: self.used] = self.pool[: self.used]
            self.pool = pool
        self.pool[self.used : need] = ids

    def _remember(self, new: Known) -> None:
        large, small = self.known
        small = small.merged(new)
        if len(small.keys) > max(1 << 14, len(large.keys) // 4):
            large, small = large.merged(small), Known.empty()
        self.known = [large, small]


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """The worker's encoder for this vocabulary file."""
    key = (path, spaced)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, spaced)
    return _encoders[key]
