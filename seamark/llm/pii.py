"""Personal data: base patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IP addresses, payment cards and phone
numbers in their plain forms. The semi-Markov CRF adds forms that patterns
miss, such as phone numbers without a plus sign. It looks at islands, runs of
neighbouring tokens with a digit or an at sign, cut into atoms (digit runs,
letter runs, single signs). Every span of up to ``MAX_ATOMS`` atoms is a
candidate segment with features of the whole span: its shape, digit count and
grouping, checksum, ends and surroundings. A dynamic program over the atoms
chooses boundaries and types together over the whole island, however long it
is and however many entities it holds.

The weights are trained here by maximising the conditional likelihood
(forward-backward over segmentations) on generated islands, both of personal
data in the forms of many countries and of look-alikes: dates, versions,
prices, book numbers, coordinates, keys and plain numbers.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 16
#: Atoms whose segments are scored together; no bound on what is found.
BLOCK = 256
#: Log-odds against plain text that an added span needs.
MARGIN = 0.5
_BUCKETS = 1 << 14

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; matches that fail their check are dropped."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- islands, atoms and features

_ISLAND = re.compile(r"(?<!\S)\S*[0-9@]\S*(?:[ \t]{1,3}\S*[0-9@]\S*)*")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_CUES = ("tel", "phone", "call", "fax", "mobil")
_PHONE_WORDS = frozenset(
    "tel telephone telefon telefono teléfono téléphone tél phone mobile mobil móvil movil portable handy cell call ring dial fax whatsapp sms text hotline "
    "llame llamar appelez appeler rufen anrufen chiama cellulare numéro numero nummer".split()
)


def _feature(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=4).digest(), "little") % _BUCKETS


@functools.lru_cache(maxsize=200_000)
def _cached_feature(name: str) -> int:
    return _feature(name)


def _shape(atoms: list[str]) -> str:
    return "".join(str(min(len(a), 9)) if a[0].isdigit() else "a" if a[0].isalpha() else "_" if a.isspace() else a for a in atoms)


def span_features(atoms: list[str], i: int, j: int, before: str) -> list[int]:
    """Features of the whole span ``atoms[i:j]``."""
    own = atoms[i:j]
    text = "".join(own)
    shape = _shape(own)
    groups = [len(a) for a in own if a[0].isdigit()]
    n = sum(groups)
    signs = "".join(sorted({a for a in own if not a[0].isalnum()}))
    prev = atoms[i - 1] if i else " "
    nxt = atoms[j] if j < len(atoms) else " "
    side = [("d" if a[0].isdigit() else "a" if a[0].isalpha() else "s" if a.isspace() else a[0]) for a in (prev, nxt)]
    names = [
        "shape:" + (shape if len(shape) <= 24 else "long"),
        f"groups:{'.'.join(map(str, groups[:6]))}",
        f"digits:{min(n, 24)}",
        f"signs:{signs[:6]}",
        f"left:{side[0]}",
        f"right:{side[1]}",
        f"ends:{shape[:1]}{shape[-1:]}",
        f"letters:{any(a[0].isalpha() for a in own)}:{'@' in text}",
        f"luhn:{16 <= n <= 19 and luhn(_digits(text))}:{n if 16 <= n <= 19 else 0}",
        f"octets:{len(groups) == 4 and signs == '.' and all(int(a[-6:]) < 256 for a in own if a[0].isdigit())}",
        f"cue:{before in _PHONE_WORDS}:{min(n, 16)}:{min(len(groups), 6)}",
        f"lead:{text.lstrip('(')[:1] == '0'}:{text[:2] == '00'}:{min(n, 16)}:{min(len(groups), 6)}",
        f"domain:{bool(re.search(r'@[a-z0-9-]+(?:[.][a-z0-9-]+)+$', text.lower()))}",
    ]
    return [_cached_feature(x) for x in names]


def _segments(atoms: list[str], before: str, first: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and feature ids of the candidate segments that start from ``first`` to before ``stop``."""
    starts, ends, feats = [], [], []
    for i in range(first, len(atoms) if stop is None else min(stop, len(atoms))):
        if atoms[i].isspace():
            continue
        for j in range(i + 1, min(len(atoms), i + MAX_ATOMS) + 1):
            if atoms[j - 1].isspace():
                continue
            text = atoms[i:j]
            if not any(x[0].isdigit() or x == "@" for x in text):
                continue
            starts.append(i)
            ends.append(j)
            feats.append(span_features(atoms, i, j, before))
    return np.array(starts, int), np.array(ends, int), np.array(feats, int).reshape(len(starts), len(feats[0]) if feats else 1)


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(np.exp(np.array(values) - top).sum()))


def _forward_backward(n: int, starts: np.ndarray, ends: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Probability of every segment and kind over all segmentations (plain atoms score 0)."""
    into: list[list[int]] = [[] for _ in range(n + 1)]
    outof: list[list[int]] = [[] for _ in range(n + 1)]
    whole = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    for s, (i, j) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        into[j].append(s)
        outof[i].append(s)
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        ahead[j] = _log_add([ahead[j - 1], *(ahead[starts[s]] + whole[s] for s in into[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = _log_add([behind[i + 1], *(behind[ends[s]] + whole[s] for s in outof[i])])
    return np.exp(ahead[starts][:, None] + scores + behind[ends][:, None] - ahead[n])


# --- training data


def _word(rng: np.random.Generator) -> str:
    return "".join(rng.choice(list("aeiou" if k % 2 else "bcdfglmnprst")) for k in range(int(rng.integers(2, 8))))


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(str(int(d)) for d in [rng.integers(1, 10), *rng.integers(0, 10, n - 1)])


def _card(rng: np.random.Generator) -> str:
    body = _number(rng, int(rng.integers(15, 19)) if rng.random() < 0.85 else 14)
    return body + next(str(c) for c in range(10) if luhn(body + str(c)))


# Forms of phone numbers without a plus sign, by country: 0 to 9 as they stand, x any digit, y one of 2 to 9.
_PHONE_FORMS = (
    # North America, with and without area code
    "(yxx) yxx-xxxx", "(yxx)yxx-xxxx", "yxx-yxx-xxxx", "yxx.yxx.xxxx", "yxx yxx-xxxx", "yxx yxx xxxx", "1-yxx-yxx-xxxx", "1 (yxx) yxx-xxxx", "yxx-xxxx", "yxxyxxxxxx",
    # Britain and Ireland
    "020 yxxx xxxx", "(020) yxxx xxxx", "01xx xxx xxxx", "01xxx xxxxxx", "07xxx xxxxxx", "07xxx xxx xxx", "0800 xxx xxx", "01 xxx xxxx",
    # France
    "0x xx xx xx xx", "0x.xx.xx.xx.xx", "0x-xx-xx-xx-xx", "0xxxxxxxxx",
    # Germany, Austria, Switzerland
    "0y0 xxxxxx", "0y0 xxxxxxx", "0y0/xxxxxxx", "0y0-xxxxxxx", "(0y0) xxxxxxx", "0yxxx xxxxxx", "0yxxx/xxxxxx", "015x xxxxxxxx", "017x xxxxxxx", "04x xxx xx xx",
    # Spain, Italy, Portugal
    "9xx xxx xxx", "9xx xx xx xx", "6xx xxx xxx", "6xx xx xx xx", "9xxxxxxxx", "06 xxxx xxxx", "02 xxxxxxxx", "3xx xxxxxxx", "21x xxx xxx",
    # Netherlands, Belgium, Nordic countries, Poland
    "020-xxxxxxx", "06-xxxxxxxx", "04xx xx xx xx", "08-xxx xxx xx", "070-xxx xx xx", "xx xx xx xx", "0xx xxx xxxx", "6xx-xxx-xxx",
    # Asia, Oceania, Latin America
    "03-xxxx-xxxx", "090-xxxx-xxxx", "0xx-xxxx-xxxx", "yxxxx xxxxx", "(0x) xxxx xxxx", "04xx xxx xxx", "(11) 9xxxx-xxxx", "(xx) xxxx-xxxx", "55 xxxx xxxx",
    # international prefix in digits
    "00yx xx xxxx xxxx", "0033 x xx xx xx xx", "0049 yxx xxxxxxx", "011 yx xxx xxx xxx", "+yx (0)xx xxxx xxxx",
)


def _phone(rng: np.random.Generator) -> str:
    form = _PHONE_FORMS[int(rng.integers(0, len(_PHONE_FORMS)))]
    if rng.random() < 0.25:  # an area code and a number in groups of any lengths
        area, rest = "0" + "yxxx"[: int(rng.integers(1, 5))], "x" * int(rng.integers(6, 9))
        cut = int(rng.integers(2, 5))
        form = (f"({area})" if rng.random() < 0.25 else area) + " /-"[int(rng.integers(0, 3))] + (rest if rng.random() < 0.4 else rest[:cut] + " " + rest[cut:])
    return "".join(str(int(rng.integers(0, 10))) if c == "x" else str(int(rng.integers(2, 10))) if c == "y" else c for c in form)


def example(rng: np.random.Generator) -> tuple[str, str, list[tuple[int, str]]]:
    """(word before, island, [(kind, text)]): an island with personal data or look-alikes."""
    before, entities, parts = _word(rng), [], []
    for _ in range(int(rng.integers(1, 3))):
        kind = int(rng.integers(0, 9))
        if kind == 0:
            text = f"{_word(rng)}.{_number(rng, 2)}@{_word(rng)}{_number(rng, 1)}.{_word(rng)}.com" if rng.random() < 0.5 else f"{_word(rng)}@{_word(rng)}.org"
        elif kind == 1:
            text = ".".join(str(x) for x in rng.integers(0, 256, 4))
        elif kind == 2:
            d = _card(rng)
            sep = ("", " ", "-", ".", "/")[int(rng.integers(0, 5))]
            cuts = (4, 10) if len(d) == 15 else range(4, len(d), 4)
            text = sep.join(d[i:j] for i, j in zip((0, *cuts), (*cuts, len(d)), strict=True)) if sep else d
        elif kind == 3:
            text = _phone(rng)
        else:
            year = str(int(rng.integers(1900, 2030)))
            wrong = _card(rng)
            wrong = wrong[:-1] + str((int(wrong[-1]) + int(rng.integers(1, 10))) % 10)
            shapes = (
                wrong,
                " ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)),
                _number(rng, int(rng.integers(1, 15))),
                _number(rng, 16)[:-1] + "x",
                f"{rng.integers(1, 13)}.{rng.integers(0, 20)}.{rng.integers(0, 30)}",
                f"{rng.integers(1, 13)}.{rng.integers(0, 20)}.",
                f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{year}",
                f"{year}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
                f"{year}-{year}",
                f"${rng.integers(1, 999)}.{rng.integers(10, 99)}",
                f"AKIA{_word(rng).upper()}{_number(rng, 3)}{_word(rng).upper()}{_number(rng, 2)}",
                f"password={hashlib.md5(_word(rng).encode()).hexdigest()[:18]}",
                f'"{hashlib.sha1(_word(rng).encode()).hexdigest()}"',
                f"{rng.integers(1, 23)}:{rng.integers(10, 59)}",
                f"@{_word(rng)}",
                f"{_word(rng)}{_number(rng, 2)}",
                f"{_number(rng, 1)},{_number(rng, 3)},{_number(rng, 3)}",
                f"{_number(rng, 5)}-{_number(rng, 4)}",
                f"{_number(rng, 4)} {_number(rng, 3)} {_number(rng, 2)}",
                f"({_number(rng, 2)})",
                f"{_number(rng, int(rng.integers(1, 4)))} {_number(rng, 3)} {_number(rng, 3)}",
                f"{_number(rng, int(rng.integers(1, 4)))} {_number(rng, int(rng.integers(1, 4)))}",
                f"{_number(rng, 2)} {_number(rng, 2)} {_number(rng, 2)}",
                f"978-{_number(rng, 1)}-{_number(rng, 2)}-{_number(rng, 6)}-{_number(rng, 1)}",
                f"{_number(rng, 2)}.{_number(rng, 4)}, {_number(rng, 1)}.{_number(rng, 4)}",
                f"{_number(rng, 3)}-{_number(rng, 2)}",
                f"#{_number(rng, 7)}",
                f"{_word(rng)}-{_number(rng, 4)}-{_number(rng, 4)}",
                f"{year}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 23)}:{rng.integers(10, 59)}:{rng.integers(10, 59)}",
                f"{_number(rng, 3)},{_number(rng, 3)}.{_number(rng, 2)}",
                f"{_number(rng, 2)}%",
                f"{rng.integers(1, 9)}-{rng.integers(1, 9)}",
            )
            text, kind = shapes[int(rng.integers(0, len(shapes)))], -1
        if kind >= 0:
            entities.append((kind, text))
        parts.append(text + (",", ".", "", "", "")[int(rng.integers(0, 5))])
    if any(k == 3 for k, _ in entities) and rng.random() < 0.35:
        before = _CUES[int(rng.integers(0, len(_CUES)))]
    return before, " ".join(parts), entities


@functools.lru_cache(maxsize=2)
def train(examples: int = 2000, epochs: int = 5, seed: int = 7) -> np.ndarray:
    """Weights (feature bucket, kind), by AdaGrad on the conditional log-likelihood."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(examples):
        before, island, entities = example(rng)
        atoms = _ATOM.findall(island)
        starts, ends, feats = _segments(atoms, before)
        if not len(starts):
            continue
        at = np.concatenate([[0], np.cumsum([len(a) for a in atoms])])
        gold = np.zeros((len(starts), len(KINDS)))
        from_char = 0
        for kind, text in entities:
            lo = island.index(text, from_char)
            from_char = lo + len(text)
            gold[(at[starts] == lo) & (at[ends] == from_char), kind] = 1
        data.append((len(atoms), starts, ends, feats, gold))
    weights = np.full((_BUCKETS, len(KINDS)), 0.0)
    seen = np.full_like(weights, 1e-2)
    bias = _cached_feature("bias")
    weights[bias] = -6.0
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            n, starts, ends, feats, gold = data[k]
            scores = weights[feats].sum(axis=1) + weights[bias]
            slope = gold - _forward_backward(n, starts, ends, scores)
            active = np.flatnonzero(np.abs(slope).max(axis=1) > 1e-4)
            if not len(active):
                continue
            ids = feats[active].reshape(-1)
            uniq, where = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(uniq), len(KINDS)))
            np.add.at(grad, where, np.repeat(slope[active], feats.shape[1], axis=0))
            grad -= 2e-3 * weights[uniq]
            seen[uniq] += grad**2
            weights[uniq] += 0.3 * grad / np.sqrt(seen[uniq])
    return weights


def decode(atoms: list[str], before: str, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """The best segmentation of all ``atoms``: (kind, first atom, end atom, score).

    Segments are scored in blocks of starts, and only those that beat plain
    text are kept, so memory follows the island's length.
    """
    n, bias = len(atoms), weights[_cached_feature("bias")]
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    for first in range(0, n, BLOCK):
        starts, ends, feats = _segments(atoms, before, first, first + BLOCK)
        if not len(starts):
            continue
        scores = weights[feats].sum(axis=1) + bias
        kinds, best = scores.argmax(axis=1), scores.max(axis=1)
        for s in np.flatnonzero(best > 0).tolist():
            into[ends[s]].append((int(starts[s]), int(kinds[s]), float(best[s])))
    value = [0.0] * (n + 1)
    back: list[tuple[int, int, float] | None] = [None] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for segment in into[j]:
            v = value[segment[0]] + segment[2]
            if v > value[j]:
                value[j], back[j] = v, segment
    out, j = [], n
    while j > 0:
        segment = back[j]
        if segment is None:
            j -= 1
        else:
            out.append((segment[1], segment[0], j, segment[2]))
            j = segment[0]
    return out[::-1]


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Spans of the model that overlap no base span and beat plain text by ``MARGIN``."""
    out: list[Span] = []
    taken = sorted((s, e) for _, s, e in base)
    for m in _ISLAND.finditer(text):
        lo = m.start()
        before = text[max(0, lo - 24) : lo].split()
        word = before[-1].strip(".:,;()").lower() if before else ""
        # cut at base spans: what they cover is settled
        edges = [lo]
        for s, e in taken:
            if e > lo and s < m.end():
                edges += [max(s, lo), min(e, m.end())]
        edges.append(m.end())
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            atoms = _ATOM.findall(text[a:b])
            at = np.concatenate([[0], np.cumsum([len(x) for x in atoms])]) + a
            for kind, i, j, score in decode(atoms, word, weights):
                if score >= MARGIN:
                    out.append((kind, int(at[i]), int(at[j])))
            word = ""
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``.

    The counts and the hash are of the base matches; ``spans`` has these and
    the model's. Offsets are code points, ends exclusive. A null or empty text
    has none. Ids pass through, null or repeated; other columns are not read.
    An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    weights = docs.sparkSession.sparkContext.broadcast(train().astype(np.float32))  # 2**14 by 4 at any data size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                counts: list[list[int]] = [[], [], [], []]
                digests, spans = [], []
                for text in part.column(1).to_pylist():
                    base = base_spans(text) if text else []
                    for k in range(4):
                        counts[k].append(sum(1 for s in base if s[0] == k))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(base + added_spans(text, base, w)) if text else "")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    schema = f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(id_col, text_col).mapInArrow(rows, schema)
