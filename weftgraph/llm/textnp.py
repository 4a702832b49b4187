"""Vectorised tokenising and shingling of batches of texts.

A batch is one byte buffer; words are the runs of bytes outside
``[\\x20\\x09-\\x0D]``. A word's hash sums finalised 8-byte chunks, each mixed
with its place, so no Python code runs per word, and unlike a polynomial modulo
2**64 it has no texts that collide by their structure.
"""

from __future__ import annotations

import numpy as np

from .runtime import worker_cache

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = bytes(int(c in _SPACES) for c in range(256))
#: The bytes of a little-endian 64-bit integer that a word of 0 to 8 bytes fills.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int):
    """A value for each byte, and powers of the base and of its inverse, at least ``n`` long."""
    cache = worker_cache()
    if "text_bytes" not in cache:
        cache["text_bytes"] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if len(cache.get("text_powers", ((),))[0]) < n:
        size = max(n, 1 << 20)
        powers = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            powers.append(np.multiply.accumulate(p))
        cache["text_powers"] = tuple(powers)
    return cache["text_bytes"], cache["text_powers"]


def word_hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes; ``data`` has 8 spare bytes at its end."""
    chunk = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    hashes = mix64((chunk[start] & _FILLED[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        of = np.repeat(np.arange(len(long)), more)
        at = np.cumsum(more) - more
        place = np.arange(len(of)) - at[of] + 1
        values = chunk[start[long][of] + 8 * place] & _FILLED[np.minimum(size[long][of] - 8 * place, 8)]
        parts = mix64(mix64(values) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        hashes[long] = mix64(hashes[long] + np.add.reduceat(parts, at))
    return hashes


def word_spans(texts: list[bytes], lower: bool = True):
    """(data, start, size, first): the texts' bytes with 8 spare ones, their words, and where each text's words begin."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=begin[1:])
    raw = b" ".join(texts) + b" "
    gap = np.frombuffer(raw.translate(_GAP), np.uint8)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    return (raw.translate(_LOWER) if lower else raw) + bytes(8), start, end - start, np.searchsorted(start, begin)


def words(texts: list[bytes], lower: bool = True, heads: tuple[int, ...] = ()):
    """Hashes of all words of ``texts`` in order, and where each text's words begin.

    Returns (hashes uint64, first int64[len(texts) + 1]) and, with ``heads``,
    for each given number of bytes (8 at most) the hashes of the beginnings of
    the words that are longer, and those words' indexes.
    """
    data, start, size, first = word_spans(texts, lower)
    hashes = word_hashes(data, start, size)
    if heads:
        longer = [np.flatnonzero(size > n) for n in heads]
        begun = [mix64(word_hashes(data, start[at], np.full(len(at), n)) + np.uint64(n << 32)) for n, at in zip(heads, longer, strict=True)]
        return hashes, first, list(zip(begun, longer, strict=True))
    return hashes, first


def runs_hash(hashes: np.ndarray, begin: np.ndarray, salt: int) -> np.ndarray:
    """The hash of each run of words that begins at ``begin`` and ends where the next one does; runs are not empty."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = np.diff(np.append(begin, len(hashes)))
    place = np.arange(begin[0], len(hashes)) - np.repeat(begin, size)
    mixed = mix64(hashes[begin[0] :] + (place + 1).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(salt))
    return mix64(np.add.reduceat(mixed, begin - begin[0]) + size.astype(np.uint64))


def owners(first: np.ndarray) -> np.ndarray:
    """The index of the text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ngrams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's k-word shingles and their texts' indexes, in order.

    A text of one to k - 1 words has its whole sequence as its only shingle.
    """
    n = np.diff(first)
    owner = owners(first)
    total = len(hashes)
    if total >= k:
        acc = np.zeros(total - k + 1, np.uint64)
        for j in range(k):
            acc *= np.uint64(_BASE)
            acc += hashes[j : total - k + 1 + j]
        inside = owner[: total - k + 1] == owner[k - 1 :]
        grams, of = mix64(acc[inside]), owner[: total - k + 1][inside]
    else:
        grams, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            nxt = whole * np.uint64(_BASE) + hashes[np.minimum(first[short] + j, total - 1)]
            whole = np.where(has, nxt, whole)
        grams = np.concatenate((grams, mix64(whole ^ n[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))))
        of = np.concatenate((of, short))
    return grams, of


def distinct(values: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's values begin."""
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    if len(values):
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        values, of = values[keep], of[keep]
    first = np.zeros(texts + 1, np.int64)
    np.cumsum(np.bincount(of, minlength=texts), out=first[1:])
    return values, first


def shingle_sets(texts: list[bytes], k: int = 5):
    """The set of k-word shingles of each lower-cased text: (values, first)."""
    hashes, first = words(texts)
    grams, of = ngrams(hashes, first, k)
    return distinct(grams, of, len(texts))


def segments(values: np.ndarray, first: np.ndarray, how) -> np.ndarray:
    """``how.reduceat`` over every text's values; 0 where a text has none."""
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = how.reduceat(values, first[full])
    return out


def set_ids(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit identity for each text's set of values, as two arrays of signed integers."""
    n = np.diff(first).astype(np.uint64)
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0x5851F42D4C957F2D):
        total = segments(mix64(values ^ np.uint64(salt)), first, np.add)
        out.append(mix64(total + n * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64))
    return out[0], out[1]


def node_of(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """One integer of a 128-bit identity: ``a``, changed by ``b`` turned by ``turn`` bits where that is not 0 (see ``links.exact_nodes``)."""
    if not turn:
        return a
    u = b.view(np.uint64)
    return a ^ ((u << np.uint64(turn)) | (u >> np.uint64(64 - turn))).view(np.int64)


class Repeats:
    """Counts the members of sets over about ``most`` members at a time; keeps those that ``local`` sets or more hold."""

    def __init__(self, local: int, most: int = 1_000_000):
        self.local, self.most, self.parts, self.size = local, most, [], 0

    def add(self, values: np.ndarray) -> bool:
        """Whether it is time to ``take``."""
        self.parts.append(values)
        self.size += len(values)
        return self.size > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(members, counts) since the last time."""
        members, n = np.unique(np.concatenate(self.parts or [np.zeros(0, np.uint64)]), return_counts=True)
        self.parts, self.size = [], 0
        often = n >= self.local
        return members[often].view(np.int64), n[often].astype(np.int64)


def blocks(batch, limit: int = 500_000):
    """Split rows of (…, bytes) columns into index ranges of about ``limit`` bytes of text."""
    size, begin = 0, 0
    for i, text in enumerate(batch):
        if size and size + len(text) > limit:
            yield begin, i
            size, begin = 0, i
        size += len(text) + 1
    if begin < len(batch):
        yield begin, len(batch)


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
