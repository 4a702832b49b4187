"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct words of a block of texts are laid out as one linked list of
symbols. An index maps each mergeable pair (by its rank) to all its positions
in the block; the active ranks are applied in ascending order, every position
of a rank at once, and each merge adds the pairs that it makes to their lists.
A merge can only make pairs of a higher rank, because a pair that holds a
merged symbol was learnt after that symbol; so one ascending pass is enough.

Results by case: null and empty text give no tokens and an empty decoded text;
repeated rows are encoded each; an empty table gives an empty result; other
input columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
from pyspark.sql import DataFrame

from .runtime import claim, small_batches, worker_cache
from .textnp import blocks

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
_NONE = np.int32(2**31 - 1)


def vocabulary_path(name_or_path: str = DEFAULT_VOCABULARY) -> str:
    """A path as it is; a bare name is one of the installed public vocabularies."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks, byte symbols, special tokens and the bytes of every id."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        ids = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64)
        self.pair_order = np.argsort(pairs)
        self.pairs = pairs[self.pair_order]
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.doubled = np.array([a == b for a, b in merges], bool)
        self.byte_ids = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        spelled = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        spelled |= {i: content.encode() for content, i in self.special.items()}
        table = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.token_size = np.fromiter(map(len, table), np.int64, len(table))
        self.token_at = np.concatenate(([0], np.cumsum(self.token_size)))[:-1]
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_order[at], _NONE).astype(np.int32)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        stop = np.cumsum(size)
        symbol = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(symbol)
        following = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        following[stop[size > 0] - 1] = -1
        before[(stop - size)[size > 0]] = -1
        rank_at = np.full(n, _NONE, np.int32)
        inner = np.flatnonzero(following >= 0)
        rank_at[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray) -> None:
            found = rank_at[positions]
            has = found != _NONE
            if not has.any():
                return
            positions, found = positions[has], found[has]
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            begins = [0, *cuts.tolist()]
            for a, b, r in zip(begins, [*cuts.tolist(), len(found)], found[begins].tolist(), strict=True):
                if r in index:
                    index[r].append(positions[a:b])
                else:
                    index[r] = [positions[a:b]]
                    heapq.heappush(active, r)

        add(inner)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            if self.doubled[rank] and len(at) > 1:  # in runs of one symbol, every second pair from the left
                at = np.sort(at)
                fresh = np.ones(len(at), bool)
                fresh[1:] = following[at[:-1]] != at[1:]
                run = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff([*run, len(at)]))) % 2 == 0]
            gone = following[at]
            symbol[at] = self.merged[rank]
            symbol[gone] = -1
            rank_at[gone] = _NONE
            after = following[gone]
            following[at] = after
            inside = after >= 0
            before[after[inside]] = at[inside]
            rank_at[at] = _NONE
            left, right = before[at], at[inside]
            left = left[left >= 0]
            rank_at[right] = self.ranks(symbol[right], symbol[following[right]])
            rank_at[left] = self.ranks(symbol[left], symbol[following[left]])
            add(np.unique(np.concatenate((left, right))))
        alive = symbol >= 0
        count = np.concatenate(([0], np.cumsum(alive)))
        ids = symbol[alive].astype("<u4").tobytes()
        cut = (count[np.concatenate(([0], stop))] * 4).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def decode(self, ids: bytes, piece: int = 200_000) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        every = np.frombuffer(ids, "<u4")
        out = []
        for i in range(0, len(every), piece):
            part = every[i : i + piece]
            size = self.token_size[part]
            ends = np.cumsum(size)
            out.append(self.token_bytes[np.arange(ends[-1]) + np.repeat(self.token_at[part] - (ends - size), size)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    cache = worker_cache()
    key = ("bpe", path)
    if key not in cache:
        cache[key] = Vocabulary(path)
    return cache[key]


def encode_texts(texts: list[str], path: str, remember: int = 250_000) -> list[bytes]:
    """The ids of each text. Up to ``remember`` distinct words stay encoded for the next block."""
    v = vocabulary(path)
    known: dict[str, bytes] = worker_cache().setdefault(("bpe words", path), {})
    split = []
    fresh: dict[str, None] = {}
    for text in texts:
        parts = v.special_split.split(text) if v.special_split else [text]
        pieces = []
        for i, part in enumerate(parts):
            if i % 2:
                pieces.append(part)
            else:
                pieces += v.pattern.findall(part)
        split.append(pieces)
        fresh |= dict.fromkeys(set(pieces).difference(known))
    for content, i in v.special.items():
        fresh.pop(content, None)
        known[content] = i.to_bytes(4, "little")
    todo = list(fresh)
    known.update(zip(todo, v.encode_words(todo), strict=True))
    out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
    if len(known) > remember:
        known.clear()
    return out


def encode_decode(docs: DataFrame, path: str = DEFAULT_VOCABULARY, decode: bool = True, block: int = 1_500_000) -> DataFrame:
    """(doc_id, ids, decoded): each text's ids, little-endian unsigned 32-bit, and what they decode to.

    A narrow pass without a shuffle. A worker holds one block of texts, its
    distinct words and a bounded table of encoded words.
    """

    def run(batches):
        import pyarrow as pa

        claim("bpe")
        where = vocabulary_path(path)
        v = vocabulary(where)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for a, b in blocks(texts, block):
                ids = encode_texts(texts[a:b], where)
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([v.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decode)
