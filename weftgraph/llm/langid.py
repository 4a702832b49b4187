"""Language identification by cross-parsing entropy.

A suffix automaton of some labelled text per language gives the longest match
from any position. A text is parsed greedily into the longest phrases that the
automaton holds; the language that needs the fewest phrases, normalised by the
size of its training text (a phrase points into it), wins. A letter that the
training text has not is a phrase of its own and costs ``LITERAL`` bits more. Transitions lie in one array, each state's at
an offset where they meet no other's, so every letter is a symbol of its own.

Texts are read as lower-case letters; a run of other characters is one space.
All texts of a block are parsed in step, in lanes of ``LANE`` characters. A lane
is first parsed as if a phrase began with it and then again from the state that
the lane before it ends in, until both parses begin a phrase at one place; so
the phrases are those of one parse from the text's beginning.

Results by case: a text that is null or has no letter is ``und`` with score 0;
of languages that need equally many phrases the first by name wins; with no
labelled text at all every document is ``und``; repeated rows are judged each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import claim, small_batches, worker_cache
from .textnp import blocks

LANE = 256
LITERAL = 20.0
UNKNOWN = "und"


def training_sample(docs: DataFrame, usable, chars: int = 32_000, seed: int = 5, most_languages: int = 4096) -> dict[str, str]:
    """A bounded sample: documents of every language, up to ``chars`` characters each, and a quarter of that from one document.

    Documents are taken in a seeded hash order; of a longer one the first quarter
    of ``chars`` counts. Over 256 languages share what 256 would have. Ids and
    lengths of some 2,000 documents of each language (500,000 in all) and then
    the chosen texts come to the driver.
    """
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return {}
    chars = chars * 256 // max(256, len(counts))
    drawn, part = max(100.0, 500_000.0 / max(250, len(counts))), chars // 4
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, drawn / n)])
    narrow = rows.select("doc_id", "lang", F.least(F.length("text"), F.lit(part)).alias("n"), unit.alias("u")).where(F.col("u") < F.element_at(shares, F.col("lang")))
    left = dict.fromkeys(counts, chars)
    chosen: dict = {}
    for r in sorted(narrow.limit(int(2 * drawn) * len(counts)).collect(), key=lambda r: (r["u"], repr(r["doc_id"]), r["n"])):
        if r["doc_id"] is not None and r["n"] <= left[r["lang"]]:
            left[r["lang"]] -= r["n"]
            chosen[r["doc_id"]] = r["n"]
    texts: dict[str, list] = {}
    heads = F.substring("text", 1, part).alias("text")
    for r in rows.where(F.col("doc_id").isin(list(chosen))).select("doc_id", "lang", heads).distinct().collect():
        texts.setdefault(r["lang"], []).append((r["doc_id"], r["text"]))
    return {lang: "\n".join(dict(sorted(found)).values())[: chars + len(found)] for lang, found in sorted(texts.items())}


def _letters():
    """Per code point: is it a letter, and its lower-case form."""
    cache = worker_cache()
    if "letters" not in cache:
        points = range(0x110000)
        alpha = np.zeros(0x110000, bool)
        lower = np.arange(0x110000, dtype=np.int32)
        for i in points:
            c = chr(i)
            if c.isalpha():
                alpha[i] = True
                low = c.lower()
                if len(low) == 1 and low != c:
                    lower[i] = ord(low)
        cache["letters"] = (alpha, lower)
    return cache["letters"]


def normalise(text: str) -> np.ndarray:
    """Code points in lower case; every run of non-letters is one 0."""
    alpha, lower = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter = alpha[points]
    out = np.where(letter, lower[points], 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return out[keep]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton's states; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def _placed(symbols: list[int], alphabet: int):
    """(root, base, owner, to): an automaton as arrays; a state's transition by c is ``to[base[state] + c]`` if ``owner`` says that this place is the state's.

    The root, state 0, is the state between two phrases and has its own table.
    """
    step = automaton(symbols)
    root = np.zeros(alphabet, np.int32)
    for c, s in step[0].items():
        root[c] = s
    size = 2 * alphabet + 2 * sum(map(len, step)) + 1
    used = bytearray(size)
    base = np.zeros(len(step), np.int32)
    owner, to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    last = free = alphabet  # states of several transitions are placed one after the other, the others fill the holes
    for state in sorted(range(1, len(step)), key=lambda i: -len(step[i])):
        out = step[state]
        if not out:
            break
        least, *others = sorted(out)
        if others:
            at = last
            while used[at] or any(used[at - least + c] for c in others):
                at += 1
                if at + alphabet >= len(used):
                    used.extend(bytes(size))
                    owner, to = (np.concatenate((v, np.full(size, w, np.int32))) for v, w in ((owner, -1), (to, 0)))
            last = at
        else:
            while used[free]:
                free += 1
            at = free
        base[state] = at - least
        for c, s in out.items():
            used[at - least + c] = 1
            owner[at - least + c], to[at - least + c] = state, s
    top = int(base.max(initial=0)) + alphabet
    return root, base, owner[:top], to[:top]


class Parsers:
    """Some languages' automata in common arrays; states are numbered through."""

    def __init__(self, training: list[list[int]], alphabet: int):
        self.alphabet, parts, states, places = alphabet, [], 0, 0
        self.roots = []
        for symbols in training:
            root, base, owner, to = _placed(symbols, alphabet)
            parts.append((root + states, base + places, np.where(owner < 0, -1, owner + states), to + states))
            self.roots.append(states)
            states, places = states + len(base), places + len(owner)
        self.root, self.base, self.owner, self.to = (np.concatenate(v).astype(np.int32) for v in zip(*parts, strict=True))

    def step(self, language: np.ndarray, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after c, and where a phrase begins with c; ``language`` is its number times the size of the alphabet."""
        at = self.base[state] + c
        begins = self.owner[at] != state
        return np.where(begins, self.root[language + c], self.to[at]), begins


class Model:
    """The automata of a training sample, ``together`` languages at a time."""

    def __init__(self, sample: dict[str, str], together: int = 8):
        self.names = list(sample)
        texts = [normalise(t) for t in sample.values()]
        points = np.unique(np.concatenate([t[t > 0] for t in texts] or [np.zeros(0, np.int64)]))
        self.symbol = np.full(0x110000, 1, np.int32)  # 0: space, 1: any letter that no training text has
        self.symbol[0] = 0
        self.symbol[points] = np.arange(2, 2 + len(points))
        training = [self.symbol[t].tolist() for t in texts]
        self.parsers = [Parsers(training[i : i + together], 2 + len(points)) for i in range(0, len(training), together)]
        self.known = [np.isin(np.arange(2 + len(points)), t) for t in training]
        self.bits = np.array([np.log2(max(2, len(t))) for t in texts])

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and its number of letters and spaces."""
        seqs = [self.symbol[normalise(t)] for t in texts]
        sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
        lanes = -(-sizes // LANE)
        doc = np.repeat(np.arange(len(seqs)), lanes)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        length = np.minimum(LANE, sizes[doc] - number * LANE)
        begin = (np.cumsum(sizes) - sizes)[doc] + number * LANE
        flat = np.concatenate([*seqs, np.zeros(LANE, np.int32)])
        padded = np.ascontiguousarray(flat[begin[:, None] + np.arange(LANE)[None, :]].T) if len(doc) else np.zeros((LANE, 0), np.int32)
        counts = [row for p in self.parsers for row in phrases(p, padded, length, number)]
        if not counts:
            return np.zeros((0, len(texts))), sizes
        total = np.stack([np.bincount(doc, weights=row, minlength=len(texts)) for row in counts]) * self.bits[:, None]
        owner, flat = np.repeat(np.arange(len(seqs)), sizes), flat[: len(flat) - LANE]
        for i, known in enumerate(self.known):
            total[i] += LITERAL * np.bincount(owner[~known[flat]], minlength=len(texts))
        return total / np.maximum(sizes, 1), sizes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score: the softmax of its costs' margins over 12 characters."""
        costs, sizes = self.costs(texts)
        if not len(costs):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = costs.argmin(axis=0)
        score = 1 / np.exp(-12 * (costs - costs.min(axis=0))).sum(axis=0)
        names = [self.names[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)]
        return names, np.where(sizes > 0, score, 0.0)


def phrases(parsers: Parsers, lanes: np.ndarray, length: np.ndarray, number: np.ndarray) -> np.ndarray:
    """int[language, lane]: how many phrases begin in each lane; ``lanes`` is [character, lane], and lanes of ``number`` > 0 go on from the one before."""
    n, many = len(length), len(parsers.roots)
    order = np.argsort(-length, kind="stable")
    active = n - np.searchsorted(np.sort(length), np.arange(LANE), "right")
    state = np.repeat(np.array(parsers.roots, np.int32)[:, None], n, axis=1)
    language = np.arange(many)[:, None] * parsers.alphabet
    begins = np.zeros((LANE, many, n), bool)
    sorted_lanes = np.ascontiguousarray(lanes[:, order])
    for t in range(LANE):
        m = active[t]
        if not m:
            break
        state[:, :m], begins[t, :, :m] = parsers.step(language, state[:, :m], sorted_lanes[None, t, :m])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    begins, last = np.ascontiguousarray(begins[:, :, place]).reshape(LANE, many * n), state[:, place].reshape(-1)

    # from here on a lane of a language is one number; its state before is that after the lane before it
    column, size, follows = np.tile(np.arange(n), many), np.tile(length, many), np.tile(number > 0, many)
    language = np.repeat(np.arange(many) * parsers.alphabet, n)
    redo = np.flatnonzero(follows & (np.roll(last, 1) != np.repeat(np.array(parsers.roots, np.int32), n)))
    known: dict = {}  # what lanes of equal text and state before came to; long repetitive texts have many
    while len(redo):
        before = last.copy()
        entry, lane = last[redo - 1], redo
        if len(redo) < n:
            keys = [(e, s, lanes[:, c].tobytes()) for e, s, c in zip(entry.tolist(), size[lane].tolist(), column[lane].tolist(), strict=True)]
            for key, i in zip(keys, lane.tolist(), strict=True):
                if key in known:
                    last[i], begins[:, i] = known[key]
            open_ = np.array([key not in known for key in keys], bool)
            lane, state, keys = lane[open_], entry[open_], [k for k in keys if k not in known]
        else:
            state, keys = entry, []
        done = lane
        for t in range(LANE):
            ends = size[lane] == t
            if ends.any():
                last[lane[ends]] = state[ends]
                lane, state = lane[~ends], state[~ends]
            if not len(lane):
                break
            state, new = parsers.step(language[lane], state, lanes[t, column[lane]])
            apart = ~(new & begins[t, lane])  # where both begin a phrase, the rest is known
            begins[t, lane] = new
            lane, state = lane[apart], state[apart]
        last[lane] = state
        for key, i in zip(keys, done.tolist()):
            known[key] = (last[i], begins[:, i].copy())
        after = redo[last[redo] != before[redo]] + 1
        after = after[after < len(last)]
        redo = after[follows[after]]
    return begins.sum(0).reshape(many, n)


def _model(sample: dict[str, str]) -> Model:
    cache = worker_cache()
    key = ("langid", hashlib.sha256(repr(sample).encode()).digest())
    if key not in cache:
        cache[key] = Model(sample)
    return cache[key]


def identify(docs: DataFrame, sample: dict[str, str], keep: tuple[str, ...] = (), block: int = 2_000_000) -> DataFrame:
    """(doc_id, *keep, lang_pred, score). A narrow pass; the sample's text goes to the workers, which build the automata once each."""
    keep = tuple(k for k in keep if k not in ("doc_id", "text"))

    def run(batches):
        import pyarrow as pa

        claim("langid")
        model = _model(sample)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for a, b in blocks(texts, block):
                names, score = model.predict(texts[a:b])
                own = [batch.column(c).slice(a, b - a) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    columns = ["doc_id", *keep]
    selected = small_batches(docs).select(*columns, "text")
    kinds = ", ".join(f"`{c}` {selected.schema[c].dataType.simpleString()}" for c in columns)
    return selected.mapInArrow(run, f"{kinds}, lang_pred string, score double")
