"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct 5-word shingles. A parity sketch XORs the
hashes of a set's members into blocks; two sets that differ in d members differ
in at most d blocks, so sets of Jaccard similarity j or more, which differ in at
most D = (1 - j) / (1 + j) * (|A| + |B|) members, agree in a block as soon as one
of them fills more than D blocks. The number of blocks depends on the size band
of the smaller set, so a document signs in its own band and, where a smaller
partner can be in the band below, in that one too.

Members that very many documents hold (``frequent``) are left out of the blocks:
leaving members out only shortens the distance. A document that then fills too
few blocks for the argument signs a second time with all members, and two such
documents meet there. One that fills too few then, as its members fall into the
same blocks, signs again with twice as many blocks, up to ``_RAISES`` times, and
at last with each member; two linked documents that come to that share a member.
So the argument holds for each set, and no link is lost.

Candidates that share a block are compared by bit sketches, whose Hamming
distance is a lower bound of the difference, then exactly (see ``links``).

Results by case: a null text or one without words has an empty set and links
with nothing; a text of fewer words than a shingle has its word sequence as its
only member; equal sets always link; repeated rows are kept each; an empty table
gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import IdFilter, bit_sketch, exact_nodes, grouped, ranked, resolve
from .runtime import claim, cut, freed, small_batches
from .textnp import Repeats, blocks, mix64, node_of, set_ids, shingle_sets, text_bytes

SHINGLE, NUMERATOR, DENOMINATOR = 5, 3, 4  # similarity of 3/4 or more
_LOW_LEVEL = 2
_RAISES = 4
_SKETCH_SHIFT = 2  # a bit sketch has 4 bits for each block, 1.6 for each member at least: few sets below a similarity of 0.7 pass


def band(n: np.ndarray) -> np.ndarray:
    """The size band: 2**band blocks, at least 0.4 times as many as members.

    So many blocks are enough on average: n members fill 2**band * (1 - exp(-n / 2**band))
    of them, over a third of n, and a third of n is the most that can differ. Sets that
    fill fewer sign again (see ``signatures``).
    """
    return np.maximum(_LOW_LEVEL, np.ceil(np.log2(np.maximum(n, 1) * 0.4)).astype(np.int64))


def _batches(batches, k):
    claim("shingles")
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for a, b in blocks(texts):
            values, first = shingle_sets(texts[a:b], k)
            yield batch.slice(a, b - a), values, first


def first_seen(a: np.ndarray, b: np.ndarray, seen: set) -> np.ndarray:
    """Which identities (a, b) are not in ``seen``, where they then are."""
    return np.array([not (i in seen or seen.add(i)) for i in zip(a.tolist(), b.tolist(), strict=True)], bool)


def _classes(docs: DataFrame, k: int, local: int, keep: tuple[str, ...]) -> DataFrame:
    """Rows (doc_id, *keep, n, c1, c2) of documents, and rows (nulls, count, member, 0) of members that a batch's documents repeat."""
    kept = docs.select("doc_id", *keep).schema
    names = [*kept.names, "n", "c1", "c2", "member"]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        counter = Repeats(local)

        def repeats():
            members, n = counter.take()
            m = len(n)
            nulls = [pa.nulls(m, to_arrow_type(f.dataType)) for f in kept]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(n), pa.array(members), pa.array(np.zeros(m, np.int64)), pa.array(np.ones(m, bool))], names=names)

        seen: set = set()
        for part, values, first in _batches(batches, k):
            n, (a, b) = np.diff(first), set_ids(values, first)
            own = [part.column(c) for c in kept.names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(a), pa.array(b), pa.array(np.zeros(len(n), bool))], names=names)
            if counter.add(values[np.repeat(first_seen(a, b, seen), n)]):
                yield repeats()
                seen = set()
        yield repeats()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*kept.names, "text").mapInArrow(run, f"{kinds}, n long, c1 long, c2 long, member boolean")


def block_parities(values: np.ndarray, of: np.ndarray, level: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of every filled block; ``values`` sorted within each text, ``level`` by text."""
    if not len(values):
        return np.zeros(0, np.int64), of
    block = values >> (np.uint64(64) - level[of].astype(np.uint64))
    start = np.ones(len(values), bool)
    start[1:] = (block[1:] != block[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(start)
    parity = np.bitwise_xor.reduceat(mix64(values + np.uint64(0x632BE59BD9B4E019)), at)
    tag = (block[at] * np.uint64(64) + level[of[at]].astype(np.uint64)) * np.uint64(4) + np.uint64(salt)
    return mix64(parity ^ mix64(tag)).view(np.int64), of[at]


def signatures(values: np.ndarray, first: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (signature, text) rows of a block of texts; ``rare`` marks the members that are not frequent."""
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    own = band(n)
    below = band(-(-n * NUMERATOR // DENOMINATOR)) < own
    sigs, texts = [], []
    for level, chosen, most in ((own, n > 0, n // 3), (own - 1, below, 2 * n // 7)):
        pick = chosen[of]
        s, t = block_parities(values[pick & rare], of[pick & rare], level, 0)
        filled = np.bincount(t, minlength=len(n))
        sigs.append(s)
        texts.append(t)
        left = chosen & (filled <= most)
        for up in range(_RAISES + 1):
            if not left.any():
                break
            pick = left[of]
            s, t = block_parities(values[pick], of[pick], level + up, 2 if up else 1)
            sigs.append(s)
            texts.append(t)
            left &= np.bincount(t, minlength=len(n)) <= most
        pick = left[of]
        tag = level[of[pick]].astype(np.uint64) * np.uint64(4) + np.uint64(3)
        sigs.append(mix64(values[pick] ^ mix64(tag)).view(np.int64))
        texts.append(of[pick])
    return np.concatenate(sigs), np.concatenate(texts)


def frequent_members(rows: DataFrame, least: int) -> IdFilter:
    """The members (cls, n) whose counts reach ``least``."""
    return IdFilter(cut(rows.groupBy("cls").agg(F.sum("n").alias("c")).where(F.col("c") >= least).select("cls")), "cls", raw=True)


def own_members(first: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The rank of each set: the logarithm of its number of rare members.

    The first of a group, its hub, is then the one with fewest members of its
    own: the middle of a cluster of edited copies.
    """
    total = np.concatenate(([0], np.cumsum(rare)))
    return np.minimum(126, (4 * np.log2(1 + total[first[1:]] - total[first[:-1]])).astype(np.int64)).astype(np.int8)


def _signature_rows(docs: DataFrame, k: int, frequent: IdFilter, turn: int) -> DataFrame:
    """(sig, cls) of every class, once in each task; a signature's last bits are the class's rank."""

    def run(batches):
        import pyarrow as pa

        seen: set = set()  # of this task: a copy's rows are its class's rows
        for _, values, first in _batches(batches, k):
            a, b = set_ids(values, first)
            fresh = first_seen(a, b, seen)
            n = np.where(fresh, np.diff(first), 0)
            values = values[np.repeat(fresh, np.diff(first))]
            first = np.concatenate(([0], np.cumsum(n)))
            rare = ~frequent.holds(values)
            sigs, of = signatures(values, first, rare)
            cls, rank = node_of(a, b, turn), own_members(first, rare)
            for i in range(0, len(sigs), 200_000):
                part = of[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(ranked(sigs[i : i + 200_000], rank[part])), pa.array(cls[part])], names=["sig", "cls"])

    return docs.select("text").mapInArrow(run, "sig long, cls long")


def exact_test(left: list[bytes], right: list[bytes]) -> list[bool]:
    """Whether 4 * |A and B| >= 3 * |A or B|, of sorted sets."""
    ok = []
    for x, y in zip(left, right, strict=True):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.concatenate((a, b))
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        ok.append(DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common) and common > 0)
    return ok


def _payloads(docs: DataFrame, k: int, wanted: IdFilter, turn: int, sketches: bool) -> DataFrame:
    """(cls, payload): the sketch or the sorted set of the documents whose ids are in the filter."""

    def run(batches):
        import pyarrow as pa

        for _, values, first in _batches(batches, k):
            cls, n = node_of(*set_ids(values, first), turn), np.diff(first)
            if sketches:
                level = band(n).tolist()
                payload = [bit_sketch(values[a:b], h + _SKETCH_SHIFT) for a, b, h in zip(first[:-1], first[1:], level, strict=True)]
            else:
                payload = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(payload, pa.binary())], names=["cls", "payload"])

    return wanted.passing(docs, "doc_id", ("text",)).mapInArrow(run, "cls long, payload binary")


def components_of(docs: DataFrame, k: int = SHINGLE, frequent: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_shingles, comp, component_id): one row per document, linked at similarity 3/4 or more.

    ``comp`` names the component, and is null for an empty set; ``component_id`` is its
    least doc_id. Exact copies are one class from the start. ``frequent``: members that
    more documents than this repeat within single tasks stay out of the first blocks.
    """
    docs = small_batches(docs)
    rows = cut(_classes(docs, k, 4, keep))
    documents, turn = exact_nodes(rows.where(~F.col("member")).drop("member"))
    frequent_bits = frequent_members(rows.where("member").select(F.col("c1").alias("cls"), "n"), frequent)
    classes = cut(documents.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_doc")))
    groups = freed(cut(grouped(_signature_rows(docs, k, frequent_bits, turn))))

    def payloads(sketches):
        def make(nodes):
            wanted = IdFilter(cut(classes.join(nodes, "cls", "left_semi").select("first_doc")), "first_doc")
            return _payloads(docs, k, wanted, turn, sketches)

        return make

    # at similarity 3/4, |A ^ B| <= (|A| + |B|) / 7
    labels = resolve(groups, payloads(True), payloads(False), exact_test, (DENOMINATOR + NUMERATOR) // (DENOMINATOR - NUMERATOR))
    linked = classes.join(labels.select(F.col("node").alias("cls"), "comp"), "cls")
    least = linked.groupBy("comp").agg(F.min("first_doc").alias("component_id"))
    named = linked.join(least, "comp").select("cls", "comp", "component_id")
    of_class = classes.join(named, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), F.coalesce("component_id", "first_doc").alias("component_id"))
    columns = ["doc_id", *keep, F.col("n").alias("n_shingles"), "comp", "component_id"]
    full = documents.where("n > 0").join(of_class, "cls").select(*columns)
    empty = documents.where("n = 0").withColumn("comp", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return full.unionByName(empty.select(*columns))


def join(docs: DataFrame, k: int = SHINGLE, frequent: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``components_of``."""
    return components_of(docs, k, frequent).select("doc_id", "n_shingles", "component_id")
