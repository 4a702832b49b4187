"""From shared signatures to connected components, without all pairs of a group.

Nodes are classes (64-bit integers) that stand for groups of equal items.
Signature rows (sig, cls) are grouped by a sort; within a group every class is
first compared with one hub, and tried with the nearest of its groups' hubs.
Classes that are not in a hub's component after that, satellites, are compared with that component
and with each other, by sketches: at once where all fit one block, else with a part of it first,
and those that stay satellites with the whole of it, in blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, freed
from .textnp import mix64

#: Bits of an id filter for each id, and its least and greatest size (32 MB) as a power of two.
FILTER_PER_ID, FILTER_LEAST, FILTER_MOST = 16, 16, 28


def exact_nodes(rows: DataFrame, a: str = "c1", b: str = "c2", most_turns: int = 64) -> tuple[DataFrame, int]:
    """``rows`` with ``cls``, one 64-bit integer for each 128-bit identity (a, b), and the turn that makes it.

    ``cls`` is ``a`` as long as no two identities share it (see ``textnp.node_of``).
    """
    for turn in range(most_turns):
        node = F.col(a)
        if turn:
            node = node.bitwiseXOR(F.shiftleft(F.col(b), turn).bitwiseOR(F.shiftrightunsigned(F.col(b), 64 - turn)))
        out = rows.withColumn("cls", node)
        facts = out.groupBy("cls").agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in (a, b) for f in (F.min, F.max)])
        if facts.where(f"_min_{a} != _max_{a} OR _min_{b} != _max_{b}").isEmpty():
            return out, turn
    raise RuntimeError("identities did not come apart")


RANK_BITS = 7


def ranked(sig: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Signatures whose last bits are the rank of their class: rows of one signature then sort by rank."""
    return ((sig.view(np.uint64) >> np.uint64(RANK_BITS) << np.uint64(RANK_BITS)) | rank.astype(np.uint64)).view(np.int64)


def grouped(sigs: DataFrame) -> DataFrame:
    """(sig, hub, cls): the rows of signatures (see ``ranked``) that two or more classes share; hub is the first by rank that the pass meets.

    A sort by one column, which spills to disk; the pass after it holds one batch
    and the last group's hub.
    """

    def run(batches):
        import pyarrow as pa

        last = None  # (sig, hub, whether the group already has two classes) of the last row's group
        for batch in batches:
            sig, cls = batch.column("sig").to_numpy() >> RANK_BITS, batch.column("cls").to_numpy()
            if not len(sig):
                continue
            if last is not None:
                sig, cls = np.concatenate(([last[0]], sig)), np.concatenate(([last[1]], cls))
            start = np.concatenate(([True], sig[1:] != sig[:-1]))
            group = np.cumsum(start) - 1
            size = np.diff(np.append(np.flatnonzero(start), len(sig)))
            hub = np.repeat(cls[start], size)  # the first row of a group is its hub
            some = np.flatnonzero((size[group] > 1) & (start | (cls != hub)))
            some = some[np.lexsort((cls[some], ~start[some], group[some]))]
            g, c = group[some], cls[some]
            fresh = start[some] | np.concatenate(([True], (c[1:] != c[:-1]) | (g[1:] != g[:-1])))[: len(some)]
            classes = np.bincount(g[fresh], minlength=len(size))
            done = last is not None and last[2]
            out = fresh & ((classes > 1) | (done & (np.arange(len(size)) == 0)))[g]
            if done and len(some) and some[0] == 0:
                out[0] = False  # this hub's row has gone out
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[some][out]), pa.array(hub[some][out]), pa.array(c[out])], names=["sig", "hub", "cls"])
            end = len(size) - 1
            last = (sig[-1], hub[-1], bool(classes[end] > 1) or (done and end == 0))

    rows = sigs.repartition(F.shiftright("sig", RANK_BITS)).sortWithinPartitions("sig")
    return rows.mapInArrow(run, "sig long, hub long, cls long")


def grouped_by_ends(rows: DataFrame) -> DataFrame:
    """(sig, hub, cls) as ``grouped``, for rows (cls, keys array<long>) that can be read twice; hub is the least class.

    The groups' ends are found by partial aggregates, and only rows of shared
    signatures are shuffled, by a join that splits a very large group.
    """
    ends = rows.select(F.explode("keys").alias("sig"), "cls").groupBy("sig").agg(F.min("cls").alias("hub"), F.max("cls").alias("_hi"))
    ends = cut(ends.where("hub != _hi").select("sig", "hub"))
    there = IdFilter(ends, "sig", raw=True)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column("keys")
            sig = keys.flatten().to_numpy()
            cls = np.repeat(batch.column("cls").to_numpy(), keys.value_lengths().fill_null(0).to_numpy())
            at = np.flatnonzero(there.holds(sig))
            yield pa.RecordBatch.from_arrays([pa.array(sig[at]), pa.array(cls[at])], names=["sig", "cls"])

    return rows.select("cls", "keys").mapInArrow(run, "sig long, cls long").join(ends, "sig").select("sig", "hub", "cls")


def bit_sketch(values: np.ndarray, bits: int) -> bytes:
    """A set's size and a parity sketch of 2**bits bits: each bit is the parity of the number of members that hash to it.

    The Hamming distance of two sketches is at most the size of the sets'
    symmetric difference, and merging neighbouring bits by XOR halves a sketch.
    """
    parity = np.bincount((mix64(values) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return len(values).to_bytes(8, "little") + np.packbits(parity.astype(np.uint8)).tobytes()


def _folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketch bytes folded to ``size`` bytes."""
    if sketches.shape[1] > size:
        bits = np.unpackbits(sketches, axis=1)
        while bits.shape[1] > 8 * size:
            bits = bits[:, 0::2] ^ bits[:, 1::2]
        sketches = np.packbits(bits, axis=1)
    return np.ascontiguousarray(sketches)


def least_apart(left: list[bytes], right: list[bytes], parts: int) -> np.ndarray:
    """int64[left, right]: the least difference |A ^ B| that sizes and sketches allow, or -1 if ``parts`` times it is over |A| + |B|."""
    out = np.full((len(left), len(right)), -1)
    sides = []
    for rows in (left, right):
        by: dict[int, list[int]] = {}
        for i, x in enumerate(rows):
            by.setdefault(len(x) - 8, []).append(i)
        sides.append({size: (np.array(at), np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), size + 8)) for size, at in by.items()})
    for size_l, (at_l, x) in sides[0].items():
        for size_r, (at_r, y) in sides[1].items():
            m = min(size_l, size_r)
            n_l, n_r = (np.ascontiguousarray(v[:, :8]).view("<i8").ravel() for v in (x, y))
            p, q = _folded(x[:, 8:], m), _folded(y[:, 8:], m)
            if m % 8 == 0:
                p, q = p.view(np.uint64), q.view(np.uint64)
            step = max(1, 4_000_000 // max(1, q.size))
            for i in range(0, len(at_l), step):
                apart = np.bitwise_count(p[i : i + step, None, :] ^ q[None, :, :]).sum(2, dtype=np.int64)
                size = n_l[i : i + step, None] + n_r[None, :]
                least = np.maximum(apart, np.abs(n_l[i : i + step, None] - n_r[None, :]))
                out[at_l[i : i + step, None], at_r[None, :]] = np.where(parts * least <= size, least, -1)
    return out


def pairs_apart(left: list[bytes], right: list[bytes], parts: int) -> np.ndarray:
    """int64: the least difference of each pair, as ``least_apart``."""
    out = np.full(len(left), -1)
    kind = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64).reshape(len(left), 2)
    for size_l, size_r in np.unique(kind, axis=0).tolist():
        at = np.flatnonzero((kind == (size_l, size_r)).all(1))
        x, y = (np.frombuffer(b"".join(side[i] for i in at.tolist()), np.uint8).reshape(len(at), size) for side, size in ((left, size_l), (right, size_r)))
        m = min(size_l, size_r) - 8
        n_l, n_r = (np.ascontiguousarray(v[:, :8]).view("<i8").ravel() for v in (x, y))
        apart = np.bitwise_count(_folded(x[:, 8:], m) ^ _folded(y[:, 8:], m)).sum(1, dtype=np.int64)
        least = np.maximum(apart, np.abs(n_l - n_r))
        out[at] = np.where(parts * least <= n_l + n_r, least, -1)
    return out


NEAR, OPEN, REST = 1, 0, 2  # kinds of rows of ``satellite_pairs``


def satellite_pairs(groups: DataFrame, labels: DataFrame, sketches: DataFrame, parts: int, nearest: bool, block: int = 512, most_blocks: int = 32, largest: int = 8192, most_open: int = 8) -> DataFrame:
    """(a, b, kind): classes that share a group but no component yet, as far as their sketches leave a link open; kind is ``NEAR`` or ``OPEN``.

    In every group a class is in the hub's component or a satellite of it. A
    component and its satellites are dealt into blocks of ``block`` sketches, or
    larger ones where that makes over ``most_blocks``, but not over ``largest``;
    a worker holds one pair of blocks. With ``nearest`` each satellite meets one
    block and gives its nearest class there, so this takes time in proportion to
    the classes. What fits one block is compared as a whole then: its other open
    pairs are given too, and need no second comparison. A component that takes
    several blocks, or has over ``most_open`` open pairs for each satellite, gives
    a row (c, c, ``REST``) in place of them. Without ``nearest`` each meets every block, and
    every open pair is given. A lone hub with one satellite is left to ``hub_pairs``.
    ``sketches`` is (cls, payload).
    """
    hubs = labels.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    labelled = groups.where("cls != hub").join(labels.select(F.col("node").alias("cls"), "comp"), "cls", "left").join(hubs, "hub", "left")
    labelled = labelled.select(F.coalesce("hub_comp", "hub").alias("c"), "cls", F.coalesce("comp", "cls").alias("comp"))
    sats = cut(labelled.where("comp != c").distinct())
    known = labels.select(F.col("comp").alias("c"), F.col("node").alias("cls")).join(sats.select("c").distinct(), "c", "left_semi")
    alone = sats.select("c").distinct().join(known.select("c").distinct(), "c", "left_anti").select("c", F.col("c").alias("cls"))
    inner = known.unionByName(alone).withColumn("comp", F.col("c"))
    every = inner.withColumn("sat", F.lit(False)).unionByName(sats.withColumn("sat", F.lit(True)))
    counts = every.groupBy("c").agg(F.count("*").alias("n"), F.count_if("sat").alias("n_sat")).where("n > 2")  # one satellite of one hub is a pair of ``hub_pairs``
    full = every.join(counts, "c").join(sketches, "cls")
    size = F.least(F.greatest(F.lit(block), F.ceil(F.col("n") / most_blocks)), F.lit(largest))
    nl, nr = F.ceil(F.col("n_sat") / size).cast("int"), F.ceil(F.col("n") / size).cast("int")
    own = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    other = lambda n: F.pmod(F.xxhash64("cls", F.lit(1)), n).cast("int")
    if nearest:
        # as many of the component's blocks take part as its satellites fill
        left = full.where("sat").withColumn("lb", F.lit(0)).withColumn("rb", other(F.least(nl, nr))).withColumn("side", F.lit(0))
        right = full.withColumn("rb", own(nr)).where(F.col("rb") < F.least(nl, nr)).withColumn("lb", F.lit(0)).withColumn("side", F.lit(1))
    else:
        left = full.where("sat").withColumn("lb", own(nl)).withColumn("rb", F.explode(F.sequence(F.lit(0), nr - 1))).withColumn("side", F.lit(0))
        right = full.withColumn("rb", own(nr)).withColumn("lb", F.explode(F.sequence(F.lit(0), nl - 1))).withColumn("side", F.lit(1))
    cols = ["c", "lb", "rb", "side", "cls", "comp", "sat", (nr == 1).alias("whole"), "payload"]

    def run(batches):
        import pyarrow as pa

        def rows(a, b, kind):
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "kind"])

        def solve(c, held):
            side, cls, comp, sat, whole = (np.concatenate([h[i] for h in held]) for i in range(5))
            payload = [x for h in held for x in h[5]]
            rest = nearest and not whole[0]
            l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(l) and len(r):
                a, b = cls[l], cls[r]
                apart = least_apart([payload[i] for i in l.tolist()], [payload[i] for i in r.tolist()], parts)
                apart[comp[l][:, None] == comp[r][None, :]] = -1
                if nearest:
                    far = np.where(apart < 0, np.iinfo(np.int64).max, apart)
                    j = far.argmin(1)
                    i = np.flatnonzero(far[np.arange(len(j)), j] < np.iinfo(np.int64).max)
                    yield rows(a[i], b[j[i]], NEAR)
                    apart[i, j[i]] = -1
                if not rest:
                    apart[sat[r][None, :] & (a[:, None] >= b[None, :])] = -1
                    i, j = np.nonzero(apart >= 0)
                    rest = nearest and len(i) > most_open * len(l)
                    if not rest:
                        yield rows(a[i], b[j], OPEN)
            if rest:
                yield rows(np.array([c]), np.array([c]), REST)

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("c", "lb", "rb")], axis=1)
            begin = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "cls", "comp", "sat", "whole")]
            for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True):
                k = tuple(keys[s].tolist())
                if k != key and held:
                    yield from solve(key[0], held)
                    held = []
                key = k
                held.append([*(c[s:e] for c in columns), batch.column("payload").slice(s, e - s).to_pylist()])
        if held:
            yield from solve(key[0], held)

    dealt = left.select(*cols).unionByName(right.select(*cols)).repartition("c", "lb", "rb").sortWithinPartitions("c", "lb", "rb")
    return dealt.mapInArrow(run, "a long, b long, kind int").distinct()


class IdFilter:
    """A bit set over ids or, with ``raw``, over integers that are hashes already; with false positives only.

    Its size follows the number of ids and ends at 32 MB, where more ids only let more rows pass.
    """

    def __init__(self, ids: DataFrame, column: str = "id", raw: bool = False, most: int = FILTER_MOST):
        self.raw, self.count = raw, ids.count()
        self.bits = min(most, max(FILTER_LEAST, (FILTER_PER_ID * self.count).bit_length()))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
        words = ids.select(self.bit(column).alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
        self.table = np.zeros(1 << (self.bits - 6), np.uint64)  # 2**(FILTER_MOST - 6) rows at most
        self.table[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)

    def bit(self, column):
        """The bit of an id, as a column."""
        return F.col(column).bitwiseAND(F.lit((1 << self.bits) - 1)) if self.raw else F.pmod(F.xxhash64(column), F.lit(1 << self.bits))

    def _set(self, bits: np.ndarray) -> np.ndarray:
        return (self.table[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Which of the raw integers may be among the ids."""
        return self._set(values.view(np.uint64) & np.uint64((1 << self.bits) - 1))

    def rows_of(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose raw integer ``column`` may be among the ids."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield batch.take(pa.array(np.flatnonzero(self.holds(batch.column(column).to_numpy()))))

        return df.mapInArrow(run, df.schema)

    def passing(self, df: DataFrame, column: str, keep: tuple[str, ...], few: int = 65_536) -> DataFrame:
        """``keep`` columns of the rows of ``df`` whose ``column`` may be one of the ids.

        Up to ``few`` ids' rows are picked by a broadcast of the bit set's words, before Python sees any.
        """
        if self.count <= few:
            return self.marked(df, column).where("maybe").select(*keep)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield batch.take(pa.array(np.flatnonzero(self._set(batch.column("_bit").to_numpy().astype(np.uint64))))).select(list(keep))

        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
        return df.select(*keep, self.bit(column).alias("_bit")).mapInArrow(run, kinds)

    def marked(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with ``maybe``: false where ``column`` is surely none of the ids. Broadcasts the bit set's words that are not 0."""
        import pyarrow as pa

        w = np.flatnonzero(self.table)
        words = df.sparkSession.createDataFrame(pa.table({"_w": w.astype(np.int32), "_v": self.table[w].view(np.int64)}))
        joined = df.withColumn("_bit", self.bit(column)).join(F.broadcast(words), F.shiftright("_bit", 6) == F.col("_w"), "left")
        hit = F.call_function("shiftrightunsigned", F.col("_v"), F.pmod("_bit", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return joined.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("_bit", "_w", "_v")


def with_payloads(pairs: DataFrame, payloads: DataFrame) -> DataFrame:
    """(a, b, pa, pb) of pairs (a, b) and (cls, payload).

    A class with many partners makes a large join partition, which adaptive execution splits.
    """
    left = payloads.select(F.col("cls").alias("a"), F.col("payload").alias("pa"))
    right = payloads.select(F.col("cls").alias("b"), F.col("payload").alias("pb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "pa", "pb")


def hub_pairs(groups: DataFrame, sketches: DataFrame, parts: int) -> DataFrame:
    """(a, b, d): every class b with each hub a of its groups and the least difference d, where their sketches leave a link open."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            apart = pairs_apart(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), parts)
            at = pa.array(np.flatnonzero(apart >= 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("a", "b")), pa.array(apart).take(at)], names=["a", "b", "d"])

    pairs = groups.where("cls != hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    return with_payloads(pairs, sketches).mapInArrow(run, "a long, b long, d long")


def nearest_hubs(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: each class with the nearest of its hubs in ``pairs`` (see ``hub_pairs``)."""
    return ordered(pairs.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")))


def ordered(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, once each."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart_still(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes are in no common component of the labels (node, comp)."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("_a IS NULL OR _b IS NULL OR _a != _b").select("a", "b")


def verify(pairs: DataFrame, payloads: DataFrame, test) -> DataFrame:
    """The pairs (a, b) whose payloads (cls, payload binary) pass ``test(list of bytes, list of bytes) -> list of bool``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keep = pa.array(np.flatnonzero(test(part.column("pa").to_pylist(), part.column("pb").to_pylist())))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([part.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])

    return with_payloads(pairs, payloads).mapInArrow(run, "a long, b long")


def resolve(groups: DataFrame, sketches, sets, test, parts: int) -> DataFrame:
    """(node, comp): the components of the classes that are linked, ``parts`` * |A ^ B| <= |A| + |B|, and share a group.

    ``sketches`` and ``sets`` make (cls, payload) for the classes (cls); without
    ``sets`` the sketches come with the sets as a column ``members``. ``test``
    decides a pair of sets exactly. Four rounds of pairs: each class with the
    nearest of its groups' hubs; satellites with the nearest class of a part of
    a hub's component; what is still open with other hubs and in components of
    one block; and what is open in the components that were not compared as a whole.
    """

    def nodes(pairs):
        return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()

    def linked(pairs):
        found = drawn.select("cls", F.col("members").alias("payload")) if sets is None else sets(nodes(pairs))
        return freed(cut(verify(pairs, found, test).distinct()))

    drawn = cut(sketches(groups.select("cls").distinct()).dropDuplicates(["cls"]))
    sketched = drawn.select("cls", "payload")
    with_hubs = cut(hub_pairs(groups, sketched, parts))
    tested = cut(nearest_hubs(with_hubs))
    edges = linked(tested)
    labels = components(edges)
    seen, hub_labels = freed(cut(satellite_pairs(groups, labels, sketched, parts, True))), labels

    def joined(pairs):
        nonlocal edges, labels, tested
        pairs = freed(cut(pairs.join(tested, ["a", "b"], "left_anti")))
        if pairs.isEmpty():
            return
        more = linked(pairs)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            labels = components(edges)
        tested = tested.unionByName(pairs)

    joined(seen.where(F.col("kind") == NEAR).select("a", "b"))
    joined(apart_still(ordered(with_hubs).unionByName(seen.where(F.col("kind") == OPEN).select("a", "b")).distinct(), labels))
    rest = seen.where(F.col("kind") == REST).select(F.col("a").alias("comp"))
    if not rest.isEmpty():
        # the groups whose hub is in such a component, or is one alone
        hubs = hub_labels.join(rest, "comp", "left_semi").select(F.col("node").alias("hub")).unionByName(rest.select(F.col("comp").alias("hub")))
        again = IdFilter(cut(hubs), "hub", raw=True).rows_of(groups, "hub")
        joined(satellite_pairs(again, labels, sketched, parts, False).select("a", "b"))
    return labels


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the least node of its component.

    Alternating large-star and small-star contraction; each round is checkpointed, and its shuffle files go.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = freed(cut(small.distinct()))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
