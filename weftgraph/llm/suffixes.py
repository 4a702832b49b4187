"""Substring dedup on bytes: what every ``length``-byte string that starts earlier covers goes.

The named form, one Burrows-Wheeler transform per shard merged by interleave
refinement, moves every suffix once per byte of the common prefix. This one
refines only where a repeat can be. A window of ``length`` bytes is anchored at
its least k-gram hash, so equal windows have equal anchors at equal offsets.
Anchors that occur once end there. The others' contexts, aligned at the anchor,
are refined column by column to the right and to the left: each column splits
the blocks of equal prefixes (or suffixes) stably, which merges the contexts of
all shards into one interleave without sorting suffixes again. Two windows are
the same repeated interval exactly if their left and right blocks are.

Equal texts are one class from the start, and equal contexts are compared once.

Results by case: null and empty texts and texts shorter than ``length`` lose
nothing; a copy of a text with a smaller id goes whole (if long enough); rows
that share an id share its position, so neither is earlier than the other at
the same start; a null id comes first; an empty table gives an empty result;
other input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import IdFilter, exact_nodes
from .runtime import claim, cut, small_batches
from .textnp import _tables, mix64, text_bytes

_GRAM = 32
_NO_ID = -(1 << 63)


def gram_size(length: int) -> int:
    """The k of the anchors' k-grams for windows of ``length`` bytes."""
    return min(_GRAM, max(1, length // 3))


def anchors(data: np.ndarray, end: np.ndarray, length: int):
    """(anchor hash, anchor, first and last window start) of every run of windows with one anchor.

    ``end[i]`` is where the text of position i ends. Positions are in ``data``.
    """
    n, gram = len(data), gram_size(length)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.view(np.uint64), empty, empty, empty
    value, (power, inverse) = _tables(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * power[:n], out=prefix[1:])
    grams = mix64((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    place = np.uint64(max(1, int(n).bit_length()))
    least = ((grams >> place) << place) | np.arange(len(grams), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    starts = np.flatnonzero(np.arange(n - length + 1) + length <= end[: n - length + 1])
    at = (least[starts] & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    if not len(starts):
        return empty.view(np.uint64), empty, empty, empty
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return grams[at[first]], at[first], starts[first], starts[last]


def _pieces(texts: list[bytes], length: int, limit: int):
    """Blocks of (text index, offset, bytes): whole texts, or overlapping pieces of a very long one."""
    block, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for a in range(0, max(1, len(t) - length + 1), limit):
            piece = t[a : a + limit + length - 1]
            if block and size + len(piece) > limit:
                yield block
                block, size = [], 0
            block.append((i, a, piece))
            size += len(piece)
    if block:
        yield block


def _scan(texts: list[bytes], length: int, limit: int):
    """Per block: (data, text index and start within the text for each run, runs)."""
    claim("suffixes")
    for block in _pieces(texts, length, limit):
        sizes = np.array([len(p) for *_, p in block])
        stop = np.cumsum(sizes)
        data = np.frombuffer(b"".join(p for *_, p in block), np.uint8)
        h, at, s0, s1 = anchors(data, np.repeat(stop, sizes), length)
        piece = np.searchsorted(stop, s0, "right")
        shift = np.array([a for _, a, _ in block])[piece] - (stop - sizes)[piece]
        yield data, np.array([i for i, *_ in block])[piece], shift, h, at, s0, s1


def _anchor_rows(rows: DataFrame, length: int, limit: int) -> DataFrame:
    """(h, cls, twice): each anchor of each text once; twice if it anchors more than one run there.

    A text of several pieces has a row for each piece, whose cls is mixed with the anchor's place in the text.
    """

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            fresh = [i for i, c in enumerate(batch.column("cls").to_pylist()) if not (c in seen or seen.add(c))]  # a copy has its text's anchors
            batch = batch.take(pa.array(fresh, pa.int64()))
            cls = batch.column("cls").to_numpy()
            texts = text_bytes(batch.column("text"))
            split = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1 > limit
            for _, text, shift, h, at, *_ in _scan(texts, length, limit):
                order = np.lexsort((h, text))
                h, text, place = h[order], text[order], (at + shift)[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                twice = np.diff([*first, len(h)]) > 1
                h, text, place = h[first], text[first], place[first]
                who = np.where(split[text], mix64(cls[text].view(np.uint64) ^ mix64(place.astype(np.uint64))).view(np.int64), cls[text])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(who), pa.array(twice)], names=["h", "cls", "twice"])

    return rows.select("cls", "text").mapInArrow(run, "h long, cls long, twice boolean")


def _context_rows(rows: DataFrame, length: int, repeated: IdFilter, limit: int) -> DataFrame:
    """(h, x, doc_id, cls, s0, n, off, ctx): every run at an anchor that may repeat; ctx only where the task first meets x.

    x identifies the bytes and the anchor's place in them; s0 is the first window's start, n the last one's distance from it.
    Rows with n = -1 are settled: the text is covered from s0 on for off bytes; their h only spreads them.
    """

    def run(batches):
        import pyarrow as pa

        met: set[int] = set()
        for batch in batches:
            cls, ids = batch.column("cls").to_numpy(), batch.column("doc_id").to_numpy()
            for data, text, shift, h, at, s0, s1 in _scan(text_bytes(batch.column("text")), length, limit):
                keep = np.flatnonzero(repeated.holds(h))
                if not len(keep):
                    continue
                text, shift, h, at, s0, s1 = (v[keep] for v in (text, shift, h, at, s0, s1))
                off, n = at - s0, s1 - s0
                whole = data.tobytes()
                names = b"".join(hashlib.blake2b(whole[a : b + length], digest_size=8).digest() for a, b in zip(s0.tolist(), s1.tolist(), strict=True))
                x = mix64(np.frombuffer(names, "<u8") + (off * (length + 1) + n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                doc, start = ids[text], s0 + shift
                order = np.lexsort((start, doc, x))  # of equal contexts of the block only the first goes on; the others are covered
                same = np.zeros(len(order), bool)
                same[1:] = x[order][1:] == x[order][:-1]
                lead = np.flatnonzero(~same)[np.cumsum(~same) - 1]
                later = same & ((doc[order] != doc[order][lead]) | (start[order] != start[order][lead]))
                done, on = order[later], order[~later]
                if len(done):
                    size = (n[done] + length).astype(np.int32)
                    columns = [mix64(doc[done].view(np.uint64) + start[done].view(np.uint64)).view(np.int64), np.zeros(len(done), np.int64), doc[done], cls[text[done]], start[done], np.full(len(done), -1, np.int32), size]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(done), pa.binary())], names=["h", "x", "doc_id", "cls", "s0", "n", "off", "ctx"])
                ctx = [None if k in met or met.add(k) else whole[a : b + length] for k, a, b in zip(x[on].tolist(), s0[on].tolist(), s1[on].tolist(), strict=True)]
                columns = [h[on].view(np.int64), x[on], doc[on], cls[text[on]], start[on], n[on].astype(np.int32), off[on].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ctx, pa.binary())], names=["h", "x", "doc_id", "cls", "s0", "n", "off", "ctx"])

    return rows.mapInArrow(run, "h long, x long, doc_id long, cls long, s0 long, n int, off int, ctx binary")


def refine(block: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Blocks of equal strings, one symbol longer: numbered in the order of (block, symbol)."""
    _, finer = np.unique(block * 257 + column, return_inverse=True)
    return finer


def repeated_windows(group: np.ndarray, order: np.ndarray, off: np.ndarray, n: np.ndarray, contexts: list[bytes], length: int):
    """(context, window) of every window that a context of the same group and of lower order holds too."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    anchor = np.cumsum(sizes) - sizes + off
    left, right = off, sizes - off

    def columns(place, inside):
        out = np.full(len(off), 256, np.int64)
        out[inside] = data[place[inside]]
        return out

    rows, windows = [], []
    gram = gram_size(length)
    span = length - gram
    rights = {gram: group.astype(np.int64)}
    for depth in range(gram, length):
        rights[depth + 1] = refine(rights[depth], columns(anchor + depth, right > depth)).astype(np.int32).astype(np.int64)
    lefts = group.astype(np.int64)
    for o in range(span + 1):  # windows that start o bytes before the anchor
        if o:
            lefts = refine(lefts, columns(anchor - o, left >= o))
        r = off - o
        at = np.flatnonzero((r >= 0) & (r <= n))
        if len(at) < 2:
            continue
        _, same = np.unique(lefts[at] * len(off) + rights[length - o][at], return_inverse=True)
        least = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, order[at])
        later = order[at] > least[same]
        rows.append(at[later])
        windows.append(r[at[later]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(windows)


def _repeats(runs: DataFrame, length: int, many: int = 15_000) -> DataFrame:
    """(doc_id, cls, s, e): the parts of texts that repeated windows cover.

    Input: ``_context_rows``, sorted by (h, x, doc_id, s0) within partitions. Of
    equal contexts the first is kept and the others are covered at once, so a
    worker holds an anchor's distinct contexts, about ``many`` at a time.
    """

    def solve(first):
        """Covered parts of the first occurrences of distinct contexts."""
        h, x, doc, cls, s0, n, off, ctx = first
        _, group, count = np.unique(h, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(count[group] > 1)
        if not len(keep):
            return None
        _, group = np.unique(group[keep], return_inverse=True)
        doc, cls, s0, n, off = (v[keep] for v in (doc, cls, s0, n, off))
        place = s0 + off
        by = np.lexsort((place, doc))
        step = np.ones(len(by), np.int64)
        step[1:] = (doc[by][1:] != doc[by][:-1]) | (place[by][1:] != place[by][:-1])
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(step)
        row, window = repeated_windows(group, order, off, n, [ctx[i] for i in keep.tolist()], length)
        if not len(row):
            return None
        by = np.lexsort((window, row))
        row, window = row[by], window[by]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.concatenate((begin[1:], [len(row)])) - 1
        at = row[begin]
        return doc[at], cls[at], s0[at] + window[begin], s0[at] + window[end] + length

    def out(parts):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(v) for v in parts], names=["doc_id", "cls", "s", "e"])

    names = ("h", "x", "doc_id", "cls", "s0", "n", "off")

    def run(batches):
        held: list[list] = [[] for _ in range(8)]  # first occurrences of distinct contexts, columns as in ``names`` and ctx
        size, tail = 0, None  # tail: (x, doc_id, s0) of the last first occurrence
        for batch in batches:
            if not batch.num_rows:
                continue
            h, x, doc, cls, s0, n, off = (batch.column(c).to_numpy().astype(np.int64) for c in names)
            ctx = batch.column("ctx").to_pylist()
            settled = n < 0
            if settled.any():
                yield out((doc[settled], cls[settled], s0[settled], s0[settled] + off[settled]))
                go = np.flatnonzero(~settled)
                if not len(go):
                    continue
                h, x, doc, cls, s0, n, off = (v[go] for v in (h, x, doc, cls, s0, n, off))
                ctx = [ctx[i] for i in go.tolist()]
            new = np.ones(len(x), bool)
            new[1:] = x[1:] != x[:-1]
            if tail is not None and x[0] == tail[0]:
                new[0] = False
            at = np.flatnonzero(new)
            lead = np.cumsum(new) - 1  # index into at, or -1: the context began in an earlier batch
            first_doc = np.where(lead >= 0, doc[at[lead]] if len(at) else 0, tail[1] if tail else 0)
            first_s0 = np.where(lead >= 0, s0[at[lead]] if len(at) else 0, tail[2] if tail else 0)
            later = ~new & ((doc != first_doc) | (s0 != first_s0))
            if later.any():
                yield out((doc[later], cls[later], s0[later], s0[later] + n[later] + length))
            same = ~new & ~later  # rows that share an id: not earlier than each other, so both are judged
            keep = np.flatnonzero(new | same)
            place = {}
            for i in range(len(x)):  # the bytes of a context may come with any of its rows
                if ctx[i] is not None:
                    place.setdefault(int(x[i]), ctx[i])
            if tail is not None and held[7] and held[7][-1] is None and int(tail[0]) in place:
                held[7] = [place[int(tail[0])] if c is None and k == tail[0] else c for c, k in zip(held[7], held[1], strict=True)]
            known = held[7][-1] if held[7] and tail is not None else None
            for v, column in zip(held[:7], (h, x, doc, cls, s0, n, off), strict=True):
                v.extend(column[keep].tolist())
            held[7].extend(place.get(int(x[i]), known if tail is not None and x[i] == tail[0] else None) for i in keep.tolist())
            size += len(keep)
            if len(at):
                tail = (x[at[-1]], doc[at[-1]], s0[at[-1]])
            if size >= many and held[0][0] != held[0][-1]:
                hs = np.array(held[0])
                cut_at = int(np.flatnonzero(hs != hs[-1])[-1]) + 1  # the last anchor may go on
                done = solve([np.array(v[:cut_at]) for v in held[:7]] + [held[7][:cut_at]])
                held = [v[cut_at:] for v in held]
                size = len(held[0])
                if done is not None:
                    yield out(done)
        if size:
            done = solve([np.array(v) for v in held[:7]] + [held[7]])
            if done is not None:
                yield out(done)

    return runs.mapInArrow(run, "doc_id long, cls long, s long, e long")


def _cover(rows: DataFrame) -> DataFrame:
    """(doc_id, cls, n_removed, n_spans, kept_sha256) from (doc_id, cls, text, spans)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            removed, runs, shas = [], [], []
            for text, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                gone, kept, at, n_runs = 0, hashlib.sha256(), 0, 0
                for s, e in sorted((x["s"], x["e"]) for x in spans):
                    if s > at or not n_runs:
                        kept.update(text[at:s])
                        n_runs += 1
                    gone += max(0, e - max(s, at))
                    at = max(at, e)
                kept.update(text[at:])
                removed.append(gone)
                runs.append(n_runs)
                shas.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("cls"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas)], names=["doc_id", "cls", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, cls long, n_removed long, n_spans long, kept_sha256 string")


def _names(text, turn: int):
    """The columns (c1, c2) of a text's identity, and ``cls`` made of them (see ``exact_nodes``)."""
    a, b = F.xxhash64(text), F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("long")
    return a, b, a.bitwiseXOR(F.shiftleft(b, turn).bitwiseOR(F.shiftrightunsigned(b, 64 - turn))) if turn else a


def dedup(docs: DataFrame, length: int = 100, piece: int = 2_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per document. Longer texts are read in pieces of ``piece`` bytes."""
    text = F.coalesce("text", F.lit(""))
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    sha, (a, b, _) = F.sha2("text", 256).alias("sha"), _names("text", 0)
    facts = cut(source.select("doc_id", a.alias("c1"), b.alias("c2"), F.octet_length("text").cast("long").alias("n_bytes"), sha))
    facts, turn = exact_nodes(facts)
    rows = source.withColumn("cls", _names("text", turn)[2])
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    classes = cut(facts.groupBy("cls").agg(F.min(key).alias("fd")))
    long = rows.where(F.octet_length("text") >= length)

    seen = _anchor_rows(long, length, piece).groupBy("h").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.bool_or("twice").alias("twice")).where("a != b OR twice")
    repeated = IdFilter(cut(seen.select("h")), "h", raw=True)
    runs = _context_rows(long.select(key.alias("doc_id"), "cls", "text"), length, repeated, piece)
    parts = _repeats(runs.repartition("h").sortWithinPartitions("h", "x", "doc_id", "s0"), length)
    spans = parts.groupBy("doc_id", "cls").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    # copies go whole, whatever their windows say
    spans = cut(spans.join(classes, "cls").where("doc_id = fd"))

    texts = IdFilter(spans, "fd").passing(rows.withColumn("_key", key), "_key", ("doc_id", "cls", "text"))
    spans = spans.select("cls", "fd", "spans")
    covered = _cover(texts.join(spans, (texts["cls"] == spans["cls"]) & (F.coalesce(texts["doc_id"], F.lit(_NO_ID)) == spans["fd"])).select("doc_id", texts["cls"], "text", "spans"))
    covered = covered.dropDuplicates(["doc_id", "cls"]).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_key"), F.col("cls").alias("_cls"), "n_removed", "n_spans", "kept_sha256")
    all_rows = facts.join(classes, "cls").withColumn("_copy", (key > F.col("fd")) & (F.col("n_bytes") >= length))
    out = all_rows.join(covered, (all_rows["cls"] == covered["_cls"]) & (F.coalesce(all_rows["doc_id"], F.lit(_NO_ID)) == covered["_key"]) & ~all_rows["_copy"], "left")
    copy = F.col("_copy")
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
