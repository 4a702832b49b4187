"""Substring dedup by paragraph MinHash banding.

Paragraphs are lines of at least ``min_words`` words; a paragraph's set holds
its distinct 5-word shingles. Bands are tuned for recall at the threshold.
Paragraphs that collide in a band are joined (see ``links``), verified by exact
Jaccard similarity (3/4 or more) and clustered by connected components; the first
paragraph of each cluster stays and the others are removals.

A passage inside a longer line makes no two lines alike, so every text is also
winnowed: of any ``window`` neighbouring ``gram``-word sequences the one of least
hash is noted. Two texts that share ``gram + window - 1`` words (50) share all of
that passage's sequences and so note the same one. Runs of noted sequences that
another document notes too are passages, and all but the first document's are
removals. No passage of 50 words is missed, some of ``gram`` words are found, and
a run may fall short of its passage by ``window - 1`` words at each end.

Equal paragraphs (word for word) are one class from the start. Results by case:
null and empty texts and shorter lines have no paragraphs; repeated rows (same
id and text) hold the same paragraphs twice, of which one stays, and their
passages are listed once; rows with the same id and unlike texts are two
documents, neither of which comes first, and so are rows without an id with
unlike texts, which come last; a passage that only one document holds, however
often, is none; an empty table gives an empty
result; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import exact_test, first_seen
from .links import IdFilter, bit_sketch, exact_nodes, grouped_by_ends, resolve
from .runtime import claim, cut, freed, small_batches
from .textnp import _tables, blocks, distinct, mix64, ngrams, node_of, owners, runs_hash, text_bytes, word_hashes, word_spans

SHINGLE = 5


def tune(threshold: float = 0.75, recall: float = 0.9995, rows: int = 3) -> tuple[int, int]:
    """(bands, rows): the fewest bands that find a pair at the threshold with the given probability."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands, rows




def lines_of(texts: list[bytes], min_words: int):
    """(hashes, text, number, begin, size): the words of a block of texts, and its lines of ``min_words`` words or more.

    ``number`` counts the text's lines from 0; a line is ``size`` words from ``begin``.
    """
    data, start, size, first = word_spans(texts)
    hashes, of = word_hashes(data, start, size), owners(first)
    if not len(start):
        none = np.zeros(0, np.int64)
        return hashes, none, none, none, none
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, start)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    before = np.searchsorted(breaks, np.cumsum(lengths + 1) - lengths - 1)
    begin = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (of[1:] != of[:-1]))))
    n = np.diff(np.append(begin, len(start)))
    keep = n >= min_words
    begin, n = begin[keep], n[keep]
    return hashes, of[begin], line[begin] - before[of[begin]], begin, n


def line_grams(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of lines (all of k words or more) in order, and where each line's begin."""
    of = np.repeat(np.arange(len(begin)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    first = np.concatenate(([0], np.cumsum(size)))
    grams, _ = ngrams(hashes[at], first, k)
    return grams, first - (k - 1) * np.arange(len(first))


def line_ids(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit identity for the words of each line."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.stack([begin, begin + size], axis=1).reshape(-1)
    keep = np.concatenate(([True], edges[1:] > edges[:-1]))  # a line may begin where the last one ends
    at = edges[keep]
    at = at[at < len(hashes)]
    place = np.searchsorted(at, begin)
    a, b = (runs_hash(hashes, at, salt)[place].view(np.int64) for salt in (0x3C6EF372FE94F82B, 0x510E527FADE682D1))
    return a, b


def _blocks(batches):
    claim("shingles")
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for a, b in blocks(texts):
            yield batch.slice(a, b - a), texts[a:b]


def band_keys(values: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64[sets, bands]: the keys of each set's bands; no set is empty. The MinHash values are of 32 bits."""
    keys = np.empty((len(first) - 1, bands), np.int64)
    half = (values >> np.uint64(32)).astype(np.uint32)
    for band in range(bands):
        key = np.full(len(first) - 1, band, np.uint64)
        for r in range(rows):
            salt = mix64(np.array([band * rows + r + 1], np.uint64))[0]
            turned = (half ^ np.uint32(salt & np.uint64(0xFFFFFFFF))) * np.uint32((salt >> np.uint64(32)) | np.uint64(1))
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(turned, first[:-1]))
        keys[:, band] = key.view(np.int64)
    return keys


def paragraph_rows(docs: DataFrame, min_words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, para, n_words, c1, c2, keys): every paragraph, its identity, and its bands' keys where its task first meets it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        seen: set = set()
        for part, texts in _blocks(batches):
            hashes, text, number, begin, size = lines_of(texts, min_words)
            if not len(begin):
                continue
            a, b = line_ids(hashes, begin, size)
            fresh = first_seen(a, b, seen)
            grams, first = line_grams(hashes, begin[fresh], size[fresh], SHINGLE)
            keys = band_keys(grams, first, bands, rows) if fresh.any() else np.zeros((0, bands), np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.where(fresh, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))
            columns = [part.column("doc_id").take(pa.array(text)), pa.array(number.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(a), pa.array(b), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "para", "n_words", "c1", "c2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, para int, n_words int, c1 long, c2 long, keys array<long>")


def _payloads(docs: DataFrame, min_words: int, in_docs: IdFilter, in_classes: IdFilter, turn: int) -> DataFrame:
    """(cls, payload, members): the sketches and the sets of the wanted classes."""

    def run(batches):
        import pyarrow as pa

        for _, texts in _blocks(batches):
            hashes, _, _, begin, size = lines_of(texts, min_words)
            cls = node_of(*line_ids(hashes, begin, size), turn)
            _, once = np.unique(cls, return_index=True)
            at = once[in_classes.holds(cls[once])]
            if not len(at):
                continue
            grams, first = line_grams(hashes, begin[at], size[at], SHINGLE)
            values, first = distinct(grams, owners(first), len(at))
            sets = [values[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            drawn = [bit_sketch(x, max(6, int(len(x) * 4).bit_length())) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(drawn, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cls", "payload", "members"])

    return in_docs.passing(docs, "doc_id", ("text",)).mapInArrow(run, "cls long, payload binary, members binary")


def winnow(hashes: np.ndarray, first: np.ndarray, gram: int, window: int):
    """(text, word, g1, g2) of the noted sequences of a block of texts, in order.

    Of equal neighbours, as in a text of one repeated word, one in ``window`` stays.
    """
    n = len(hashes)
    of = owners(first)
    whole = np.flatnonzero(of[: max(0, n - gram + 1)] == of[gram - 1 :]) if n >= gram else np.zeros(0, np.int64)
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    _, (power, inverse) = _tables(n + 1)
    ids = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(hashes ^ np.uint64(salt)) * power[:n], out=prefix[1:])
        ids.append(mix64((prefix[whole + gram] - prefix[whole]) * inverse[whole]))
    text = of[whole]
    place = np.uint64(max(1, int(len(whole)).bit_length()))
    least = ((ids[0] >> place) << place) | np.arange(len(whole), dtype=np.uint64)
    last_of = np.searchsorted(text, text, "right")
    span = 1
    while span < window:
        step = min(span, window - span)
        reach = np.minimum(np.arange(len(least)) + step, last_of - 1)
        least = np.minimum(least, least[reach])
        span += step
    at = np.arange(len(least))  # windows end with their text; a text of fewer sequences than a window is one window
    least = least[(at + window <= last_of) | np.concatenate(([True], text[1:] != text[:-1]))]
    noted = np.unique((least & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64))
    a, b, text, word = ids[0][noted].view(np.int64), ids[1][noted].view(np.int64), text[noted], whole[noted] - first[text[noted]]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (text[1:] != text[:-1])))
    run = np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = (word - word[run]) // window > np.where(new, -1, (np.concatenate(([0], word[:-1])) - word[run]) // window)
    return text[keep], word[keep], a[keep], b[keep]


def _noted_rows(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """(g1, g2, doc_id, row, at): every noted sequence; (doc_id, row) is a document, ``at`` its first word."""

    def run(batches):
        import pyarrow as pa

        for part, texts in _blocks(batches):
            data, start, size, first = word_spans(texts)
            text, word, a, b = winnow(word_hashes(data, start, size), first, gram, window)
            own = [part.column(c).take(pa.array(text)) for c in ("doc_id", "row")]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *own, pa.array(word.astype(np.int32))], names=["g1", "g2", "doc_id", "row", "at"])

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    return rows.mapInArrow(run, "g1 long, g2 long, doc_id long, row long, at int")


def _runs(found: DataFrame, gram: int) -> DataFrame:
    """(doc_id, at, n_words, first_doc, removed) of the runs of sequences (doc_id, row, at, first_doc); holds one batch and a run."""
    names, none = ("doc_id", "row", "at", "first_doc"), np.iinfo(np.int64).max

    def run(batches):
        import pyarrow as pa

        def out(doc, begin, end, origin):
            removed = pa.array(doc != origin)
            ids = [pa.array(v, mask=v == none) for v in (doc, origin)]
            return pa.RecordBatch.from_arrays([ids[0], pa.array(begin.astype(np.int32)), pa.array((end - begin).astype(np.int32)), ids[1], removed], names=["doc_id", "at", "n_words", "first_doc", "removed"])

        held = None  # doc_id, row, begin, end and origin of the run that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, row, at, origin = (batch.column(c).cast(pa.int64()).fill_null(none).to_numpy() for c in names)
            columns = [doc, row, at, at + gram, origin]
            if held is not None:
                columns = [np.concatenate(([h], c)) for h, c in zip(held, columns, strict=True)]
            doc, row, begin, end, origin = columns
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])))
            start = np.flatnonzero(new)
            ends, origins = np.maximum.reduceat(end, start), np.minimum.reduceat(origin, start)
            held = (doc[start[-1]], row[start[-1]], begin[start[-1]], ends[-1], origins[-1])
            if len(start) > 1:
                yield out(doc[start[:-1]], begin[start[:-1]], ends[:-1], origins[:-1])
        if held is not None:
            doc, _, begin, end, origin = (np.array([v]) for v in held)
            yield out(doc, begin, end, origin)

    rows = found.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "at")
    return rows.mapInArrow(run, "doc_id long, at int, n_words int, first_doc long, removed boolean")


def passages(docs: DataFrame, gram: int = 28, window: int = 23) -> DataFrame:
    """(doc_id, at, n_words, first_doc, removed): runs of sequences that other documents hold; ``at`` counts words from 0.

    The noted sequences' documents are counted by partial aggregates; then only
    sequences that two documents hold are shuffled, by a join that splits a very common one.
    """
    noted = cut(_noted_rows(small_batches(docs), gram, window))
    facts = noted.groupBy("g1", "g2").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.min("doc_id").alias("first_doc"))
    shared = cut(facts.where("lo != hi").select("g1", "g2", "first_doc"))
    found = IdFilter(shared, "g1", raw=True).rows_of(noted, "g1").join(shared, ["g1", "g2"])
    return _runs(found.select("doc_id", "row", "at", "first_doc"), gram)


def dedup(docs: DataFrame, min_words: int = 16, recall: float = 0.9995) -> DataFrame:
    """(doc_id, para, n_words, first_doc, first_para, cluster_size, removed): every paragraph (line) of a cluster of two or more.

    ``para`` counts the lines of the text from 0. A cluster is named by its
    first paragraph, by doc_id (null last) and then line; all but that one are removed.
    """
    bands, rows = tune(recall=recall)
    docs = small_batches(docs)
    found, turn = exact_nodes(cut(paragraph_rows(docs, min_words, bands, rows)))
    groups = freed(cut(grouped_by_ends(found.select("cls", "keys"))))
    found = found.drop("keys")
    classes = cut(found.groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("members")))

    def payloads(nodes):
        need = cut(classes.join(nodes, "cls", "left_semi").select("cls", F.col("first_doc").alias("id")))
        return _payloads(docs, min_words, IdFilter(need), IdFilter(need, "cls", raw=True), turn)

    labels = resolve(groups, payloads, None, exact_test, 7)
    # only paragraphs of classes with several members or several classes go on
    comp = labels.select(F.col("node").alias("cls"), "comp")
    alone = classes.where("members > 1").join(comp, "cls", "left_anti").select("cls", F.col("cls").alias("comp"), F.lit(False).alias("linked"))
    out = found.join(comp.withColumn("linked", F.lit(True)).unionByName(alone), "cls")
    clusters = out.groupBy("comp", "linked").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "para")).alias("head"), F.count("*").alias("cluster_size"))
    out = out.join(clusters, ["comp", "linked"])
    once = out.select("doc_id", "para", "n_words", F.col("head.doc_id").alias("first_doc"), F.col("head.para").alias("first_para"), "cluster_size")
    return once.withColumn("removed", ~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("para") == F.col("first_para"))))
