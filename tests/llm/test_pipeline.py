"""The pipeline stage by stage, each against brute force on its own input, and as a whole."""

import hashlib
from collections import Counter

import corpus_pipeline
from test_corpus_operators import AWKWARD, SCHEMA, entropy_by_hand, jaccard_by_hand, spans_by_hand
from tokenizers import Tokenizer
from weftgraph.llm import bpe
from weftgraph.llm.runtime import DOCUMENT_COLUMNS

DATA = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select(*DOCUMENT_COLUMNS).collect()]


def clean(text):
    base = spans_by_hand(text)
    out, at = "", 0
    for s, _, e in sorted(base + entropy_by_hand(text, base)):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def check_stages(spark, docs, tmp_path):
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows(docs)
        out = stage(spark, docs, DATA)
        if name != "bpe":
            assert tuple(out.columns) == DOCUMENT_COLUMNS
        path = str(tmp_path / str(n))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "language_id":
            kept = [r for r in before if any(c.isalpha() for c in r[1] or "")]
            assert Counter((r[0], r[1], r[3], r[4]) for r in rows(docs)) == Counter((r[0], r[1], r[3], r[4]) for r in kept)
            assert all(r[2] for r in rows(docs))
        elif name == "ngram_jaccard_join":
            first = {d for d, _, c in jaccard_by_hand([(r[0], r[1]) for r in before]) if d is not None and d == c}
            nameless = [r[0] for r in before if r[0] is None]
            assert sorted((r[0] for r in rows(docs)), key=repr) == sorted([*first, *nameless], key=repr)
            assert set(rows(docs)) <= set(before)
        elif name == "secret_scans":
            assert sorted(rows(docs), key=repr) == sorted(((d, clean(t), la, s, len(clean(t))) for d, t, la, s, _ in before), key=repr)
        elif name == "mixing":
            times = Counter(rows(docs))
            assert set(times) <= set(before) and max(times.values(), default=0) <= 3
        else:
            reference = Tokenizer.from_file(bpe.vocabulary_path())
            want = Counter()
            for d, t, *_ in before:
                ids = reference.encode(t, add_special_tokens=False).ids
                want[(d, len(ids), b"".join(i.to_bytes(4, "little") for i in ids), hashlib.sha256(t.encode()).hexdigest())] += 1
            assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in docs.collect()) == want
    return docs


def test_stages_on_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    last = check_stages(spark, docs, tmp_path)
    whole = corpus_pipeline.run(spark, DATA)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in whole.collect()) == Counter((r["doc_id"], r["n_tokens"]) for r in last.collect())


def test_stages_on_awkward_rows(spark, tmp_path):
    check_stages(spark, spark.createDataFrame(AWKWARD, SCHEMA), tmp_path)


def test_stages_on_no_rows(spark, tmp_path):
    assert check_stages(spark, spark.createDataFrame([], SCHEMA), tmp_path).count() == 0
