import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from quirefold.llm import byte_bpe as B

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def expected(text):
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_matches_tokenizer_and_round_trips(spark, sf):
    got = {r[0]: tuple(r)[1:] for r in B.op1_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    assert all(got[r.doc_id] == expected(r.text) for r in docs)


def test_edges(spark):
    texts = [None, "", " ", "  a", "a  ", "\n\n x y　z ", "I'll don't 's 'S", "日本語 テスト🙂🙂 é", "x" * 30000, "a\x1cb \x85 c", "same", "same"]
    rows = [(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r[0] is None, r[0] or 0), tuple(r)[1:]) for r in B.digests(B.decode(B.encode(df, RANKS), RANKS)).collect())
    want = sorted(((i is None, i or 0), expected(t)) for i, t, _ in rows)
    assert got == want
    assert B.digests(B.decode(B.encode(df.limit(0), RANKS), RANKS)).collect() == []


def test_chunks_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(B, "CHUNK_WORDS", 10)
    lists = [["w"] * n for n in (3, 0, 4, 30, 0, 2, 8, 1, 0, 10, 11, 0, 0, 5)]
    whole = pa.record_batch({"id": list(range(len(lists))), "words": pa.array(lists, pa.list_(pa.string()))})
    cut = lambda parts: [ids.to_pylist() for ids, _ in B._cut(iter(parts))]
    want = cut([whole])
    assert sum(want, []) == list(range(len(lists))) and max(map(len, want)) > 1
    for n in (1, 2, 3, 5):
        assert cut([whole.slice(i, n) for i in range(0, len(lists), n)]) == want
