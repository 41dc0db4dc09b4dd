import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirefold.llm import alignment as A
from quirefold.llm import pieces as P

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "a ", "x▁ y", "a▁b", "a  b", "é b", "<|endoftext|> <s> <0x0A>", "a\x00 b\n\nc", "你好。 世界 é", "z" * 2000, "Unbelievable tokenization, antidisestablishmentarianism", "same words same words"]


def brute(texts):
    """By comparing all tokens of a text with each other."""
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    sign, names = A.byte_of_sign(), {i: t for t, i in a.get_vocab().items()}
    found, holds = [], Counter()
    for text in texts:
        left = a.encode(" " + (text or ""), add_special_tokens=False).ids
        right = b.encode(text or "")
        spans = []
        for ids, bytes_of in ((left, lambda i: bytes(sign[c] for c in names[i])), (right, lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            at, own, joined = 0, [], b""
            for i in ids:
                raw = bytes_of(i)
                own.append((at, at + len(raw), i))
                at, joined = at + len(raw), joined + raw
            spans.append((own, joined == (" " + (text or "")).encode()))
        if not text or not all(good for _, good in spans):
            found.append((0, 0, 0, [], ""))
            continue
        x, y = spans[0][0], spans[1][0]
        links = [(i, j) for s, e, i in x for t, f, j in y if s < f and t < e]
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups = [[",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in (x, y)] for lo, hi in zip([0, *ends], ends)]
        found.append((len(x), len(y), len(ends), links, ";".join("|".join(g) for g in groups)))
        holds.update(set(links))
    top = defaultdict(int)
    for (i, _), n in holds.items():
        top[i] = max(top[i], n)
    return [(x, y, g, len(links), sum(holds[p] == top[p[0]] for p in links), sum(holds[p] for p in links), text) for x, y, g, links, text in found]


def run(spark, rows, chunk_bytes, digest=False):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("chunk", F.lit("clash")).repartition(3)
    chunks = A.chunked(docs, JSON, MODEL, digest=digest, chunk_bytes=chunk_bytes)
    return A.aligned(chunks, P.piece_tokenizer(P.read_file(MODEL)).get_piece_size())


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (None, "same words"), (3, "same words"), (3, "same words"), (99, None)]
    want = sorted(((i, *found) for (i, _), found in zip(rows, brute([s for _, s in rows]), strict=True)), key=repr)
    for chunk_bytes in (1, 100, 1 << 20):
        assert sorted((tuple(r) for r in run(spark, rows, chunk_bytes).collect()), key=repr) == want
    assert run(spark, [], 100).count() == 0


def test_query_on_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r["text"] or "") < 4000]
    want = sorted((i, *f[:6], hashlib.sha256(f[6].encode()).hexdigest() if f[6] else "") for (i, _), f in zip(docs, brute([s for _, s in docs]), strict=True))
    assert sorted(tuple(r) for r in run(spark, docs, 1 << 16, True).collect()) == want
    got = A.op11_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=30))
def test_terminals(steps):
    successor = np.array([min(i + k, len(steps) - 1) for i, k in enumerate(steps)])
    want = []
    for i in range(len(steps)):
        while successor[i] != i:
            i = successor[i]
        want.append(i)
    assert A.terminals(successor).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=6), max_size=12), st.integers(1, 12), st.integers(0, 99))
def test_texts_with_in_blocks(texts, block, seed):
    rng = np.random.default_rng(seed)
    pieces = [rng.integers(0, 7, rng.integers(1, 5)).tolist() for _ in range(6)]
    bag = np.array(sorted({t * 6 + p for t, own in enumerate(texts) for p in own}), np.int64)
    want = Counter(x for own in texts for x in {x for p in own for x in pieces[p]})
    whole, A.BLOCK_PAIRS = A.BLOCK_PAIRS, block
    try:
        got = A._texts_with(bag, np.array([len(p) for p in pieces]), np.array([x for p in pieces for x in p]), 7)
    finally:
        A.BLOCK_PAIRS = whole
    assert got.tolist() == [want[x] for x in range(7)]
