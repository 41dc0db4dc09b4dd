import math

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quirefold.llm import language_model as M


def toks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + ["</end>"]


def brute(rows, train):
    pairs, words = Counter(), Counter()
    for t in train:
        seq = toks(t)
        words.update(seq)
        pairs.update(zip(["<start>", *seq], seq))
    follows, ctx, by = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, _), n in pairs.items():
        ctx[v] += n
        by[v][min(n, 3) - 1] += 1
    cc = lambda c: [sum(n == k for n in c.values()) for k in range(1, 5)]
    d, low = M.discounts_of(*map(float, cc(pairs))), M.discounts_of(*map(float, cc(follows)))
    disc = lambda n, d: d[min(n, 3) - 1] if n else 0
    kinds, n, v_all = sum(follows.values()), sum(words.values()), len(words)
    g0 = sum(disc(k, low) for k in follows.values()) / kinds if kinds else 1
    out = {}
    for i, t in rows:
        base = s = 0
        seq = toks(t)
        for v, w in zip(["<start>", *seq], seq):
            base += math.log10((words[w] + 0.1) / (n + 0.1 * (v_all + 1)))
            p1 = (max(follows[w] - disc(follows[w], low), 0) / kinds if kinds else 0) + g0 / (v_all + 1)
            p = max(pairs[v, w] - disc(pairs[v, w], d), 0) / ctx[v] + sum(x * y for x, y in zip(by[v], d)) / ctx[v] * p1 if ctx[v] else p1
            s += math.log10(p)
        out[i] = (len(seq), sum(w in words for w in seq), n, base, s)
    return out


def brute_of(order, rows, train):
    """Any order: counts of the highest, numbers of different predecessors below, order - 1 start marks."""
    seqs = [toks(t) for t in train]
    grams = lambda seq, k: [tuple((["<start>"] * (order - 1) + seq)[i + order - k : i + order]) for i in range(len(seq))]
    counts = {order: Counter(g for seq in seqs for g in grams(seq, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    words = Counter(w for seq in seqs for w in seq)
    n, v_all = sum(words.values()), len(words)
    ds, after = {}, {}
    for k, c in counts.items():
        ds[k] = M.discounts_of(*(float(sum(x == i for x in c.values())) for i in range(1, 5)))
        by = after[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, x in c.items():
            by[g[:-1]][0] += x
            by[g[:-1]][min(x, 3)] += 1
    out = {}
    for i, t in rows:
        seq = toks(t)
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v_all + 1))) for w in seq)
        p = [1 / (v_all + 1)] * len(seq)
        for k in range(1, order + 1):
            for j, g in enumerate(grams(seq, k)):
                total, *kinds = after[k].get(g[:-1], [0, 0, 0, 0])
                if total:
                    x = counts[k][g]
                    p[j] = (max(x - (ds[k][min(x, 3) - 1] if x else 0), 0) + sum(a * b for a, b in zip(kinds, ds[k])) * p[j]) / total
        out[i] = (len(seq), sum(w in words for w in seq), n, base, sum(map(math.log10, p)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_against_brute_force(spark, sf, order):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    learn = [(i, t) for i, t in docs if i % 3]
    want = brute_of(order, docs, [t for _, t in learn])
    got = M.score(df, M.train(df.where("doc_id % 3 <> 0"), order=order)).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)
    if order == 2:
        pairs = brute(docs, [t for _, t in learn])
        assert all(r.score == pytest.approx(pairs[r.doc_id][4], rel=1e-9) for r in got)


def test_probabilities_add_up(spark):
    """Over all known words and the unknown one, after contexts known and not."""
    texts = ["a b c a b d", "b c a", "d d a b", "c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = M.train(df)
    arrays = M.Arrays(model["folder"], model["buckets"])
    for context in ("", "a", "a b", "d d", "x", "a x", "x a"):
        words = ["a", "b", "c", "d", "unknown", ""]
        hashes = [M.tokens(pa.array([f"{context} {w}"]), model["order"])[0] for w in words]
        # the last word before the end; for the end itself the end
        p = [M.probabilities(arrays, model, h)[2][-2 if w else -1] for h, w in zip(hashes, words)]
        assert sum(p) == pytest.approx(1.0, rel=1e-9)


def test_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = brute_of(M.ORDER, docs, [t for i, t in docs if not held(i)])
    got = M.op6_language_model(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert r.held_out == held(r.doc_id) and (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "A a\ta", 1.0), (3, "A a\ta", 1.0), (None, "é b " * 50_000, 1.0)], "doc_id bigint, text string, score double")
    got = {r.doc_id: r for r in M.score(df, M.train(df)).collect()}
    want = brute_of(M.ORDER, [(r.doc_id, r.text) for r in df.collect()], [r.text for r in df.collect()])
    assert all(got[i].n_tokens == w[0] and got[i].score == pytest.approx(w[4], rel=1e-9) for i, w in want.items())
    none = M.train(df.limit(0))
    assert [r.score for r in M.score(df.where("doc_id = 1"), none).collect()] == [0.0]
    assert M.score(df.limit(0), none).collect() == []


@pytest.mark.parametrize("wide", [False, True])
def test_counts_beyond_32_bits_are_kept(tmp_path, wide):
    keys = np.unique(M.gram_keys([np.arange(1000, dtype=np.uint64)]))
    other = np.unique(M.gram_keys([np.arange(1000, 3000, dtype=np.uint64)]))
    for most in (0, 255, 256, 1 << 32, (1 << 53) - 1):
        for n in (np.array([1, most] * 500, np.uint64), np.arange(1000, dtype=np.uint64) % 300 + most):
            for b in range(4):
                of = M._place(keys, 4)[0] == b
                M.store(f"{tmp_path}/{most}-{n[0]}/{b}", keys[of], [n[of], n[of] // 2], 4, wide)
            got = M.Arrays(str(tmp_path), 4)
            assert got.find(f"{most}-{n[0]}", keys, 2).tolist() == [n.tolist(), (n // 2).tolist()]
            assert not got.find(f"{most}-{n[0]}", other, 2).any()
