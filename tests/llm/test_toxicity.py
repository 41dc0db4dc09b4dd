import itertools
import math

import numpy as np
import pyarrow as pa

from quirefold.llm import toxicity as T


def test_marginals_against_enumeration():
    rnd = np.random.default_rng(1)
    unary, jump = rnd.normal(size=11), rnd.normal(size=(2, 2))
    chain = np.array([0] * 6 + [1] * 1 + [2] * 4)
    p, pairs = T.marginals(unary, chain, jump)
    want_p, want_pairs = np.zeros(11), np.zeros((2, 2))
    for c in range(3):
        at = np.flatnonzero(chain == c)
        total = 0.0
        for y in itertools.product((0, 1), repeat=len(at)):
            w = math.exp(sum(u for u, k in zip(unary[at], y) if k) + sum(jump[a, b] for a, b in zip(y, y[1:])))
            total += w
        for y in itertools.product((0, 1), repeat=len(at)):
            w = math.exp(sum(u for u, k in zip(unary[at], y) if k) + sum(jump[a, b] for a, b in zip(y, y[1:]))) / total
            want_p[at] += np.array(y) * w
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs)


def test_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in T.op8_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for side in (True, False):
        pairs = [(got[i].predicted, t) for i, t in labels.items() if got[i].held_out == side]
        right = sum(a == b for a, b in pairs)
        assert right >= 0.9 * len(pairs), (side, right, len(pairs))


def test_edges(spark):
    rows = [(i, f"é plain words {i} here, you. nothing else and more {i}", 0) for i in range(40)] + [(100 + i, f"é plain words {i}, you badword! and more {i}", 1) for i in range(20)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(None, None, 1.0), (207, "", 1.0), (208, "Badword", 1.0), (208, "Badword", 1.0), (209, "word " * 50_000 + "badword", 1.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1)], "doc_id bigint, toxic int")
    out = T.score(docs, T.train(docs, labels)).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].score == 0 and all(r.score < 0.3 for i in range(40) for r in by[i]) and all(by[100 + i][0].score > 0.7 for i in range(20))
    assert sum(r.score > 0.7 for r in by[208]) == 2 and any(r.score > 0.7 for r in by[209]) and [(s.start, s.end) for s in by[105][0].spans] == [(21, 28)]
    none = T.train(docs, labels.limit(0))
    assert {r.score for r in T.score(docs, none).collect()} == {0.0}
    assert T.score(docs.limit(0), none).collect() == []


def test_tokens_of_a_slice():
    t = T.Tokens(pa.array(["skip", "Ab c. dé!", "", "x"]).slice(1))
    assert t.doc.tolist() == [0, 0, 0, 2] and t.chain.tolist() == [0, 0, 1, 2]
    assert [bytes(t.data[a:b]).decode() for a, b in zip(t.start, t.stop)] == ["Ab", "c", "dé", "x"]


def test_a_sentence_of_any_length_is_one_chain():
    rnd = np.random.default_rng(2)
    sizes = [1, 2, 3, 700, 64, 65, 5000]
    chain = np.repeat(np.arange(len(sizes)), sizes)
    unary, jump = rnd.normal(size=len(chain)), rnd.normal(size=(2, 2))
    p, pairs = T.marginals(unary, chain, jump)
    apart = [T._marginals(unary[chain == c], np.zeros(n, np.int64), jump) for c, n in enumerate(sizes)]
    assert np.allclose(p, np.concatenate([x for x, _ in apart])) and np.allclose(pairs, sum(y for _, y in apart))
    long = T.Tokens(pa.array(["word " * 300 + ". end"]))
    assert long.chain.tolist() == [0] * 300 + [1]


def test_scores_are_the_largest_marginals(spark):
    """Brute force of the scores: the path sums of each sentence, token by token."""
    rnd = np.random.default_rng(4)
    model = {"weights": rnd.normal(size=1 << T.TABLE_BITS).astype(np.float32), "jump": rnd.normal(size=(2, 2)), "bias": -1.0}
    texts = ["One two three. Four five", "a b c d e f", "", "é! x"]
    got = [r.score for r in T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()]
    for text, score in zip(texts, got, strict=True):
        t, best = T.Tokens(pa.array([text])), 0.0
        u = model["weights"][t.features].sum(axis=1, dtype=np.float64) + model["bias"]
        for c in set(t.chain.tolist()):
            at = np.flatnonzero(t.chain == c)
            paths = [(y, math.exp(sum(u[k] for k, on in zip(at, y) if on) + sum(model["jump"][a, b] for a, b in zip(y, y[1:])))) for y in itertools.product((0, 1), repeat=len(at))]
            best = max(best, *(sum(w for y, w in paths if y[i]) / sum(w for _, w in paths) for i in range(len(at))))
        assert abs(score - best) < 1e-6
