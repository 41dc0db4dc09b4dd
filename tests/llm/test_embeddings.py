import numpy as np

from quirefold.llm import embeddings as E


def brute(rows):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, np.float32).astype(float))
    links = {i: set() for i, *_ in rows if i is not None}
    ids = sorted(good)
    for a in ids:
        for b in ids:
            (la, x), (lb, y) = good[a], good[b]
            if a < b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= E.COSINE:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def result(df):
    return {r.vec_id: tuple(r)[1:] for r in df.collect()}


def test_against_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = result(E.op5_embeddings(spark, sf))
    assert got == brute(rows)


def test_blocks_and_edges(spark):
    rnd = np.random.default_rng(2)
    rows, n = [], 0
    for _ in range(60):
        base = rnd.normal(size=24)
        for _ in range(int(rnd.integers(1, 25))):
            rows.append((n, [float(x) for x in base + rnd.normal(size=24) * rnd.choice([0.02, 0.1, 0.15])], int(n % 3 == 0)))
            n += 1
    e = rows[0][1]
    rows += [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [float("nan")] + e[1:], 0), (5003, [None] + e[1:], 0), (5004, [float("inf")] + e[1:], 0), (5005, e, None), (5006, e[:5], 0), (5007, e[:5], 0), (5008, [], 0), (None, e, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, n int")
    before = E.BLOCK
    try:
        E.BLOCK = 100
        out = E.classes(df).collect()
    finally:
        E.BLOCK = before
    assert len(out) == len(rows)
    got = {r.vec_id: tuple(r)[1:] for r in out}
    assert got.pop(None) == (0, None, True) and got == brute(rows)
    twice = E.classes(df.where("vec_id < 50").unionByName(df.where("vec_id < 50"))).collect()
    assert len(twice) == 100 and {r.vec_id: tuple(r)[1:] for r in twice} == brute([r for r in rows if r[0] is not None and r[0] < 50])
    assert E.classes(df.limit(0)).collect() == []


def test_count_is_calibrated():
    k = E.needed(E.WITHIN)
    rnd = np.random.default_rng(0)
    assert 1 < k < E.DIRECTIONS * E.WITHIN and (rnd.binomial(E.DIRECTIONS, E.WITHIN, 2_000_000) < k).mean() < 1e-5
