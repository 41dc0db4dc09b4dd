import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quirefold.llm import near_dup as N


def shingles(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    df = Counter(k for s in sets for k in s)
    n = len(rows)
    idf = {k: 1 + N.IDF_SHARE * math.log(n / v) / math.log(max(n, 2)) for k, v in df.items()}
    where = {}
    for i, s in enumerate(sets):
        for k in s:
            where.setdefault(k, []).append(i)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    weight = [sum(c * idf[k] for k, c in s.items()) for s in sets]
    for i, s in enumerate(sets):
        for j in {j for k in s for j in where[k] if j < i}:
            common = sum(min(c, sets[j][k]) * idf[k] for k, c in s.items() if k in sets[j])
            if common >= 0.8 * (weight[i] + weight[j] - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in N.op4_minhash(spark, sf).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) < len(got)


def test_copies_of_one_text(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(6):
        base = [rnd.choice(vocab) for _ in range(300)]
        for _ in range(25):
            t = list(base)
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(300)] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, " ".join(rnd.choice(vocab) for _ in range(200))) for i in range(50)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One\ttwo"), (905, "x" * 200_000)]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id bigint, text string, node string")
    out = N.classes(df).collect()
    got = {r.doc_id: r.class_id for r in out}
    assert len(out) == len(rows) and got == brute([(d, t) for d, t in rows])
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)
    kept = N.distinct_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in N.classes(df).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (1, 1, True), (2, 1, False), (2, 1, False)], key=str)
    assert N.classes(df.limit(0)).collect() == []


def test_one_row_of_each_class_stays(spark):
    t, u, v = (" ".join(f"{x}{i}" for i in range(60)) for x in "tuv")
    rows = [(2, t), (2, u), (1, t), (4, u + " more"), (3, v), (None, v), (None, v), (5, None), (5, None), (7, ""), (8, "a b c d e f g"), (8, "a b c d e f g"), (None, "k l m n o p"), (None, "k l m n o p")]
    df = spark.createDataFrame([(d, x, i) for i, (d, x) in enumerate(rows)], "doc_id bigint, text string, mark int")
    kept = N.distinct_documents(df)
    assert kept.columns == df.columns
    want = [(1, t), (2, u), (3, v), (5, None), (5, None), (7, ""), (8, "a b c d e f g"), (None, "k l m n o p")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_bridged_classes_stay_whole(spark):
    """A, A', m1, m2, B', B: only the edited members m1 and m2 connect the families of A and of B."""
    rnd, rows = random.Random(5), []
    for g in range(60):
        a = [f"g{g}w{i}" for i in range(300)]
        m1 = [f"{w}x" if i in (10, 200) else w for i, w in enumerate(a)]
        m2 = [f"{w}y" if i in range(100, 126) else w for i, w in enumerate(m1)]
        b = [f"{w}z" if i in (40, 260) else w for i, w in enumerate(m2)]
        own = lambda ws: [*ws[:-1], f"o{rnd.random()}"]
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate((a, own(a), own(m1), own(m2), own(b), b))]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute(rows)
    assert got == want and set(Counter(want.values()).values()) == {6}


def test_samples_agree_as_often_as_sets_are_alike():
    rnd = np.random.default_rng(3)
    h = rnd.integers(0, 1 << 40, 400).astype(np.uint64)
    w = rnd.uniform(0.5, 3, 400)
    a, b = np.arange(0, 340), np.arange(60, 400)
    got = N.samples(np.concatenate((h[a], h[b])), np.concatenate((w[a], w[b])), np.array([0, len(a)]), 3000)
    want = w[60:340].sum() / w.sum()
    assert abs((got[0] == got[1]).mean() - want) < 0.03


def test_shingles_of_an_array_slice():
    t = pa.array(["drop me", "A b c d e f", "", "x y"]).slice(1)
    h, doc = N.shingle_hashes(t)
    assert doc.tolist() == [0, 0, 2] and h[0] == N.shingle_hashes(pa.array(["a B c d e"]))[0][0]


def test_a_bridge_between_two_led_families(spark):
    rnd = random.Random(7)
    between = " - - - - - "
    passage = lambda name, k: " ".join(f"{name}{k}.{i}" for i in range(10))
    core, own = [passage("core", k) for k in range(100)], {f: [passage(f, k) for k in range(22)] for f in "pq"}
    text = lambda some, end="": between.join(core + some) + between + end
    rows = []
    for f in "pq":
        for _ in range(60):
            out = rnd.sample(range(22), 4)
            rows.append((len(rows), text([x for k, x in enumerate(own[f]) if k not in out])))
    # of half the own passages each, and with a word of its own, so that it leads no group
    rows += [(len(rows) + i, text(own[f][:11], f"only {f}")) for i, f in enumerate("pq")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    apart = brute(rows[:-1])
    assert set(want.values()) == {0} and set(apart.values()) == {0, 60}
    assert {r.doc_id: r.class_id for r in N.classes(df).collect()} == want
    assert [r.doc_id for r in N.distinct_documents(df).collect()] == [0]


def test_outsiders_of_a_large_group(spark, monkeypatch):
    """One group of near copies that one family of two and single texts meet in all bands: found pairs are those of brute
    force, and members of the largest component are not paired with each other."""
    monkeypatch.setattr(N, "BLOCK", 7)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:-1], f"o{i}"])) for i in range(40)]
    edit = lambda k: " ".join(f"{w}{k}" if i % 40 < k else w for i, w in enumerate(base))
    rows += [(100 + k, edit(k % 9)) for k in range(27)] + [(200, " ".join(rnd.sample(base, 200)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in N.classes(df).collect()} == want and len(set(want.values())) > 2


def test_across_is_linear_in_the_largest_component(spark):
    """All members in one component but one that nothing could link: 8,000 tests a band group, not 32 million."""
    n = 8000
    from pyspark.sql import functions as F

    sets = spark.range(n).select(
        F.col("id").alias("node"), F.lit(100.0).alias("total"), F.when(F.col("id") < n - 1, 1.0).otherwise(0.81).alias("share"), F.array(F.lit(1).cast("bigint")).alias("bands"),
        F.lit(bytes(N.C.pack(np.arange(5, dtype=np.uint64), True))).alias("shingles"), F.lit(bytes(N.C.pack(np.ones(5)))).alias("tf"), F.lit(bytes(N.C.pack(np.full(5, 2)))).alias("df"),
    )
    sets = N.C.written(sets, "sets")
    members = sets.select(F.lit(0).alias("band"), F.lit(1).cast("bigint").alias("key"), "node", "total", "share")
    labels = spark.range(n - 1).select("id", F.lit(0).cast("bigint").alias("component"))
    compared = spark.createDataFrame([], "a bigint, b bigint, similarity double")
    import time

    began = time.time()
    assert N._across(members, labels, compared, sets, n, False).count() == 0 and time.time() - began < 60
