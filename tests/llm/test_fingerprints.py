import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quirefold.llm import fingerprints as P


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    out = {}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        h = len(t) // 2
        out[i] = (t[: len(t) - h] + u[:h], u)
    return out


def test_against_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, text = edited(docs), dict(docs)
    got = {r.doc_id: r for r in P.op7_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for i, r in got.items():
        assert r.n_chars == len(text[i]) and r.edited_sha256 == hashlib.sha256(want[i][0].encode()).hexdigest()
        assert abs(r.near_edited - jaccard(text[i], want[i][0])) < 0.2 and abs(r.near_next - jaccard(text[i], want[i][1])) < 0.2
        n = len(shingles(text[i]))
        assert r.n_shingles == n if n < P.K else abs(r.n_shingles / n - 1) < 0.5
        assert by_text.setdefault(text[i], r.fingerprint) == r.fingerprint
    assert sum(abs(r.near_edited - jaccard(text[i], want[i][0])) for i, r in got.items()) / len(got) < 0.03


@pytest.mark.parametrize("rows", [[(5, "a b c d e f g h")], [(None, None), (1, ""), (1, ""), (2, "é🙂 x"), (9, " \n "), (10, "w " * 30_000)], [(i * i, f"t{i} u v w x y z") for i in range(150)]])
def test_edges(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, sketch int")
    got = P.fingerprints(df).select("doc_id", "text", "next_text").collect()
    ordered = [(i, t or "") for i, t in rows]
    want = [(i, t, u) for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert P.fingerprints(df.limit(0)).collect() == []


def test_merge_and_containment(spark):
    t = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(t, " ".join(t.split()[:1000]))], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    r = df.select(P.containment(F.col("b"), F.col("a")).alias("in"), P.containment(F.col("a"), F.col("b")).alias("of"), (P.merge(F.col("a"), F.col("b")) == F.col("a")).alias("same")).first()
    assert r["in"] > 0.8 and abs(r["of"] - 1 / 3) < 0.12 and r["same"]
