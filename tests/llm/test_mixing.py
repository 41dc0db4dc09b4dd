import math
import re

from pyspark.sql import functions as F

from quirefold.llm import mixing as M


def water(sizes, weights=M.WEIGHTS, ceiling=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(w[s] for s in order if s not in capped)
        level = (total - sum(ceiling * sizes[s] for s in capped)) / free if free else 0
        over = {s for s in order if s not in capped and w[s] * level > ceiling * sizes[s]}
        if not over:
            return {s: ceiling * sizes[s] if s in capped else w[s] * level for s in order}
        capped |= over


def test_mix(spark, sf):
    rows = M.op9_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    by = {}
    for i, d in docs.items():
        by[d.source] = by.get(d.source, 0) + size[i]
    want = water(by)
    taken = dict.fromkeys(by, 0)
    assert len(rows) == len(docs)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == by[s] and math.isclose(r.target, want[s], rel_tol=1e-9) and r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[s] += r.taken
    for s in by:
        assert abs(taken[s] - want[s]) <= max(size[i] for i, d in docs.items() if d.source == s)
    again = {r.doc_id: r.taken for r in M.op9_mixing(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_edges_and_tree(spark):
    rows = [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i % 7}", 1) for i in range(70_000)] + [(None, None, None, 2), (5, "a b", None, 3), (5, "a b", None, 3), (7, "é" * 10, "é", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target int")
    got = M.mix(M.sizes(df)).collect()
    assert len(got) == len(rows)
    want, taken, most = {}, {}, {}
    for r in got:
        want[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
        most[r.source] = max(most.get(r.source, 0), r["size"])
        assert 0 <= r.copies <= 3
    assert all(abs(taken[s] - want[s]) <= 5 * max(most[s], 1) for s in want)
    assert M.mix(M.sizes(df.limit(0))).collect() == []


def test_rows_that_repeat_a_hundred_thousand_times(spark):
    n = 100_000
    hot = spark.range(n).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'one two three' AS text", "'a' AS source")
    rest = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 7 AS INT)) AS text", "IF(id % 2 = 0, 'b', 'a') AS source")
    got = M.mix(M.sizes(hot.unionByName(rest))).groupBy("source", "doc_id", "size", "target", "source_size").agg({"copies": "sum", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == n + 300
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert sum(r["count(1)"] * r["size"] for r in mine) == mine[0].source_size
        assert abs(sum(r["sum(copies)"] * r["size"] for r in mine) - mine[0].target) <= 20


def test_documents_repeat(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 1), (2, "a", "y", 1), (3, "b", "y", 1), (3, "b", "y", 1), (None, None, None, None)], "doc_id bigint, text string, source string, copies int")
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    assert all(n <= 3 * (2 if i == 3 else 1) for i, n in out.groupBy("doc_id").count().collect())


def rounded_by_hand(units, draw, block):
    """take of each unit {(doc_id, mark): (source, size, n, p)}, one at a time; draw(unit, level): (hash of the block, r)."""
    take, level, sources = {}, 0, {}
    for u, (source, size, n, p) in units.items():
        sources.setdefault(source, (n, {}))[1][u] = (size, p)
    for n, open_ in sources.values():
        level = 0
        while open_:
            blocks, met, left = -(-n // block), {}, {}
            for u in sorted(open_, key=lambda u: (-open_[u][0], u)):
                h, r = draw(u, level)
                b = h % blocks
                if b not in met:
                    met[b] = (u, open_[u][1])
                    continue
                (first, p), q = met[b], open_[u][1]
                low, s = p + q < 1, p + q
                goes = r < (q / s if low else (1 - q) / (2 - s))
                take[first if goes else u] = 0 if low else 1
                met[b] = (u if goes else first, s if low else s - 1)
            for u, p in met.values():
                if p <= 1e-9 or p >= 1 - 1e-9:
                    take[u] = round(p)
                elif blocks == 1:
                    take[u] = int(draw(u, level)[1] < p)
                else:
                    left[u] = (open_[u][0], p)
            open_, n, level = left, blocks, level + 1
    return take


def test_taken_equals_rounding_by_hand(spark, sf, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    sized = M.sizes(spark.read.parquet(f"{sf}/documents.parquet"))
    got = M.mix(sized).collect()
    levels = 5
    columns = [c for k in range(levels) for c in (F.xxhash64("doc_id", "mark", F.lit(M.SEED + k)).alias(f"h{k}"), M._uniform(F.col("doc_id"), F.col("mark"), F.lit(M.SEED - 1 - k)).alias(f"r{k}"))]
    drawn = {(r.doc_id, r.mark): r for r in sized.select("doc_id", "mark", *columns).collect()}
    assert len(drawn) == len(got) > 8 * 8
    n, whole, units = {}, {}, {}
    for r in got:
        n[r.source] = n.get(r.source, 0) + 1
    for r in got:
        rate = min(r.target / r.source_size, 3.0) if r.source_size else 0.0
        whole[r.doc_id, r.mark] = math.floor(rate + 1e-9) if r.source_size else 0
        p = rate - whole[r.doc_id, r.mark] if r["size"] else 0.0
        if p > 1e-9:
            units[r.doc_id, r.mark] = (r.source, r["size"], n[r.source], p)
    take = rounded_by_hand(units, lambda u, k: (drawn[u][f"h{k}"], drawn[u][f"r{k}"]), 8)
    assert 0 < sum(take.values()) < len(take) == len(units)
    assert {(r.doc_id, r.mark): r.copies for r in got} == {u: whole[u] + take.get(u, 0) for u in whole}
