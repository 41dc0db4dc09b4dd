"""Near-duplicate embeddings by collision-counting projections (operator 5).

Unit vectors are projected on DIRECTIONS random directions. Two vectors collide on a direction if one's value lies in a
window around the other's; the window's half width is the standard deviation of the difference at the least similarity.
Each projection of a block is sorted, windows are found by binary search, and collisions are counted per pair. Pairs
with at least `needed` collisions are verified by their cosine in double precision; `needed` is the largest count that
a pair at the least similarity misses with a probability of MISS at most (binomial tail).

A label's vectors are dealt to blocks of about BLOCK by hash, and pairs of blocks are compared, each in a group of its
own, so a label that holds a third of all rows is spread like any other. Pairs are not emitted: a group gives each
vector's number of links and the smallest id that it reaches within the group. All vectors of a label are compared with
each other, as the operation asks, so the work grows with the square of a label's size.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors of a null label, link
with nothing; so do vectors of different lengths; rows that repeat an id are one vector (the one whose hash is least
links) and give a row each; a null id has no links and no component, and is kept; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

COSINE = 0.98
DIRECTIONS = 32
MISS = 1e-6
BLOCK = 512
SEED = 17


def needed(p: float, n: int = DIRECTIONS, miss: float = MISS) -> int:
    """Largest count that a binomial variable stays below with a probability of `miss` at most; 1 at least."""
    below, k = 0.0, 0
    while k < n and below + math.comb(n, k) * p**k * (1 - p) ** (n - k) <= miss:
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        k += 1
    return max(k, 1)


#: Share of a normal variable within one standard deviation.
WITHIN = math.erf(1 / math.sqrt(2))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, DIRECTIONS))


def collisions(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """Of each row of a with each row of b: in how many columns b's value lies within `width` of a's."""
    out = np.zeros(len(a) * len(b), np.int64)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        ascending = b[order, k]
        first, last = np.searchsorted(ascending, a[:, k] - width), np.searchsorted(ascending, a[:, k] + width, side="right")
        n = last - first
        pairs = np.repeat(np.arange(len(a)) * len(b), n) + order[C.ragged(first, n)]
        out += np.bincount(pairs, minlength=len(out))
    return out.reshape(len(a), len(b))


def linked(x: np.ndarray, y: np.ndarray | None, least: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs whose cosine is `least` or more; without y, of x with itself, each pair once."""
    other = x if y is None else y
    norm, norm_other = np.linalg.norm(x, axis=1), np.linalg.norm(other, axis=1)
    u, v = x / norm[:, None], other / norm_other[:, None]
    g = directions(x.shape[1])
    # unit vectors of that cosine are sqrt(2 - 2 * least) apart; so is the deviation of their difference's projection
    count = collisions(u @ g, v @ g, math.sqrt(2 - 2 * least))
    i, j = np.nonzero(count >= needed(WITHIN))
    if y is None:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 100_000):
        p, q = i[at : at + 100_000], j[at : at + 100_000]
        keep[at : at + 100_000] = np.einsum("ij,ij->i", x[p], other[q]) / (norm[p] * norm_other[q]) >= least
    return i[keep], j[keep]


def _group(least: float):
    def run(t: pa.Table) -> pa.Table:
        ids, block = t["vec_id"].to_numpy(), t["block"].to_numpy()
        x = np.array(t["embedding"].to_pylist(), np.float64)
        low = block == t["a"][0].as_py()
        if t["a"][0].as_py() == t["b"][0].as_py():
            left = right = np.flatnonzero(low)
            i, j = linked(x, None, least)
        else:
            left, right = np.flatnonzero(low), np.flatnonzero(~low)
            i, j = linked(x[left], x[right], least) if len(left) and len(right) else (np.zeros(0, np.int64),) * 2
        i, j = left[i], right[j]
        n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        root = ids.copy()
        while True:  # smallest id over links
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            if (new == root).all():
                break
            root = new
        hit = n > 0
        return pa.table({"vec_id": pa.array(ids[hit], pa.int64()), "n": pa.array(n[hit], pa.int64()), "root": pa.array(root[hit], pa.int64())})

    return run


def classes(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    e = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False)) & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", e.alias("embedding"))
    good = rows.where(sound).groupBy("vec_id").agg(F.min_by(F.struct("label", "embedding"), F.xxhash64("label", "embedding")).alias("v")).select("vec_id", "v.*").withColumn("dim", F.size("embedding"))
    good = C.written(good, "vectors")
    sizes = C.written(good.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "labels")
    dealt = good.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("label", "dim", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "vec_id", "embedding")
    found = sent.groupBy("label", "dim", "a", "b").applyInArrow(_group(least), "vec_id bigint, n bigint, root bigint")
    found = C.written(found, "links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    labels = C.components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    by_id = counts.join(labels.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id").join(by_id, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {COSINE}),
r AS (SELECT DISTINCT a, a AS x FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.x = l.a),
c AS (SELECT a, min(x) AS component FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
