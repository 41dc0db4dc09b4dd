"""Toxic spans and document scores by a linear-chain conditional random field (operator 8).

Tokens are runs of ASCII letters and digits (A-Z as a-z) and of all bytes beyond ASCII. Features are hashes: the word,
its first four, five and six bytes, and the words before and after it in the sentence. Chains are whole sentences.

Learning uses SAMPLE labelled documents of either class at most, chosen by hash (the bound is this parameter). Labels
belong to documents, so tokens are labelled first: among features that hardly occur in clean documents, the one that
explains most of the toxic documents not yet explained is taken, until none explains SUPPORT of them; tokens with such a
feature in toxic documents are toxic. The field is then fitted to all sentences of the sample that hold such a token, and
to one in PLAIN of its other sentences (a second bound on the labelled sample, a parameter of fit).

Scoring runs forward-backward over every sentence of every whole text. A document's score is the largest marginal of its
tokens, so that a long text is not suspect for its length; spans are tokens of a marginal of one half and more.

Defined results: null and empty texts score 0; so do all if nothing was learned; a null id is never held out; rows repeat
as in the input; a document with several labels counts as toxic if one says so; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from . import common as C

SAMPLE = 2_000
SUPPORT = 3
PRECISION = 0.99
TABLE_BITS = 20
PREFIXES = (4, 5, 6)
#: Columns of a token's own features; two of its neighbours follow.
OWN = 1 + len(PREFIXES)
EPOCHS = 12
#: Of the sample's sentences without a toxic token, one in so many is fitted (1: all); the labelled sample is bounded by it.
PLAIN = 10
_SCALE = 1 << 20

_SEP = np.ones(256, bool)
_SEP[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _SEP[_a:_b] = False
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


class Tokens:
    """Tokens of some texts: hashed features, the text, the chain, and where they are in the texts' bytes."""

    def __init__(self, texts: pa.Array):
        offsets, data = C.string_buffers(texts)
        inside = ~_SEP[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        first[heads] = inside[heads]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(first)
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        n = len(self.start)
        if not n:
            self.features, self.chain, self.stop = np.zeros((0, OWN + 2), np.int64), np.zeros(0, np.int64), self.start
            return
        stops = np.append(self.start, len(data))[1:]
        length = np.diff(np.concatenate(([0], np.cumsum(inside))) [np.append(self.start, len(data))])
        self.stop = np.minimum(self.start + length, stops)
        part = data[self.start[0] :]
        place = np.arange(len(part)) - np.repeat(self.start - self.start[0], np.diff(np.append(self.start, len(data))))
        value = np.where(_SEP[part], np.uint64(0), C._LOWER[part] * C._powers(int(place.max()) + 1)[place])
        at = self.start - self.start[0]
        columns = [np.add.reduceat(value, at)] + [np.add.reduceat(np.where(place < k, value, np.uint64(0)), at) + np.uint64(k) for k in PREFIXES]
        enders = np.concatenate(([0], np.cumsum(_ENDS[data])))[self.start]
        new = np.ones(n, bool)
        new[1:] = (np.diff(enders) > 0) | (np.diff(self.doc) > 0)
        self.chain = np.cumsum(new) - 1
        word, last = C.mix(columns[0]), np.append(new[1:], True)
        before, after = np.append(np.uint64(0), word[:-1]), np.append(word[1:], np.uint64(0))
        before[new], after[last] = 0, 0
        columns += [before + np.uint64(101), after + np.uint64(202)]
        self.features = np.stack([(C.mix(c) >> np.uint64(64 - TABLE_BITS)).astype(np.int64) for c in columns], axis=1)


def _grid(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(step within its chain, length of each chain)"""
    n = np.bincount(chain)
    return np.arange(len(chain)) - (np.cumsum(n) - n)[chain], n


def marginals(unary: np.ndarray, chain: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 for each token, and of each pair of labels (from, to) summed over all steps.
    unary: score of label 1 (label 0 scores 0); jump: scores of the four label pairs. Chains of like length are worked
    through together, so that a long one takes no room for the others."""
    p, pairs = np.zeros(len(unary)), np.zeros((2, 2))
    size = np.bincount(chain)[chain] if len(chain) else np.zeros(0, np.int64)
    kind = np.frexp(np.maximum(size - 1, 0).astype(np.float64))[1]
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        p[mine], more = _marginals(unary[mine], np.unique(chain[mine], return_inverse=True)[1], jump)
        pairs += more
    return p, pairs


def _marginals(unary: np.ndarray, chain: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step, n = _grid(chain)
    order = np.argsort(-n, kind="stable")  # longest chains first, so that those still running are a prefix
    row = np.empty_like(order)
    row[order] = np.arange(len(order))
    longest = int(n.max())
    grid = np.zeros((longest, len(n)))
    grid[step, row[chain]] = unary
    running = [int(k) for k in np.searchsorted(-n[order], -np.arange(longest), side="left")]
    e = np.exp(jump)
    s = np.exp(np.clip(grid, -60, 60))
    a = np.zeros((longest, len(n), 2))
    b = np.ones((longest, len(n), 2))
    a[0, :, 0], a[0, :, 1] = 1, s[0]
    a[0] /= a[0].sum(axis=1, keepdims=True)
    for t in range(1, longest):
        k = running[t]
        x = a[t - 1, :k] @ e
        x[:, 1] *= s[t, :k]
        a[t, :k] = x / x.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        k = running[t]
        y = b[t, :k].copy()
        y[:, 1] *= s[t, :k]
        joint = a[t - 1, :k, :, None] * e[None] * y[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        x = y @ e.T
        b[t - 1, :k] = x / x.sum(axis=1, keepdims=True)
    p = a * b
    p = p[..., 1] / np.maximum(p.sum(axis=2), 1e-300)
    return p[step, row[chain]], pairs


def explain(features: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Features that explain the toxic documents. features: of each document, distinct."""
    size = 1 << TABLE_BITS
    n = np.array([len(f) for f in features], np.int64)
    flat, owner = np.concatenate([np.zeros(0, np.int32), *features]), np.repeat(np.arange(len(features), dtype=np.int32), n)
    bad = toxic[owner]
    clean = np.bincount(flat[~bad], minlength=size)
    flat, owner = flat[bad], owner[bad]
    balance = max(toxic.sum(), 1) / max((~toxic).sum(), 1)
    whole = np.bincount(flat, minlength=size)
    usable = whole / np.maximum(whole + clean * balance, 1e-9) >= PRECISION
    keep = usable[flat]
    flat, owner = flat[keep], owner[keep]
    chosen = []
    while len(flat):
        count = np.bincount(flat, minlength=size)
        best = int(np.argmax(count))
        if count[best] < SUPPORT:
            break
        chosen.append(best)
        gone = np.zeros(len(features), bool)
        gone[owner[flat == best]] = True
        left = ~gone[owner]
        flat, owner = flat[left], owner[left]
    return np.array(chosen, np.int64)


def _packed(batches):
    """(toxic, features, chains) of each text of (text, toxic): the driver gets hashes and no text."""
    for batch in C.slices(batches, "text"):
        t = Tokens(batch.column(0))
        ends = np.searchsorted(t.doc, np.arange(len(batch) + 1))
        cut = [(t.features[a:b], t.chain[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        features = [C.pack(f.reshape(-1).astype(np.uint64)) for f, _ in cut]
        chains = [C.pack((c - c[:1].sum()).astype(np.uint64), True) for _, c in cut]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(features, pa.binary()), pa.array(chains, pa.binary())], ["toxic", "features", "chains"])


def fit(features: np.ndarray, owner: np.ndarray, chain: np.ndarray, toxic: np.ndarray, plain: int = PLAIN) -> dict:
    """Weights by hashed feature, and the scores of label pairs. owner: the text of each token; toxic: of each text."""
    bounds = np.searchsorted(owner, np.arange(len(toxic) + 1))
    marks = explain([np.unique(features[a:b, :OWN]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], toxic)
    is_mark = np.zeros(1 << TABLE_BITS, bool)
    is_mark[marks] = True
    label = is_mark[features[:, :OWN]].any(axis=1) & toxic[owner]
    # all chains with a toxic token; of the others one in `plain`, by a hash of its number
    hot = np.zeros(int(chain.max()) + 1 if len(chain) else 0, bool)
    hot[chain[label]] = True
    some = hot | (C.mix(np.arange(len(hot), dtype=np.uint64)) % np.uint64(plain) == 0)
    use = some[chain] if len(hot) else np.zeros(0, bool)
    f, y = features[use].astype(np.int64), label[use].astype(np.float64)
    chain = np.unique(chain[use], return_inverse=True)[1]
    w, jump = np.zeros(1 << TABLE_BITS), np.zeros((2, 2))
    if not len(y):
        return {"weights": w, "jump": jump, "bias": -np.inf}  # no token is toxic
    same = chain[1:] == chain[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same].astype(int), y[1:][same].astype(int)), 1)
    g_w, g_j, bias, g_b = np.full(len(w), 1e-8), np.full((2, 2), 1e-8), -2.0, 1e-8
    for _ in range(EPOCHS * 5):
        p, pairs = marginals(w[f].sum(axis=1) + bias, chain, jump)
        d = y - p
        grad = np.bincount(f.ravel(), np.repeat(d, f.shape[1]), minlength=len(w)) - 0.02 * w
        g_w += grad**2
        w += 0.7 * grad / np.sqrt(g_w)
        g_j += (seen - pairs) ** 2
        jump += 0.1 * (seen - pairs) / np.sqrt(g_j)
        g_b += d.sum() ** 2
        bias += 0.3 * d.sum() / np.sqrt(g_b)
    return {"weights": w.astype(np.float32), "jump": jump, "bias": float(bias)}


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> dict:
    """Fits the field on `sample` documents of either class at most (in expectation), whole texts, equal ones once."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max("toxic").alias("__toxic"))
    size = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    draw = F.pmod(F.xxhash64("__id", F.lit(8)), F.lit(_SCALE))
    share = F.when(F.col("__toxic") == 1, F.lit(min(1.0, sample / max(size.get(1, 0), 1)))).otherwise(F.lit(min(1.0, sample / max(size.get(0, 0), 1))))
    chosen = known.where(draw < share * _SCALE)  # as many rows as the sample, whatever the corpus: small enough to broadcast
    drawn = docs.where(F.col(text).isNotNull()).join(F.broadcast(chosen), F.col(doc_id) == F.col("__id")).select(F.col(text).alias("text"), "__toxic")
    once = drawn.groupBy(F.xxhash64("text").alias("mark")).agg(F.max(F.struct("__toxic", "text")).alias("r")).orderBy("mark").select("r.text", F.col("r.__toxic").cast("int").alias("toxic"))
    rows = once.mapInArrow(_packed, "toxic int, features binary, chains binary").collect()
    features, owner, chain, chains = [np.zeros((0, OWN + 2), np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for i, r in enumerate(rows):
        features.append(C.unpack(r["features"]).astype(np.int32).reshape(-1, OWN + 2))
        own = C.unpack(r["chains"], True).astype(np.int32)
        owner.append(np.full(len(own), i, np.int32))
        chain.append(own + chains)
        chains += int(own[-1]) + 1 if len(own) else 0
    return fit(np.concatenate(features), np.concatenate(owner), np.concatenate(chain), np.array([r["toxic"] == 1 for r in rows], bool))


def score(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, score, and spans: array<struct<start,end>> in code points."""
    small = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = small.value
        for batch in C.slices(batches, "__text"):
            t = Tokens(batch.column(0))
            p, _ = marginals(m["weights"][t.features].sum(axis=1, dtype=np.float64) + m["bias"], t.chain, m["jump"])
            most = np.zeros(len(batch))
            np.maximum.at(most, t.doc, p if np.isfinite(m["bias"]) else 0.0)
            spans: list[list] = [[] for _ in range(len(batch))]
            if (hits := np.flatnonzero(p >= 0.5)).size:
                points = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
                begin = points[t.offsets[:-1]]
                for k in hits:
                    d = t.doc[k]
                    spans[d].append({"start": int(points[t.start[k]] - begin[d]), "end": int(points[t.stop[k]] - begin[d])})
            span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(most, pa.float64()), pa.array(spans, span_type)], [*batch.schema.names[1:], "score", "spans"])

    kept = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), *keep)
    return kept.mapInArrow(run, kept.drop("__text").schema.add("score", "double").add("spans", ArrayType(StructType().add("start", "integer").add("end", "integer"))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = C.table(spark, sf_dir, "documents").withColumn("held_out", held)
    model = train(docs.where(~F.col("held_out")), C.table(spark, sf_dir, "labels").where(~held))
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return score(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), shown.alias("spans"))
