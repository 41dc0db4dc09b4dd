"""Near-duplicate documents by consistent weighted sampling (operator 4).

Weights. A document is the weighted set of its five-word shingles (words as in common.WORD, A-Z as a-z; a text of fewer
words is one shingle): occurrences times 1 + IDF_SHARE * log(N / df) / log(N), df documents of N with that shingle. This
inverse document frequency lies between 1 and 1 + IDF_SHARE, so that a passage which a third of the corpus shares still
counts and edits of a much-copied text do not outweigh it. Of the 1,966 pairs of the 10,000 documents of sf0.1 that are
0.8 alike without weights, a share of 0.25 keeps 98.9 %, 0.5 keeps 96.5 %, 1 keeps 94.5 %, and log(N / df) alone 89.9 %
(none of them links more than two others): the copies themselves raise the df of what they share. Document
frequencies are exact: chunks of documents send their distinct shingles, sorted and packed, to hash buckets, and get the
sums back.

Candidates. A pair of similarity 0.8 shares 0.8 of either document's weight, and all that is shared has df of 2 or more.
Documents with less weight of that kind are out, without loss. The rest are sampled by improved consistent weighted
sampling, BANDS x ROWS samples; documents that agree on a band meet. A pair of similarity s agrees on one of the bands
with probability 1 - (1 - s**ROWS)**BANDS, 0.9998 at 0.8.

Verification. In a band's group all are compared with a leader of each class of weights, by exact weighted Jaccard
similarity; the leader is the one with the largest share of repeated weight (an original, among its edited copies). Those
it does not resemble are led again, LEADERS times, each new leader compared with all the group. Then components of the
links found are taken, a leader of each component is compared with the group's members of other components, and at last
every pair of a group's members, led ones included, whose components still differ. So classes are those of all pairs that
meet; members of a group's largest component are not paired with each other. Of these pairs only those are made that could
reach SIMILARITY: they share at most the smaller of their repeated weights, and in each of SLOTS classes of shingle hashes
the smaller of their repeated weights there. Both are upper bounds, so that no link is lost. A pair that meets in several
bands is made in the first. The tests of that last step are as many as the members outside of a group's largest component
times the group, dealt in blocks of BLOCK; rows are made for pairs near SIMILARITY only.

Defined results: null, empty and blank texts link with nothing; equal texts are one class; a null id is a row of its own
and never names a class of others; repeated rows give a row each; other columns are not read. The input is read twice and
must come in the same order both times, as a table does; a difference stops the job. A text is known by 64 bits of its
hash: of 10**10 different texts about three pairs are expected to share one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
SIMILARITY = 0.8
IDF_SHARE = 0.25
BANDS, ROWS = 12, 3
LEADERS = 3
CHUNK_BYTES = 1 << 20
#: Members of a band's group that are compared with its outsiders in one piece.
BLOCK = 4096
#: Classes of shingle hashes for the upper bound of what a pair shares.
SLOTS = 64

_U64 = np.uint64


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's shingles in order, and the place of its text."""
    words, doc = C.word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    first = np.cumsum(n) - n
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(texts)), shingles)
    start = C.ragged(first, shingles)
    out = np.zeros(len(start), np.uint64)
    step = _U64(0x9E6C63D0876A9A47)
    for k in range(size):
        inside = k < n[owner]
        out[inside] = (out[inside] + words[start[inside] + k] + _U64(k + 1)) * step
    return C.mix(out), owner


def bits_for(n_bytes: int) -> int:
    """Bits of a shingle's hash: at most one shingle in a thousand shares its hash with another, whatever the corpus."""
    return min(64, max(40, n_bytes.bit_length() + 9))


def _counted(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, occurrences) of each text's distinct shingles, by hash."""
    h, doc = shingle_hashes(texts)
    h >>= _U64(64 - bits)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return h[first], doc[first], np.diff(np.append(first, len(h)))


def _strings(t: pa.Table, name: str) -> pa.Array:
    col = t[name].combine_chunks()
    return col.chunk(0) if isinstance(col, pa.ChunkedArray) and col.num_chunks == 1 else pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col


def _ask(n_buckets: int, bits: int):
    def run(docs: pa.Table) -> pa.Table:
        h, _, _ = _counted(_strings(docs, "text"), bits)
        h, df = np.unique(h, return_counts=True)
        bucket = ((h >> _U64(bits - 32)) * _U64(n_buckets)) >> _U64(32)
        full, at = np.unique(bucket, return_index=True)
        ends = np.append(at, len(h))[1:]
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "chunk": pa.array([docs["chunk"][0].as_py()] * len(full), pa.int64()),
            "shingles": pa.array([C.pack(h[a:b], True) for a, b in zip(at, ends, strict=True)], pa.binary()),
            "df": pa.array([C.pack(df[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()),
        })

    return run


def _add_up(asked: pa.Table) -> pa.Table:
    parts = [C.unpack(b, True) for b in asked["shingles"].to_pylist()]
    counts = np.concatenate([C.unpack(b) for b in asked["df"].to_pylist()]).astype(np.float64)
    _, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, counts)[place].astype(np.uint64)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "df": pa.array([C.pack(x) for x in np.split(total, cuts)], pa.binary())})


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + IDF_SHARE * np.log(n / np.minimum(df, n)) / math.log(max(n, 2))


def samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Improved consistent weighted sampling: n samples of each set; a set is the elements from one start to the next."""
    out = np.empty((len(starts), n), np.uint64)
    log_w, size = np.log(weight), np.diff(np.append(starts, len(h)))
    unit = 1 / (1 << 24)
    low = _U64((1 << 24) - 1)
    for j in range(n):
        a, b = C.mix(h + C.mix(np.array([2 * j + 1], np.uint64))), C.mix(h ^ C.mix(np.array([2 * j + 2], np.uint64)))
        u = [((x & low).astype(np.float64) + 0.5) * unit for x in (a, a >> _U64(24), b, b >> _U64(24))]
        beta = ((a >> _U64(48)).astype(np.float64) * 65536 + (b >> _U64(48)).astype(np.float64)) / (1 << 32)
        r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
        t = np.floor(log_w / r + beta)
        cost = np.log(c) - r * (t - beta + 1)
        least = np.repeat(np.minimum.reduceat(cost, starts), size)
        hit = np.flatnonzero(cost == least)
        owner = np.searchsorted(starts, hit, side="right") - 1
        _, first = np.unique(owner, return_index=True)
        k = hit[first]
        out[:, j] = C.mix(h[k] ^ C.mix(t[k].astype(np.int64).astype(np.uint64)))
    return out


_JUDGED = "doc_id {id}, mark bigint, node bigint, total double, share double, bands array<bigint>, shingles binary, tf binary, df binary"


def _judge(n_docs: int, bits: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _strings(docs, "text")
        h, doc, tf = _counted(texts, bits)
        uniq, place = np.unique(h, return_inverse=True)
        df = np.concatenate([np.zeros(0, np.uint64), *(C.unpack(b) for _, b in sorted(zip(answers["bucket"].to_pylist(), answers["df"].to_pylist(), strict=True)))])
        if len(df) != len(uniq):
            raise RuntimeError("a chunk was cut differently in two readings; write the input as a table first")
        df = df[place]
        weight = tf * idf(df.astype(np.float64), n_docs)
        total = np.bincount(doc, weight, minlength=len(texts))
        repeated = np.bincount(doc, weight * (df >= 2), minlength=len(texts))
        candidate = (total > 0) & (repeated >= SIMILARITY * total * (1 - 1e-12))
        node: list = [None] * len(texts)
        bands, packed, seen = [None] * len(texts), [(None, None, None)] * len(texts), set()
        firsts = []
        for i in np.flatnonzero(candidate):
            node[i] = int.from_bytes(hashlib.blake2b(texts[i].as_py().encode(), digest_size=8).digest(), "little", signed=True)
            if node[i] not in seen:
                seen.add(node[i])
                firsts.append(i)
        order = np.argsort(doc, kind="stable")
        begin = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))
        at = 0
        while at < len(firsts):
            some, size = [], 0
            while at < len(firsts) and (not some or size < 200_000):
                some.append(firsts[at])
                size += begin[firsts[at] + 1] - begin[firsts[at]]
                at += 1
            n = begin[np.array(some) + 1] - begin[np.array(some)]
            rows = order[C.ragged(begin[np.array(some)], n)]
            drawn = samples(h[rows], weight[rows], np.cumsum(n) - n, BANDS * ROWS).reshape(len(some), BANDS, ROWS)
            key = np.zeros((len(some), BANDS), np.uint64)
            for k in range(ROWS):
                key = C.mix(key + drawn[:, :, k] + _U64(k + 1))
            for i, b in zip(some, key.view(np.int64), strict=True):
                mine = order[begin[i] : begin[i + 1]]
                mine = mine[df[mine] >= 2]
                bands[i], packed[i] = b, (C.pack(h[mine], True), C.pack(tf[mine]), C.pack(df[mine]))
        return pa.table({
            "doc_id": docs["doc_id"],
            "mark": docs["mark"],
            "node": pa.array(node, pa.int64()),
            "total": pa.array(total, pa.float64()),
            "share": pa.array(np.where(total > 0, repeated / np.where(total > 0, total, 1), 0), pa.float64()),
            "bands": pa.array(bands, pa.list_(pa.int64())),
            **{c: pa.array([p[k] for p in packed], pa.binary()) for k, c in enumerate(("shingles", "tf", "df"))},
        })

    return run


def weigh(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document, mark: a hash of its text; candidates have a node (another), and one of each chunk's
    copies has samples."""
    r = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n_bytes, n_docs = r["bytes"] or 0, r["n"]
    chunks, bits = max(256, -(-n_bytes // CHUNK_BYTES)), bits_for(n_bytes)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "mark", F.monotonically_increasing_id()), F.lit(chunks)))  # rows that repeat are dealt, too
    asked = base.groupBy("chunk").applyInArrow(_ask(C.buckets_for(n_bytes), bits), "bucket bigint, chunk bigint, shingles binary, df binary")
    answers = asked.groupBy("bucket").applyInArrow(_add_up, "chunk bigint, bucket bigint, df binary")
    schema = _JUDGED.format(id=base.schema["doc_id"].dataType.simpleString())
    return C.written(base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_judge(n_docs, bits), schema), "weighed")


def _compare(n_docs: int):
    """Exact weighted Jaccard similarity of two documents, from what they repeat and their total weights."""

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            sims = []
            for a, b, wa, wb, sa, ta, da, sb, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != a:
                    last = (a, (C.unpack(sa, True), C.unpack(ta), idf(C.unpack(da).astype(np.float64), n_docs)))
                ha, fa, ia = last[1]
                _, i, j = np.intersect1d(ha, C.unpack(sb, True), assume_unique=True, return_indices=True)
                common = float((np.minimum(fa[i], C.unpack(tb)[j]) * ia[i]).sum())
                sims.append(common / (wa + wb - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, n_docs: int) -> DataFrame:
    """pairs (a, b) with their similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("total").alias("wa"), F.col("shingles").alias("sa"), F.col("tf").alias("ta"), F.col("df").alias("da"))
    right = sets.select(F.col("node").alias("b"), F.col("total").alias("wb"), F.col("shingles").alias("sb"), F.col("tf").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "wa", "wb", "sa", "ta", "da", "sb", "tb")
    return C.written(both.mapInArrow(_compare(n_docs), "a bigint, b bigint, similarity double"), "compared")


def _leaders(rows: DataFrame) -> DataFrame:
    """A leader for each band's group and class of weights: similar documents weigh about the same, so one leader serves
    those of like weight only."""
    first = F.min_by(F.struct("node", "total", "share"), F.struct(-F.col("share"), F.col("node")))
    weight = F.floor(F.log("total") / math.log(1 / SIMILARITY)).alias("weight")
    return rows.groupBy("band", "key", weight).agg(first.alias("l")).select("band", "key", F.col("l.node").alias("leader"), F.col("l.total").alias("l_total"), F.col("l.share").alias("l_share"))


def _could(total: Column, share: Column, other_total: Column, other_share: Column) -> Column:
    """Whether two documents could be similar: all that they share is repeated in both."""
    most = F.least(total * share, other_total * other_share)
    return most >= SIMILARITY * (total + other_total - most) * (1 - 1e-9)


def _slots(n_docs: int):
    """Repeated weight of each set by class of hashes."""

    def run(batches):
        for batch in batches:
            out = np.zeros((len(batch), SLOTS), np.float32)
            for i, (h, tf, df) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                slot = (C.unpack(h, True) % _U64(SLOTS)).astype(np.int64)
                out[i] = np.bincount(slot, C.unpack(tf) * idf(C.unpack(df).astype(np.float64), n_docs), minlength=SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), SLOTS).cast(pa.list_(pa.float32()))], ["node", "slots"])

    return run


def components_of(weighed: DataFrame, n_docs: int) -> DataFrame:
    """(id, component) of nodes that have a link: the smallest node that links connect each with."""
    sampled = weighed.where("bands IS NOT NULL")
    one = Window.partitionBy("node").orderBy("total")
    sets = C.written(sampled.select("node", "total", "share", "bands", "shingles", "tf", "df").withColumn("k", F.row_number().over(one)).where("k = 1").drop("k"), "sets")
    members = sets.select("node", "total", "share", F.posexplode("bands").alias("band", "key"))
    groups = members.groupBy("band", "key").count().where("count > 1").drop("count")
    members = C.written(members.join(groups, ["band", "key"]).select("band", "key", "node", "total", "share", F.lit(False).alias("led")), "members")
    compared = None
    for _ in range(LEADERS):
        lead = _leaders(members.where(~F.col("led")))
        m, g = members.alias("m"), lead.alias("g")
        near = (F.col("m.band") == F.col("g.band")) & (F.col("m.key") == F.col("g.key")) & (F.col("node") != F.col("leader")) & _could(*map(F.col, ("total", "share", "l_total", "l_share")))
        met = m.join(g, near).select("m.band", "m.key", "node", "leader")
        more = _new(compared, met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")), sets, n_docs)
        compared = more if compared is None else compared.unionByName(more)
        linked = compared.where(F.col("similarity") >= SIMILARITY)
        ways = linked.select(F.col("a").alias("leader"), F.col("b").alias("node")).unionByName(linked.select(F.col("b").alias("leader"), F.col("a").alias("node")))
        found = met.join(ways, ["leader", "node"]).select("band", "key", "node").unionByName(lead.select("band", "key", F.col("leader").alias("node"))).distinct()
        members = C.written(members.join(found.withColumn("now", F.lit(True)), ["band", "key", "node"], "left").select("band", "key", "node", "total", "share", (F.col("led") | F.coalesce("now", F.lit(False))).alias("led")), "members")
        if not members.where(~F.col("led")).limit(1).count():
            break
    labels = C.components(compared.where(F.col("similarity") >= SIMILARITY))
    for leaders in (True, False):
        more = _across(members, labels, compared, sets, n_docs, leaders)
        labels = C.joined(labels, more.where(F.col("similarity") >= SIMILARITY))
        compared = compared.unionByName(more)
    return labels


def _new(compared: DataFrame | None, pairs: DataFrame, sets: DataFrame, n_docs: int) -> DataFrame:
    """Of pairs (a, b), those that compared lacks, with their similarity."""
    pairs = pairs.distinct()
    return _verify(pairs if compared is None else pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"), sets, n_docs)


def _across(members: DataFrame, labels: DataFrame, compared: DataFrame, sets: DataFrame, n_docs: int, leaders: bool) -> DataFrame:
    """The pairs of a band's group whose components differ, with their similarity, but for those compared: all, or those
    with a leader of a component of two or more."""
    m = members.join(labels.select(F.col("id").alias("node"), "component"), "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("component"))
    apart = m.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "key")
    m = C.written(m.join(apart, ["band", "key"]), "apart")
    inside = sets.join(m.select("node").distinct(), "node", "left_semi")
    slots = inside.select("node", "shingles", "tf", "df").mapInArrow(_slots(n_docs), "node bigint, slots array<float>")
    m = C.written(m.join(inside.select("node", "total", "share", "bands").join(slots, "node"), "node"), "bounded")
    could = _could(*map(F.col, ("x.total", "x.share", "y.total", "y.share")))
    shared = F.aggregate(F.zip_with("x.slots", "y.slots", lambda a, b: F.least(a, b)), F.lit(0.0), lambda a, w: a + w)
    could = could & (shared >= SIMILARITY * (F.col("x.total") + F.col("y.total") - shared) * (1 - 1e-6))
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key"))
    ends = F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    if leaders:
        first = F.min_by(F.struct("node", "total", "share", "bands", "slots"), F.struct(-F.col("share"), F.col("node")))
        lead = m.groupBy("band", "key", "component").agg(first.alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key", "component", "l.*")
        met = m.alias("x").join(lead.alias("y"), same & (F.col("x.component") != F.col("y.component")) & could)
        return _new(compared, met.select(*ends), sets, n_docs)
    # a group's largest component needs no pair of its own: its other members meet all, the group being dealt in blocks
    sizes = m.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("band", "key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = m.join(C.written(sizes, "sizes"), ["band", "key"])
    rest = dealt.where("component <> largest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    all_ = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.component") < F.col("y.component"))
    first_met = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), F.lit(True)) == F.col("x.band") + 1
    met = rest.alias("x").join(all_.alias("y"), same & (F.col("x.block") == F.col("y.block")) & (F.col("x.component") != F.col("y.component")) & once & first_met & could)
    return _new(compared, met.select(*ends), sets, n_docs)


def _classed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, mark, class) of each row; class is null for those that link with nothing."""
    weighed = weigh(docs, text, doc_id)
    n_docs = weighed.count()
    labels = components_of(weighed, n_docs).select(F.col("id").alias("node"), "component")
    return C.written(weighed.select("doc_id", "mark", "node").join(labels, "node", "left").select("doc_id", "mark", F.coalesce("component", "node").alias("class")), "classed")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, kept): class_id is the smallest id of the documents that links and equal texts connect."""
    rows = _classed(docs, text, doc_id)
    named = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    named = rows.join(named, "class").select("doc_id", "class_id").unionByName(rows.where("class IS NULL").select("doc_id", F.col("doc_id").alias("class_id")))
    return named.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class, with its own columns: of the smallest id that is not null; of that id's texts the one with
    the smallest hash; of rows that repeat both any one. Rows that link with nothing stay, however often they repeat."""
    columns, rows = docs.columns, _classed(docs, text, doc_id).where("class IS NOT NULL")
    chosen = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("c")).select("class", "c.doc_id", "c.mark")
    state = rows.groupBy("doc_id", "mark", "class").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s.mark") == F.col("c.mark")) & (F.col("s.class") == F.col("c.class"))
    state = state.alias("s").join(chosen.alias("c"), same, "left").select(F.col("s.doc_id").alias("__id"), F.col("s.mark").alias("__mark"), F.col("c.class").isNotNull().alias("__kept"), F.col("n").alias("__n"))
    state = C.written(state.where("NOT __kept OR __n > 1"), "state")
    mine = F.col(f"d.{doc_id}").eqNullSafe(F.col("__id")) & (F.xxhash64(f"d.{text}") == F.col("__mark"))
    alone = docs.alias("d").join(state, mine, "left_anti").select(*(F.col(f"d.`{c}`") for c in columns))
    repeated = docs.alias("d").join(state.where("__kept"), mine).dropDuplicates(["__id", "__mark"]).select(*(F.col(f"d.`{c}`") for c in columns))
    return alone.unionByName(repeated)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.table(spark, sf_dir, "documents"))
