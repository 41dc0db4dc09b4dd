"""Language-model scores by an interpolated modified Kneser-Ney n-gram model (operator 6).

Words are counted first and numbered, in each hash bucket from its commonest word on, so that the numbers of common
words are small and pack well. Then tasks count the sequences of `order` words of some millions of tokens at a time and
send sorted, packed numbers and counts to hash buckets, which add them up. A bucket of k-word sequences is written as
sorted arrays of hashes with what belongs to them; what it knows of each sequence's first k - 1 words (total and how many
counts of 1, 2 and more follow) and of its last k - 1 words (one more different predecessor) goes on to the buckets one
order lower, down to single words. Numbers of buckets follow the corpus.

Scoring. Workers map the arrays of the shared folder into memory and look up hashes by binary search. The folder of
spark.checkpoint.dir has to be one that executors see as a path (file:/ or no scheme): only such files can be mapped.

Counts are those of the corpus in the highest order and numbers of different predecessors below it; each text begins with
order - 1 start marks, which are no tokens, and below the words every token is equally likely. Tokens of a text: its
words (common.WORD, A-Z as a-z), then one end. Nothing is pruned. Words are known by 64-bit hashes. Arrays of sequences
keep 28 bits of a hash besides its place among ranges of about 16 sequences, so that 6 of 10^8 unknown sequences are
taken for known ones, at any size; the commonest 15 values of a bucket stand in the 4 bits left.

Defined results: null text is empty and has one token, the end; with nothing to learn from, every probability is that of
an unknown word; rows repeat as in the input; a null id is never held out; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER = 3
#: Tokens that a task counts at a time.
BLOCK_TOKENS = 2_000_000
#: Bytes of text for each bucket of sequences.
BUCKET_BYTES = 16 << 20
#: Mapped files that a worker holds open; more are opened again when needed.
MOST_OPEN = 2_000
_U = np.uint64
_LOW = _U(0xFFFFFFFF)
FAR = 15
_START, _END = _U(0x5EED000000000001), _U(0x5EED000000000003)
#: The number of the start mark, and of a word that was not learned.
_START_ID, _UNKNOWN_ID = _U(0), _U(1 << 63)


def tokens(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the text) of order - 1 start marks, the words and the end of each text."""
    words, doc = C.word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64) if len(doc) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(n + order) - 1
    out = np.full(len(words) + order * len(texts), _START, np.uint64)
    out[np.arange(len(words)) + doc * order + order - 1] = words
    out[ends] = _END
    return out, np.repeat(np.arange(len(texts)), n + order)


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each sequence of word numbers, given by columns."""
    key = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        key = C.mix(key * _U(0xA24BAED4963EE407) + c)
    return key


def _place(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and where in the bucket's range it lies, in 2^-32."""
    x = (keys >> _U(32)) * _U(n)
    return x >> _U(32), x & _LOW


# -- sorted arrays in files --------------------------------------------------------------------------------------------


def store(path: str, keys: np.ndarray, values: list[np.ndarray], n_buckets: int, wide: bool = False) -> None:
    """A file of one bucket: the different rows of values, commonest first; where ranges of hashes start; the hashes in
    order; the row of each. wide: whole hashes, else 28 bits and the number of the row, or FAR if the row is listed with
    its place. A repeated task writes the same again, and readers see whole files only."""
    heads = max(1, len(keys) // 16)
    head = (_place(keys, n_buckets)[1] * _U(heads)) >> _U(32)
    o = np.argsort(keys if wide else head << _U(32) | keys & _LOW)
    fold = np.zeros(len(keys), np.uint64)
    for v in values:
        fold = C.mix(fold * _U(0xA24BAED4963EE407) + v.astype(np.uint64))
    by, at = C.runs(fold)
    first, times = by[at], np.diff(np.append(at, len(keys)))
    row = np.empty(len(keys), np.int64)
    row[by] = np.repeat(np.arange(len(at)), times)
    common = np.argsort(-times, kind="stable")
    place = np.empty(len(first), np.int64)
    place[common] = np.arange(len(first))
    rows = np.stack([v.astype(np.uint64)[first[common]] for v in values])
    starts = np.concatenate(([0], np.cumsum(np.bincount(head.astype(np.int64), minlength=heads)))).astype(np.uint32)
    row = place[row[o]]
    if wide:
        tails, far = keys[o], np.zeros(0, np.uint32)
    else:
        tails = ((keys[o] & _LOW) >> _U(4) << _U(4) | np.minimum(row, FAR).astype(np.uint64)).astype(np.uint32)
        far = np.flatnonzero(row >= FAR).astype(np.uint32)
        row = row[far]
    row = row.astype(np.min_scalar_type(max(len(first) - 1, 0)))
    sizes = np.array([len(keys), heads, *rows.shape, tails.itemsize, len(far), len(row), row.itemsize], np.uint64)
    part = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(part, "wb") as f:
        for a in (sizes, rows, tails, starts, far, row):
            f.write(np.ascontiguousarray(a).tobytes())
    os.replace(part, path)


class Arrays:
    """The files of a folder, mapped into memory."""

    def __init__(self, folder: str, n_buckets: int):
        self.folder, self.n, self.files = folder, n_buckets, OrderedDict()

    def _open(self, path: str):
        if path in self.files:
            self.files.move_to_end(path)
            return self.files[path]
        parts = None
        if os.path.exists(path):
            raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
            n, heads, width, rows, tail, n_far, n_row, size = raw[:64].view(np.uint64).astype(np.int64).tolist()
            cuts = np.cumsum([64, 8 * width * rows, tail * n, 4 * (heads + 1), 4 * n_far, size * n_row])
            table, tails, starts, far, row = (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            table = table.view(np.uint64).reshape(width, rows)
            parts = table, tails.view(f"u{tail}"), starts.view(np.uint32), far.view(np.uint32), row.view(f"u{size}")
        self.files[path] = parts
        if len(self.files) > MOST_OPEN:
            self.files.popitem(last=False)
        return parts

    def find(self, level: str, keys: np.ndarray, width: int) -> np.ndarray:
        """Values of ascending hashes, one column each; 0 where a hash is unknown."""
        out = np.zeros((width, len(keys)), np.uint64)
        bucket, part = _place(keys, self.n)
        firsts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + _U(1)))
        for b, i, j in zip(bucket[firsts].tolist(), firsts, np.append(firsts, len(keys))[1:], strict=True):
            parts = self._open(f"{self.folder}/{level}/{b}")
            if parts is None or not len(parts[1]):
                continue
            table, tails, starts, far, row = parts
            wide = tails.itemsize == 8
            head = ((part[i:j] * _U(len(starts) - 1)) >> _U(32)).astype(np.int64)
            want = keys[i:j] if wide else ((keys[i:j] & _LOW) >> _U(4)).astype(np.uint32)
            at = lambda x: tails.take(x, mode="clip")  # noqa: B023, E731
            hash_at = at if wide else lambda x: at(x) >> np.uint32(4)  # noqa: B023, E731
            lo, end = starts[head].astype(np.int64), starts[head + 1].astype(np.int64)
            hi = end
            for _ in range(int((end - lo).max()).bit_length()):
                mid = (lo + hi) >> 1
                less = (lo < hi) & (hash_at(mid) < want)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            place = np.minimum(lo, len(tails) - 1)
            known = np.flatnonzero((lo < end) & (hash_at(place) == want))
            place = place[known]
            if wide:
                found = row[place]
            else:
                found = (tails[place] & np.uint32(FAR)).astype(np.int64)
                listed = np.flatnonzero(found == FAR)
                found[listed] = row[np.searchsorted(far, place[listed].astype(np.uint32))]
            out[:, i + known] = table[:, found]
        return out

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, training count) of words by hash."""
        uniq, back = np.unique(hashes, return_inverse=True)
        count, rank = self.find("word", uniq, 2)
        ids = np.where(count > 0, _U(1) + rank * _U(self.n) + _place(uniq, self.n)[0], _UNKNOWN_ID)
        ids[uniq == _START] = _START_ID
        return ids[back], count[back]


# -- counting ----------------------------------------------------------------------------------------------------------

_PACKED = "kind string, bucket bigint, columns binary"
_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("columns", pa.binary())])
_STATS = ["level", "n1", "n2", "n3", "n4", "more", "total"]


def _gram_rows(columns: list[np.ndarray], values: list[np.ndarray], bucket: np.ndarray) -> list[dict]:
    """A row for each bucket: columns of word numbers, sorted, and of values, in one packed piece."""
    o, bucket = np.argsort(C.sort_key([bucket, *columns])), bucket.astype(np.int64)
    bucket, columns, values = bucket[o], [c[o] for c in columns], [v[o] for v in values]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(at, len(bucket))[1:]
    return [{"kind": "gram", "bucket": k, "columns": C.pack_columns([c[a:b] for c in (*columns, *values)])} for k, a, b in zip(bucket[at].tolist(), at, ends, strict=True)]


def _grams(t: pa.Table, order: int, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The columns and values of all rows of a group."""
    parts = [[np.zeros(0, np.uint64)] * (order + width)]
    parts += [C.unpack_columns(c.as_py()) for kind, c in zip(t["kind"].to_pylist(), t["columns"], strict=True) if kind == "gram"]
    both = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return both[:order], both[order:]


def _sum_by(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(different keys, a place of each, sums of values)."""
    o, at = C.runs(key)
    first, last = o[at], np.append(at, len(o))[1:] - 1
    return key[first], first, [np.diff(np.cumsum(v[o], dtype=np.uint64)[last], prepend=_U(0)) for v in values]


def _blocks(texts_of, counted):
    """Some millions of tokens at a time."""

    def run(batches):
        parts, n = [], 0
        for batch in C.slices(batches, "text"):
            parts.append(texts_of(batch.column(0)))
            n += len(parts[-1])
            if n >= BLOCK_TOKENS:
                yield pa.RecordBatch.from_pylist(counted(np.concatenate(parts)), _ARROW)
                parts, n = [], 0
        if parts:
            yield pa.RecordBatch.from_pylist(counted(np.concatenate(parts)), _ARROW)

    return run


def _count_words(n_buckets: int):
    def counted(hashes):
        h, n = np.unique(hashes, return_counts=True)
        return _gram_rows([h], [n], _place(h, n_buckets)[0])

    return _blocks(lambda texts: tokens(texts, 1)[0], counted)


def _add_words(folder: str, n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        (h,), values = _grams(t, 1, 1)
        h, _, (n,) = _sum_by(h, values)
        rank = np.empty(len(h), np.uint64)
        rank[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(len(h))
        store(f"{folder}/word/{t['bucket'][0].as_py()}", h, [n, rank], n_buckets, wide=True)
        return pa.table({"tokens": pa.array([int(n.sum())], pa.int64()), "distinct": pa.array([len(h)], pa.int64())})

    return run


def _count_grams(folder: str, n_buckets: int, order: int):
    def run(batches):
        arrays = Arrays(folder, n_buckets)

        def counted(ids):
            ends = np.flatnonzero(ids != _START_ID)
            columns = [ids[ends - k] for k in range(order - 1, -1, -1)]
            key = gram_keys(columns)
            o, at = C.runs(key)
            n, first = np.diff(np.append(at, len(o))), o[at]
            bucket, columns = _place(key[first], n_buckets)[0], [c[first] for c in columns]
            del ends, key, o, at, first
            return _gram_rows(columns, [n], bucket)

        yield from _blocks(lambda texts: arrays.numbers(tokens(texts, order)[0])[0], counted)(batches)

    return run


def _add_grams(folder: str, n_buckets: int, level: int, order: int):
    """Stores a bucket of `level` words: its count (predecessors below the order), and of the counts that follow it: their
    total and how many are 1, 2 and more. Gives rows for the level below, and statistics."""
    width = 1 if level == order else 5

    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        columns, values = _grams(t, level, width)
        if level < order:
            both, before, others, twos, more = values
            values = [before, both - before, both - before - others, twos, more]
        key, first, values = _sum_by(gram_keys(columns), values)
        columns = [c[first] for c in columns]
        store(f"{folder}/{level}/{bucket}", key, values, n_buckets)
        n = values[0]
        own = [level, *np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].tolist(), int((n >= 3).sum()), int(n.sum())]
        stats = [own] + [C.unpack(a.as_py()).tolist() for k, a in zip(t["kind"].to_pylist(), t["columns"], strict=True) if k == "stats"]
        if level == 1:
            return pa.table({name: pa.array([s[i] for s in stats], pa.int64()) for i, name in enumerate(_STATS)})
        used = n > 0
        n, columns = n[used], [c[used] for c in columns]
        none, one = np.zeros(len(n), np.uint64), np.ones(len(n), np.uint64)
        below = [np.concatenate(pair) for pair in zip(columns[1:], columns[:-1], strict=True)]
        given = [np.concatenate(pair) for pair in ((one, none), (none, n), (none, n == 1), (none, n == 2), (none, n >= 3))]
        key, first, given = _sum_by(gram_keys(below), given)
        before, total, ones, twos, more = given
        # most sequences are seen from one side and once: sums and differences that are mostly equal pack to nothing
        sent = [before + total, before, total - ones, twos, more]
        rows = _gram_rows([c[first] for c in below], sent, _place(key, n_buckets)[0])
        rows += [{"kind": "stats", "bucket": bucket, "columns": C.pack(np.array(s, np.uint64))} for s in stats]
        return pa.Table.from_pylist(rows, _ARROW)

    return run


def discounts_of(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Of counts 1, 2 and 3 or more; where counts of counts are missing, a half of each step."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.0), float(k)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _path(folder: str) -> str:
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError("spark.checkpoint.dir must be a folder that executors see as a path: the model's arrays are mapped into memory")
    return folder


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> dict:
    """Where the arrays are, and the model's few numbers."""
    folder = _path(C.shared_folder(docs.sparkSession, "language-model"))
    n = C.buckets_for(C.text_bytes(docs, text), BUCKET_BYTES)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = texts.mapInArrow(_count_words(n), _PACKED).groupBy("bucket").applyInArrow(_add_words(folder, n), "tokens bigint, distinct bigint")
    r = words.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    rows = texts.mapInArrow(_count_grams(folder, n, order), _PACKED)
    for level in range(order, 0, -1):
        schema = _PACKED if level > 1 else ", ".join(f"{x} bigint" for x in _STATS)
        rows = rows.groupBy("bucket").applyInArrow(_add_grams(folder, n, level, order), schema)
    stats = {s["level"]: s for s in rows.groupBy("level").agg(*(F.sum(x).alias(x) for x in _STATS[1:])).collect()}
    often = [[float(stats[k][f"n{i}"]) for i in range(1, 5)] if k in stats else [0.0] * 4 for k in range(1, order + 1)]
    first = [float(stats[1][x]) for x in ("total", "n1", "n2", "more")] if stats else [0.0] * 4
    return {"folder": folder, "buckets": n, "order": order, "tokens": r["tokens"] or 0, "distinct": r["distinct"] or 0, "discounts": [discounts_of(*x) for x in often], "first": first}


# -- scoring -----------------------------------------------------------------------------------------------------------


def probabilities(arrays: Arrays, model: dict, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the tokens among marks and tokens, training count of each, probability of each after those before)."""
    ids, count = arrays.numbers(hashes)
    at = np.flatnonzero(hashes != _START)
    p = np.full(len(at), 1 / (model["distinct"] + 1))
    after = np.repeat(np.array(model["first"])[:, None], len(at), 1)
    columns = []
    for level in range(1, model["order"] + 1):
        columns.insert(0, np.roll(ids, level - 1))
        uniq, back = np.unique(gram_keys(columns), return_inverse=True)
        values = arrays.find(str(level), uniq, 1 if level == model["order"] else 5)
        n = values[0][back[at]].astype(np.float64)
        d = model["discounts"][level - 1]
        kept = np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)], 0)
        total = np.maximum(after[0], 1)
        p = np.where(after[0] > 0, kept / total + (d[0] * after[1] + d[1] * after[2] + d[2] * after[3]) / total * p, p)
        if level < model["order"]:
            after = values[1:][:, back[at - 1]].astype(np.float64)
    return at, count[at], p


def score(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        arrays = Arrays(model["folder"], model["buckets"])
        for batch in C.slices(batches, "__text", 4 << 20):
            hashes, doc = _tokens_of(batch, model["order"])
            at, count, p = probabilities(arrays, model, hashes)
            base = np.log10((count + 0.1) / (model["tokens"] + 0.1 * (model["distinct"] + 1)))
            total = lambda w=None: np.bincount(doc[at], w, minlength=len(batch))  # noqa: B023, E731
            values = [total().astype(np.int64), total(count > 0).astype(np.int64), np.full(len(batch), model["tokens"], np.int64), total(base), total(np.log10(p))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, values)], [*batch.schema.names[1:], *names])

    kept = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), *keep)
    schema = kept.drop("__text").schema
    for x, kind in zip(names, ["long"] * 3 + ["double"] * 2, strict=True):
        schema = schema.add(x, kind)
    return kept.mapInArrow(run, schema)


def _tokens_of(batch: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts by smaller slices: hashing takes room of many times the bytes."""
    parts, at = [], 0
    for part in C.slices(iter([batch]), "__text"):
        hashes, doc = tokens(part.column(0), order)
        parts.append((hashes, doc + at))
        at += len(part)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = C.table(spark, sf_dir, "documents").withColumn("held_out", held)
    return score(docs, train(docs.where(~F.col("held_out"))), keep=("doc_id", "held_out"))
