"""What the operators share: tables, the shared folder, packed arrays, vectorised word hashes, connected components.

Packed arrays: where a corpus-wide join would shuffle one row for every word occurrence, tasks pre-aggregate a chunk of
documents first and send sorted, compressed arrays, one row for each (chunk, bucket). Spark still partitions, shuffles
and groups those rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written  # noqa: F401

#: A word is a run of anything but these six ASCII separators.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Rows that hold texts are large: unless the session says otherwise, 1,000 of them make an Arrow batch, not 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts; numbers of buckets follow it, so that a bucket's size does not grow with the corpus."""
    return df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def buckets_for(n_bytes: int, each: int = 32 << 20, least: int = 256) -> int:
    return max(least, -(-n_bytes // each))


# -- packed arrays -----------------------------------------------------------------------------------------------------

_ZIP = zstandard.ZstdCompressor(level=1)
_UNZIP = zstandard.ZstdDecompressor()


def pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as byte planes, compressed: planes that hold only zeros take no room. ascending: stores differences."""
    a = np.ascontiguousarray(a, dtype=np.uint64)
    if ascending and len(a):
        a = np.concatenate((a[:1], np.diff(a)))
    planes = a.view(np.uint8).reshape(-1, 8).T
    return _ZIP.compress(len(a).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, ascending: bool = False) -> np.ndarray:
    raw = _UNZIP.decompress(b)
    n = int.from_bytes(raw[:8], "little")
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8).reshape(8, n).T).view(np.uint64).reshape(-1)
    return np.cumsum(a, dtype=np.uint64) if ascending else a


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Integers of several columns of one length in one piece, as byte planes without those that hold only zeros; of the
    first column, which is best sorted, the differences."""
    columns = [np.ascontiguousarray(c, dtype=np.uint64) for c in columns]
    n = len(columns[0])
    if n:
        columns[0] = np.concatenate((columns[0][:1], np.diff(columns[0])))
    used = [(int(c.max()).bit_length() + 7) // 8 if n else 0 for c in columns]
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes() for c, k in zip(columns, used, strict=True)]
    return _ZIP.compress(b"".join([n.to_bytes(8, "little"), len(columns).to_bytes(2, "little"), bytes(used), *planes]))


def unpack_columns(b: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(_UNZIP.decompress(b), np.uint8)
    n, width = int.from_bytes(raw[:8].tobytes(), "little"), int.from_bytes(raw[8:10].tobytes(), "little")
    out, at = [], 10 + width
    for k in raw[10:at].tolist():
        c = np.zeros((n, 8), np.uint8)
        c[:, :k] = raw[at : at + n * k].reshape(k, n).T
        out.append(c.view(np.uint64).reshape(-1))
        at += n * k
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of the keys, where in it each different one begins); equal keys stand in any order."""
    o = np.argsort(keys)
    s = keys[o]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return o, np.flatnonzero(new)


def sort_key(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit keys that sort by the first column, then the next ones, as far as the bits go."""
    out, room = np.zeros(len(columns[0]), np.uint64), 64
    for c in columns:
        bits = int(c.max()).bit_length() if len(c) else 0
        kept = min(bits, room)
        if kept:
            room -= kept
            out |= c.astype(np.uint64) >> np.uint64(bits - kept) << np.uint64(room)
    return out


def pack_strings(words: pa.Array) -> bytes:
    offsets, data = string_buffers(words)
    return _ZIP.compress(len(words).to_bytes(8, "little") + np.diff(offsets).astype("<u4").tobytes() + data.tobytes())


def unpack_strings(b: bytes) -> pa.Array:
    raw = _UNZIP.decompress(b)
    n = int.from_bytes(raw[:8], "little")
    offsets = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64)))
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[8 + 4 * n :]))


def string_buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string or binary array without nulls."""
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, offsets, data = a.buffers()
    if offsets is None or not len(a):
        return np.zeros(len(a) + 1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], d[o[0] : o[-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each (start, length), one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


# -- hashes ------------------------------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of the 64-bit split-mix generator."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p) if n else p


def _sums(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each segment from a start to the next: sum of values[byte] * base ** place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = data[starts[0] :]
    starts = starts - starts[0]
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    return np.add.reduceat(values[data] * _powers(int(lengths.max()))[place], starts)


def string_hashes(a: pa.Array) -> np.ndarray:
    """64-bit hash of each whole string."""
    offsets, data = string_buffers(a)
    lengths = np.diff(offsets)
    out = np.zeros(len(a), np.uint64)
    full = np.flatnonzero(lengths)
    out[full] = _sums(data, offsets[:-1][full], _BYTE)
    return mix(out + lengths.astype(np.uint64))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z as a-z if lower), and the place of each word's text in the array."""
    offsets, data = string_buffers(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    in_word = ~_IS_SEP[data]
    first = in_word.copy()
    first[1:] &= ~in_word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = in_word[heads]
    starts = np.flatnonzero(first)
    values = (_LOWER if lower else _BYTE).copy()
    values[list(SEPARATORS)] = 0
    return mix(_sums(data, starts, values)), np.searchsorted(offsets, starts, side="right") - 1


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about that many bytes of text; a longer text comes alone and whole."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        offsets, _ = string_buffers(col)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with up to that many bytes of text, across batches; a longer text comes whole, with others or not."""
    held, size = [], 0
    for part in slices(batches, text, most):
        offsets, _ = string_buffers(part.column(part.schema.get_field_index(text)))
        if held and size + offsets[-1] > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += offsets[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# -- connected components ----------------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): smallest id that each end of an edge reaches. Minimum labels with one jump to the label's own
    label a round; hubs are pre-aggregated, joins leave skew to Spark's adaptive splitting. Ids are bigint, not null."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        low = labels.join(near, "x").select("x", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("x").alias("m"), F.col("l").alias("j"))
        new = written(low.join(jump, "m", "left").select("x", F.col("l").alias("was"), F.least("m", F.coalesce("j", "m")).alias("l")), "labels")
        changed = new.where("l <> was").limit(1).count()
        labels = new.select("x", "l")
        if not changed:
            return labels.select(F.col("x").alias("id"), F.col("l").alias("component"))


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, component) after edges (a, b) between their ids, or new ones, are added: only components that edges
    connect are worked through again."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    named = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    named = written(named, "named")
    met = components(named.select("ca", "cb").where("ca <> cb").distinct(), "ca", "cb").select(F.col("id").alias("component"), F.col("component").alias("lower"))
    ends = named.select(F.col("a").alias("id"), F.col("ca").alias("component")).unionByName(named.select(F.col("b").alias("id"), F.col("cb").alias("component")))
    ids = labels.unionByName(ends.where("id = component").distinct().join(labels.select("id"), "id", "left_anti"))
    return written(ids.join(met, "component", "left").select("id", F.coalesce("lower", "component").alias("component")), "labels")
